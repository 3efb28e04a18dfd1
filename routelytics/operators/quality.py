"""Raw message text in, parsed / rejected out: parsing (P1), validation (P10),
dead-letter envelopes (K2), rejects by reason (A21) and the log preview (P16).

Parsing uses ``try_parse_json`` (VARIANT; NULL on malformed text) so bad
records never fail a task; nothing is dropped — every input row ends up either
valid or in the dead-letter output with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def parse_and_validate(raw: DataFrame, value: str = "value") -> DataFrame:
    """P1 + P10 in one pass: skip blank values, parse once, add ``v`` and
    ``reason``."""
    return validate_messages(raw.filter(F.col(value).isNotNull() & (F.col(value) != "")), value)


def scalar_falsy(x: Column) -> Column:
    """JS falsiness of one extracted JSON value (a small VARIANT): missing,
    null, '', false, 0 (any numeric type)."""
    t = F.schema_of_variant(x)
    as_str = F.try_variant_get(x, "$", "string")
    return F.coalesce(
        x.isNull() | F.is_variant_null(x)
        | ((t == "STRING") & (as_str == ""))
        | ((t == "BOOLEAN") & (as_str == "false"))
        | (t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
           & (F.try_variant_get(x, "$", "double") == 0)),
        F.lit(True))


def validate_messages(parsed: DataFrame, value: str = "value") -> DataFrame:
    """P10: adds ``reason`` (NULL = valid), in order: malformed JSON; valid JSON
    that is null (field access fails -> processing_error); id or type missing or falsy,
    as they also are in a scalar or an array.

    The parse and the two required fields are produced by a one-row generator:
    a filter on ``reason`` (dead letters, anti joins) cannot be pushed beneath a
    generator, so each message is parsed once, not once per branch of the
    pushed-down condition."""
    cols = [c for c in parsed.columns if c != "v"]
    parsed_v = F.try_parse_json(F.col(value))
    fields = F.struct(parsed_v.alias("v"),
                      F.col(value).rlike(r"^\s*\{").alias("_is_obj"))
    d = parsed.select(*cols, F.inline(F.array(fields)))
    d = d.select("*", F.try_variant_get("v", "$.id", "variant").alias("_vid"),
                 F.try_variant_get("v", "$.type", "variant").alias("_vtype"))
    reason = (F.when(F.col("v").isNull(), F.lit("malformed_json"))
              .when(F.is_variant_null("v"), F.lit("processing_error"))
              .when(~F.col("_is_obj"), F.lit("missing_required"))
              .when(scalar_falsy(F.col("_vid")) | scalar_falsy(F.col("_vtype")),
                    F.lit("missing_required")))
    return d.withColumn("reason", reason).drop("_is_obj", "_vid", "_vtype")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (validated.filter(F.col("reason").isNull()),
            validated.filter(F.col("reason").isNotNull()))


def dead_letters(rejected: DataFrame, original_queue: str, value: str = "value",
                 failed_at: Column | None = None, keep=()) -> DataFrame:
    """K2: envelope ``{original_queue, message, error, reason, failed_at}``."""
    errors = {"malformed_json": "malformed JSON", "missing_required": "missing required fields",
              "processing_error": "processing error", "expired": "message expired",
              "publish_failed": "publish failed"}
    err = None
    for k, e in errors.items():
        err = F.when(F.col("reason") == k, F.lit(e)) if err is None else err.when(F.col("reason") == k, F.lit(e))
    return rejected.select(
        *keep,
        F.lit(original_queue).alias("original_queue"),
        F.col(value).alias("message"),
        err.alias("error"),
        F.col("reason"),
        (failed_at if failed_at is not None else F.current_timestamp()).alias("failed_at"))


def rejects_by_reason(dlq: DataFrame) -> DataFrame:
    """Rejects per cause."""
    return dlq.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def preview_raw(raw: DataFrame, value: str = "value", width: int = 80) -> DataFrame:
    """Payload length and the first ``width`` characters, '...' when cut."""
    v = F.col(value)
    return raw.withColumn("raw_length", F.length(v)).withColumn(
        "preview", F.concat(F.substring(v, 1, width),
                            F.when(F.length(v) > width, F.lit("...")).otherwise(F.lit(""))))

