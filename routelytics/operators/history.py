"""Routing history: projection (P3), processed marks (J2, J3), recent rows
(T1, T2), filters (P5, P7-P9) and the presentation columns (P13).

History is append-only.  Processing outcomes live in a separate append-only
log and are joined on read (key = benchmark_id, message_id), so a consumer's
update can never be lost to a race with the history insert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (BATCH_CONSUMER, HISTORY_DEFAULT_LIMIT,
                         RISK_FLAG_THRESHOLD, URGENT_CONSUMER, URGENT_QUEUE)
from ..functions.coercion import falsy_to_null
from ..functions.display import clock_time, money, to_fixed
from ..functions.timefmt import parse_ts
from pyspark.sql.types import DoubleType, StringType

KEY = ["benchmark_id", "message_id"]


def to_history(routed: DataFrame) -> DataFrame:
    """One history row per routed message; falsy values become NULL (G2).  ``ts`` is
    the routing time: ``routed_at`` where the router stamped it, else the message's own."""
    s, d = StringType(), DoubleType()
    have = set(routed.columns)

    def opt(name, dtype="string"):
        # a field the input does not carry is missing (NULL), as in the source
        return F.col(name) if name in have else F.lit(None).cast(dtype)
    cols = [
        F.col("id").alias("message_id"),
        F.col("target_queue"),
        F.col("matched_rule"),
        F.col("matched_priority"),
        # routing latency is measured upstream (publish - receipt; the stream
        # router measures it per micro-batch); absent -> NULL
        opt("latency_ms", "double").alias("latency_ms"),
        opt("routed_at" if "routed_at" in have else "ts", "timestamp").alias("ts"),
        falsy_to_null(opt("benchmark_id"), s).alias("benchmark_id"),
        F.coalesce(opt("is_critical", "boolean"), F.lit(False)).alias("is_critical"),
        falsy_to_null(opt("type"), s).alias("message_type"),
        falsy_to_null(opt("priority"), s).alias("message_priority"),
        falsy_to_null(opt("region"), s).alias("message_region"),
        falsy_to_null(opt("risk_score", "double"), d).alias("risk_score"),
        falsy_to_null(opt("amount", "double"), d).alias("amount"),
        falsy_to_null(opt("source"), s).alias("source"),
        falsy_to_null(opt("user_id"), s).alias("user_id"),
    ]
    extras = [c for c in ("ts_ms", "processed_ms") if c in routed.columns]
    return routed.select(*cols, *[F.col(c) for c in extras])


def same_key(left: str, right: str, key=None):
    """Join condition on the key; a missing cohort (optional in messages) is a cohort.
    Null-safe equality is hash-joined like any other."""
    cond = F.lit(True)
    for k in key or KEY:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def consumer_of(queue) -> "F.Column":
    return F.when(queue == URGENT_QUEUE, F.lit(URGENT_CONSUMER)).otherwise(F.lit(BATCH_CONSUMER))


def processed_log(history: DataFrame, cost_col: str | None = None) -> DataFrame:
    """The consumers' processed log for the fixture: one row per message whose
    ``processed_ms`` is set (PROCESSED schema)."""
    cost = F.col(cost_col).cast("double") if cost_col else F.lit(None).cast("double")
    return (history.filter(F.col("processed_ms").isNotNull())
            .select("benchmark_id", "message_id", "target_queue", "processed_ms",
                    consumer_of(F.col("target_queue")).alias("processed_by"),
                    cost.alias("processing_time"),
                    F.lit("processed").alias("status")))


def _latest_per_key(processed: DataFrame, key) -> DataFrame:
    # several processed rows for one key (replays): the latest wins, of equal ones the
    # greatest by the other fields
    return (processed.groupBy(*key)
            .agg(F.max(F.struct("processed_ms", "processed_by", "processing_time", "status")).alias("_p"))
            .filter("_p.processed_ms IS NOT NULL").select(*key, "_p.*"))


def mark_processed_many(history: DataFrame, processed: DataFrame, key=KEY) -> DataFrame:
    """J3 (``$in`` update): every history row whose key was processed.
    ``key=['message_id']`` reproduces the source system, whose ids repeat
    across runs (G9)."""
    hist = history.drop(*[c for c in ("processed_ms",) if c in history.columns])
    h, p = hist.alias("h"), _latest_per_key(processed, key).alias("p")
    extra = [c for c in p.columns if c not in key]
    return h.join(p, same_key("h", "p", key), "left").select("h.*", *[F.col(f"p.{c}") for c in extra])


def mark_processed(history: DataFrame, processed: DataFrame, key=KEY) -> DataFrame:
    """J2 (find-one-and-update): only the first history row of a key (by time, then
    queue, then the row's other columns) receives the processed fields; duplicates stay
    'routed'.  Rows without a message id match no update, so they are kept out of the
    window, whose partitions are one id's duplicates."""
    hist = history.drop(*[c for c in ("processed_ms",) if c in history.columns])
    lead = [c for c in ("ts", "target_queue") if c in hist.columns]
    rest = sorted(c for c in hist.columns if c not in (*lead, *key))
    # ids that are missing are told apart by a hash, so they share no partition
    alone = F.when(F.col("message_id").isNull(), F.xxhash64(*lead, *rest))
    w = Window.partitionBy(*key, alone).orderBy(*lead, *rest)
    h = hist.withColumn("_rn", F.row_number().over(w)).alias("h")
    p = _latest_per_key(processed, key).alias("p")
    # equi-join on the key (the rank window already partitioned history by it);
    # "only the first row" is an extra join condition, not a join key
    cond = same_key("h", "p", key) & (F.col("h._rn") == 1) & F.col("h.message_id").isNotNull()
    j = h.join(p, cond, "left")
    extra = [c for c in p.columns if c not in key]
    return j.select("h.*", *[F.col(f"p.{c}") for c in extra]).drop("_rn")


def recent_history(history: DataFrame, limit=HISTORY_DEFAULT_LIMIT) -> DataFrame:
    """Newest first (ties by message id); invalid or 0 limit -> 50.
    Planned as TakeOrderedAndProject: each task keeps its own top ``limit``."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        n = 0
    n = n if n > 0 else HISTORY_DEFAULT_LIMIT
    return history.orderBy(F.col("ts").desc(), F.col("message_id"), F.col("benchmark_id")).limit(n)


def filter_history(history: DataFrame, queue: str = "all") -> DataFrame:
    """P5: all / urgent / batch, by queue name (applied after any limit, G17)."""
    if queue == "all":
        return history
    return history.filter(F.col("target_queue") == F.lit(f"{queue}.queue"))


def clean_latency(history: DataFrame, col: str = "latency_ms") -> DataFrame:
    """Numeric, not NaN, >= 0."""
    c = F.col(col).cast("double")
    return history.filter(c.isNotNull() & ~F.isnan(c) & (c >= 0))


def valid_timestamps(df: DataFrame, col: str = "ts") -> DataFrame:
    """Keep rows whose time stamp parses (text columns are parsed)."""
    c = F.col(col)
    if dict(df.dtypes)[col] == "string":
        c = parse_ts(c)
    return df.filter(c.isNotNull())


def processed_only(history: DataFrame) -> DataFrame:
    """Rows with both a processed time and a routing time."""
    return history.filter(F.col("processed_ms").isNotNull() & F.col("ts").isNotNull())


def present_history(history: DataFrame) -> DataFrame:
    """The view's derived columns: status (default 'routed'), queue short
    name (everything not urgent shows 'batch'), amount as grouped text in dollars and
    risk with two digits, or '—',
    risk flag above 0.8, critical 'YES' / '—'."""
    dash = F.lit("—")
    amount_ok = F.col("amount").isNotNull() & (F.col("amount") != 0)
    risk_ok = F.col("risk_score").isNotNull() & (F.col("risk_score") != 0)
    return history.select(
        "message_id", "benchmark_id", "message_type", "latency_ms",
        F.coalesce(F.col("status"), F.lit("routed")).alias("status_label"),
        F.when(F.col("target_queue") == URGENT_QUEUE, F.lit("urgent"))
         .otherwise(F.lit("batch")).alias("queue_label"),
        F.when(amount_ok, money(F.col("amount"))).otherwise(dash).alias("amount_shown"),
        F.when(risk_ok, to_fixed(F.col("risk_score"), 2)).otherwise(dash).alias("risk_text"),
        F.coalesce(F.col("risk_score") > RISK_FLAG_THRESHOLD, F.lit(False)).alias("risk_flag"),
        F.when(F.col("is_critical"), F.lit("YES")).otherwise(dash).alias("critical_label"),
        clock_time(F.col("ts")).alias("time_label"),
    )
