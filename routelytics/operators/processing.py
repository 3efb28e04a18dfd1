"""What the consumers do with a message: action labels (P14, P15), nominal
handling cost (P17), count-or-timeout batches (W2, A19) and whole-batch rejects
(ST7).  Sleeps of the source system are not reproduced; the labels and the
nominal cost are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (BATCH_ACTION_COST_MS, BATCH_SIZE, BATCH_TIMEOUT_MS,
                         URGENT_ACTION_AMOUNT, URGENT_ACTION_COST_MS,
                         URGENT_ACTION_RISK)
from .scan import BLK, ordered_blocks


def urgent_action(type_col: Column, amount: Column, risk: Column) -> Column:
    """P14, first true wins: fraud -> fraud alert; payment above 10000 -> manual
    approval; risk above 0.8 -> block; else fast-track (NULL comparisons fall
    through, as undefined does)."""
    return (F.when(type_col == "fraud", F.lit("fraud_alert"))
            .when((type_col == "payment") & F.coalesce(amount > URGENT_ACTION_AMOUNT, F.lit(False)),
                  F.lit("manual_approval"))
            .when(F.coalesce(risk > URGENT_ACTION_RISK, F.lit(False)), F.lit("block_transaction"))
            .otherwise(F.lit("fast_track")))


def batch_action(type_col: Column) -> Column:
    """Per type group of a batch."""
    return (F.when(type_col == "analytics", F.lit("warehouse_aggregate"))
            .when(type_col == "report", F.lit("generate_reports"))
            .when(type_col == "sensor", F.lit("time_series_store"))
            .otherwise(F.lit("generic_batch")))


def action_cost(action: Column, table: dict) -> Column:
    """Nominal handling ms of an action label."""
    expr = None
    for k, v in table.items():
        expr = F.when(action == k, F.lit(v)) if expr is None else expr.when(action == k, F.lit(v))
    return expr


def classify_urgent_action(df: DataFrame, type_col="type", amount="amount",
                           risk="risk_score") -> DataFrame:
    a = urgent_action(F.col(type_col), F.col(amount), F.col(risk))
    return df.withColumn("action", a).withColumn(
        "cost_ms", action_cost(F.col("action"), URGENT_ACTION_COST_MS))


def classify_batch_action(df: DataFrame, type_col="type") -> DataFrame:
    return df.withColumn("action", batch_action(F.col(type_col))).withColumn(
        "cost_ms", action_cost(F.col("action"), BATCH_ACTION_COST_MS))


def assign_chunks(df: DataFrame, ts_ms: str = "ts_ms", key: str = "message_id",
                  shard: str | None = None, size: int = BATCH_SIZE,
                  timeout_ms: int = BATCH_TIMEOUT_MS, blocks: int | None = None) -> DataFrame:
    """The batch consumer's count-or-idle-timeout batches, replayed on event
    time.  A batch closes at ``size`` messages, or when the next message comes
    ``timeout_ms`` or more after the previous one (the timer restarts on every
    message).  So: a gap starts a new run, and runs split into groups of
    ``size``.

    One collector is one ordered sequence (``shard=None``); a ``shard`` column
    models several collectors.  Neither is gathered into one task: the sequence
    is range-sorted into blocks (see ``scan``); each block finds
    its rank, previous stamp and last local run start with one window; a tiny
    window over the per-block summaries carries counts, the previous block's
    last stamp and the run start in effect across block borders.

    Adds ``pos``, ``run_start`` (position of the run start), ``chunk_no``
    (within the run) and ``chunk_id`` (string key)."""
    P = [shard] if shard else []
    d = ordered_blocks(df, [ts_ms, key], blocks)
    w = Window.partitionBy(*P, BLK).orderBy(ts_ms, key)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = F.lag(ts_ms).over(w)
    loc = (d.withColumn("_lpos", F.row_number().over(w))
            .withColumn("_lgap", F.col(ts_ms) - prev))
    loc = loc.withColumn("_lstart", F.max(F.when(F.col("_lgap") >= timeout_ms, F.col("_lpos"))).over(run))
    tot = loc.groupBy(*P, BLK).agg(F.count(F.lit(1)).alias("_bn"),
                                   F.min(ts_ms).alias("_bfirst"), F.max(ts_ms).alias("_blast"),
                                   F.max("_lstart").alias("_bstart"))
    wb = Window.partitionBy(*P).orderBy(BLK)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    on = F.coalesce(F.sum("_bn").over(before), F.lit(0))
    prev_last = F.lag("_blast").over(wb)
    first_flag = prev_last.isNull() | ((F.col("_bfirst") - prev_last) >= timeout_ms)
    blk = (tot.select(*P, BLK, "_bstart", on.alias("_on"), first_flag.alias("_ff"))
              .withColumn("_own", F.when(F.col("_bstart").isNotNull(), F.col("_on") + F.col("_bstart"))
                                   .when(F.col("_ff"), F.col("_on") + 1))
              .withColumn("_carry", F.max("_own").over(before))
              .select(*P, BLK, "_on",
                      F.when(F.col("_ff"), F.col("_on") + 1).otherwise(F.col("_carry")).alias("_first_start")))
    keys = F.col(f"l.{BLK}") == F.col(f"b.{BLK}")
    for c in P:
        keys = keys & F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = loc.alias("l").join(blk.alias("b"), keys, "left").select("l.*", "b._on", "b._first_start")
    out = (out.withColumn("pos", F.col("_on") + F.col("_lpos"))
              .withColumn("run_start", F.when(F.col("_lstart").isNotNull(), F.col("_on") + F.col("_lstart"))
                                        .otherwise(F.col("_first_start")))
              .withColumn("chunk_no", F.floor((F.col("pos") - F.col("run_start")) / size))
              .drop(BLK, "_lpos", "_lgap", "_lstart", "_on", "_first_start"))
    parts = [F.col(shard).cast("string")] if shard else []
    return out.withColumn("chunk_id", F.concat_ws(":", *parts, F.col("run_start").cast("string"),
                                                  F.col("chunk_no").cast("string")))


def chunk_stats(chunked: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Number of chunks, largest chunk, number of full chunks."""
    per = chunked.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("chunks"), F.max("n").alias("largest"),
                   F.count_if(F.col("n") == size).alias("full_chunks"))


def group_batch_by_type(chunked: DataFrame, type_col: str = "message_type") -> DataFrame:
    """Inside each batch, the number of messages per type."""
    return chunked.groupBy("chunk_id", type_col).agg(F.count(F.lit(1)).alias("n"))


def chunk_cost(chunked: DataFrame, type_col: str = "message_type") -> DataFrame:
    """P17 for batches: a batch costs the sum over its distinct type groups."""
    per_type = (chunked.groupBy("chunk_id", F.col(type_col).alias("_t"))
                .agg(F.count(F.lit(1)).alias("n"))
                .withColumn("cost_ms", action_cost(batch_action(F.col("_t")), BATCH_ACTION_COST_MS)))
    return per_type.groupBy("chunk_id").agg(F.sum("n").alias("messages"),
                                            F.count(F.lit(1)).alias("type_groups"),
                                            F.sum("cost_ms").alias("cost_ms"))


def reject_failed_chunks(chunked: DataFrame, failed: Column) -> DataFrame:
    """ST7: if any message of a batch fails, every message of that batch is
    rejected.  Returns the chunked rows with ``batch_failed``; the flag is a
    per-chunk aggregate joined back on the chunk key (no window over a chunk)."""
    flags = (chunked.withColumn("_f", failed.cast("boolean"))
             .groupBy("chunk_id").agg(F.bool_or(F.coalesce("_f", F.lit(False))).alias("batch_failed")))
    return chunked.join(flags, "chunk_id", "left")
