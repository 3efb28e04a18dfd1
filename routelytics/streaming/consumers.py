"""Queue consumers as streaming queries (ST3, ST6, A20).

The urgent consumer is stateless per message: validate, label the action,
append a processed row.  Status is joined to history on read, so a processed
row can never be lost to a race with the history insert (G10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (BATCH_ACTION_COST_MS, BATCH_CONSUMER, BATCH_QUEUE, METRICS_WINDOW_ROWS,
                         URGENT_CONSUMER, URGENT_QUEUE)
from ..operators.history import recent_history
from ..operators.metrics import live_metrics
from ..operators.processing import action_cost, batch_action, classify_urgent_action
from ..operators.queues import depth_from_nets, reject_deltas
from ..operators.quality import dead_letters, parse_and_validate, split_valid
from ..sinks.commits import CommitLog
from .collector import collect_batches
from .router import from_variant


def process_urgent(routed_stream: DataFrame) -> DataFrame:
    """ST3: urgent queue rows -> processed rows with the action and its cost."""
    u = routed_stream.filter(F.col("target_queue") == URGENT_QUEUE)
    a = classify_urgent_action(u, "type", "amount", "risk_score")
    return a.select(
        "benchmark_id", F.col("id").alias("message_id"), "target_queue", "action",
        F.col("cost_ms").cast("double").alias("processing_time"),
        F.lit(URGENT_CONSUMER).alias("processed_by"), F.lit("processed").alias("status"),
        F.unix_millis(F.current_timestamp()).alias("processed_ms"))


def start_urgent_consumer(routed_stream: DataFrame, out_dir: str, checkpoint: str,
                          available_now: bool = False):
    w = (process_urgent(routed_stream).writeStream.format("parquet")
         .option("path", out_dir).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def start_urgent_consumer_raw(queue_stream: DataFrame, out_dir: str, checkpoint: str,
                              available_now: bool = False):
    """ST3 on message text (``value``): every message is parsed and validated first;
    broken ones go to ``dead_letters`` with their reason, the others to ``processed``;
    one commit per micro-batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        checked = parse_and_validate(batch).persist()   # one parse per message
        try:
            good, bad = split_valid(checked)
            done = process_urgent(from_variant(good).withColumn("target_queue", F.lit(URGENT_QUEUE)))
            CommitLog(batch.sparkSession, out_dir).commit(
                batch_id, {"dead_letters": dead_letters(bad, URGENT_QUEUE), "processed": done})
        finally:
            checked.unpersist()
    w = queue_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def process_batches(collected: DataFrame, failed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """ST2/ST7: flushed batches (the collector's output) -> (processed rows, rejected
    rows).  A batch is grouped by type; its handling time is the sum over its types, and
    every message of it gets that time.  If ``failed`` holds for any message, the whole
    batch is rejected."""
    key = ["shard", "batch_no"]
    cost = action_cost(batch_action(F.col("message_type")), BATCH_ACTION_COST_MS)
    per = (collected.withColumn("_f", F.lit(False) if failed is None else F.coalesce(failed.cast("boolean"), F.lit(False)))
           .groupBy(*key, "message_type").agg(F.max(cost).alias("_cost"), F.bool_or("_f").alias("_f"))
           .groupBy(*key).agg(F.sum("_cost").alias("_cost"), F.bool_or("_f").alias("_f")))
    rows = collected.join(per, key)              # a batch has at most ``size`` messages
    done = rows.filter(~F.col("_f")).select(
        "benchmark_id", "message_id", F.lit(BATCH_QUEUE).alias("target_queue"),
        batch_action(F.col("message_type")).alias("action"), F.col("_cost").cast("double").alias("processing_time"),
        F.lit(BATCH_CONSUMER).alias("processed_by"), F.lit("processed").alias("status"),
        F.unix_millis(F.current_timestamp()).alias("processed_ms"), *key, "position", "flushed_by")
    bad = rows.filter("_f").select(
        F.lit(BATCH_QUEUE).alias("original_queue"), "benchmark_id", "message_id",
        F.lit("batch processing failed").alias("error"), F.lit("processing_error").alias("reason"),
        F.current_timestamp().alias("failed_at"), *key)
    return done, bad


def start_batch_consumer(queue_stream: DataFrame, out_dir: str, checkpoint: str, shards: int,
                         failed: Column | None = None, every: str = "1 second", **collector):
    """The batch consumer: collect (ST2), label and mark (``processed``), reject failed
    batches whole (``dead_letters``).  A batch is flushed within one micro-batch, whose
    outputs are published by one commit."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            done, bad = process_batches(batch, failed)
            CommitLog(batch.sparkSession, out_dir).commit(batch_id, {"processed": done, "dead_letters": bad})
        finally:
            batch.unpersist()
    return (collect_batches(queue_stream, shards=shards, **collector).writeStream.foreachBatch(run)
            .outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start())


def live_metrics_stream(history_stream: DataFrame, out_dir: str, checkpoint: str, every: str = "2 seconds",
                        rows: int = METRICS_WINDOW_ROWS, available_now: bool = False):
    """ST6: every trigger, the endpoint metrics (A15) over the newest ``rows`` history rows.

    The newest rows are a state that every micro-batch replaces: the state before and the
    batch's own rows (each task gives its newest) are all that a trigger reads, whatever
    the history's length.  Metrics (table ``metrics``) and state (``newest``) are published
    by one commit, so a replayed batch starts from the state it started from before."""
    def run(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(batch.sparkSession, out_dir)
        if log.committed(batch_id):
            return
        state = log.last("newest", before=batch_id)
        newest = recent_history(batch if state is None else state.unionByName(batch), rows)
        entries = log.write(batch_id, {"newest": newest})
        now = log.frame(entries["newest"])          # computed once
        log.publish(batch_id, entries | log.write(batch_id, {"metrics": live_metrics(now, rows)}))
    w = history_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()


def running_depth_stream(nets: DataFrame, out_dir: str, checkpoint: str, available_now: bool = False):
    """ST5 (stream form): the depth of every queue at the end of every closed sampling
    window, from the nets of ``depth_deltas_stream``.

    In append mode a window's net comes once, when the watermark has passed the window, so
    the windows of a micro-batch are all later than those before.  Each queue's depth is a
    state that every micro-batch replaces (one row a queue); a batch's own windows are
    summed in event-time order on top of it.  The depths (table ``depth``) and the state
    (``last``) are published by one commit."""
    def run(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(batch.sparkSession, out_dir)
        if log.committed(batch_id):
            return
        state = log.last("last", before=batch_id)
        own = depth_from_nets(batch)
        if state is not None:
            own = own.alias("o").join(state.alias("s"), F.col("o.target_queue").eqNullSafe(F.col("s.target_queue")), "left").select(
                "o.target_queue", "o.window_start", "o.window_end", "o.net",
                (F.col("o.depth") + F.coalesce("s.depth", F.lit(0))).alias("depth"))
        entries = log.write(batch_id, {"depth": own})
        ends = log.frame(entries["depth"]).select("target_queue", "window_start", "depth")
        if state is not None:
            ends = ends.unionByName(state)
        ends = ends.groupBy("target_queue").agg(F.max(F.struct("window_start", "depth")).alias("z")).select("target_queue", "z.*")
        log.publish(batch_id, entries | log.write(batch_id, {"last": ends}))
    w = nets.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def depth_deltas_stream(routed_stream: DataFrame, processed_stream: DataFrame,
                        every: str = "2 seconds", delay: str = "1 minute",
                        rejected_stream: DataFrame | None = None) -> DataFrame:
    """ST5 (stream form): net change of each queue per sampling window: +1 per
    routed message at its routing time, -1 per processed message at its
    processing time and -1 per dead letter in its original queue, +1 in the dead
    letters, at its failing time.  A consumer writes a message to its processed log or
    its dead letters, so none counts down twice.  A windowed aggregate with a watermark (bounded state,
    each closed window emitted once in append mode); the running depth is the
    ordered scan of these nets (``queues.depth_from_nets``), or ``running_depth_stream``."""
    add = routed_stream.select("target_queue", F.col("ts").cast("timestamp").alias("ets"),
                               F.lit(1).alias("delta"))
    done = processed_stream.select("target_queue", F.timestamp_millis("processed_ms").alias("ets"),
                                   F.lit(-1).alias("delta"))
    changes = add.unionByName(done)
    if rejected_stream is not None:
        changes = changes.unionByName(reject_deltas(rejected_stream))
    return (changes.withWatermark("ets", delay)
            .groupBy("target_queue", F.window("ets", every).alias("w"))
            .agg(F.sum("delta").alias("net"))
            .select("target_queue", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "net"))
