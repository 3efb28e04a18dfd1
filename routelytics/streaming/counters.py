"""Running counters of the consumers (A20): processed and rejected messages per consumer,
kept up to date by every micro-batch.

A message of the processed log counts once, however often a replay repeats its row: a
stateful deduplication by key lets it through once.  Every dead letter counts.  What a
micro-batch lets through is counted (partial sums per task) and added to the counters'
table, one row a consumer, in the batch's own commit, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.queues import KEY, consumer_of_letter
from ..sinks.commits import CommitLog


def count_stream(processed: DataFrame, letters: DataFrame) -> DataFrame:
    """(consumer, kind, key columns, own): one row per message or letter to be counted.
    A processed row without a message id is its own."""
    own = F.when(F.col("message_id").isNull(), F.expr("uuid()"))
    done = processed.select(F.col("processed_by").alias("consumer"), F.lit("processed").alias("kind"),
                            *[F.col(k).cast("string").alias(k) for k in KEY], own.alias("own"))
    bad = letters.select(consumer_of_letter().alias("consumer"), F.lit("rejected").alias("kind"),
                         *[F.lit(None).cast("string").alias(k) for k in KEY], F.expr("uuid()").alias("own"))
    return done.dropDuplicates(["consumer", *KEY, "own"]).unionByName(bad)


def running_counters(processed: DataFrame, letters: DataFrame, out_dir: str, checkpoint: str,
                     available_now: bool = False, every: str = "2 seconds"):
    """Start the counters; table ``counters`` (consumer, processed, rejected): the newest
    batch's rows are the state so far (``CommitLog.last``)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(batch.sparkSession, out_dir)
        if log.committed(batch_id):
            return
        changed = batch.groupBy("consumer").agg(
            F.count_if(F.col("kind") == "processed").alias("processed"), F.count_if(F.col("kind") == "rejected").alias("rejected"))
        before = log.last("counters", before=batch_id)
        rows = changed if before is None else changed.unionByName(before)
        log.commit(batch_id, {"counters": rows.groupBy("consumer").agg(
            F.sum("processed").alias("processed"), F.sum("rejected").alias("rejected"))})
    w = count_stream(processed, letters).writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
