"""Queue views over the decision log: pending depth (A16), consumer counters
(A20), expiry to dead letters (ST4 batch form), depth time series (ST5, T6)
and the priority drain order (T7).

Queues are not a broker here: a message is pending in its queue from routing
until it is processed or rejected, so depth is ``routed - processed - rejected``
by key (anti joins, shuffled on the key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (BATCH_QUEUE, DEAD_LETTER_QUEUE, DEPTH_SAMPLE_EVERY, DEPTH_SAMPLES_KEPT,
                         TOPIC, URGENT_QUEUE)
from .history import same_key
from .routing import delivery_priority
from .scan import ordered_scan

KEY = ["benchmark_id", "message_id"]


def pending(routed: DataFrame, processed: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Messages still waiting in their queue."""
    p = _without(routed, processed)
    return p if rejected is None else _without(p, rejected)


def _without(routed: DataFrame, done: DataFrame) -> DataFrame:
    return routed.alias("r").join(done.select(*KEY).alias("d"), same_key("r", "d"), "left_anti")


def once(log: DataFrame) -> DataFrame:
    """One row per message of a processed log: a replayed batch repeats its rows.  The
    newest counts; a row without a message id is its own."""
    row = F.struct(*[F.col(c) for c in ("processed_ms", *sorted(c for c in log.columns if c != "processed_ms"))])
    own = F.when(F.col("message_id").isNull(), F.monotonically_increasing_id())
    return (log.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY], own.alias("_own"))
            .agg(F.max(row).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in log.columns]))


def queue_stats(routed: DataFrame, processed: DataFrame, dead_letters: DataFrame,
                rejected: DataFrame | None = None) -> DataFrame:
    """Urgent / batch depth, dead-letter count and total processed as one
    row; a queue with nothing pending reports 0."""
    # one aggregation over the three tagged inputs (no join of one-row results)
    kinds = (pending(routed, processed, rejected)
             .select(F.lit("pending").alias("_kind"), F.col("target_queue").alias("_q"))
             .unionByName(dead_letters.select(F.lit("dlq").alias("_kind"),
                                              F.lit(None).cast("string").alias("_q")))
             .unionByName(once(processed.filter(F.col("status") == "processed"))
                          .select(F.lit("done").alias("_kind"), F.lit(None).cast("string").alias("_q"))))
    k = F.col("_kind")
    return kinds.agg(
        F.count_if((k == "pending") & (F.col("_q") == URGENT_QUEUE)).alias("urgent_count"),
        F.count_if((k == "pending") & (F.col("_q") == BATCH_QUEUE)).alias("batch_count"),
        F.count_if(k == "dlq").alias("dlq_count"),
        F.count_if(k == "done").alias("total_processed"))


def consumer_of_letter(queue: str = "original_queue") -> Column:
    """The consumer that rejected a letter of a queue (the queue itself, if it is neither's)."""
    q = F.col(queue)
    return (F.when(q == URGENT_QUEUE, F.lit("urgent-consumer"))
            .when(q == BATCH_QUEUE, F.lit("batch-consumer")).otherwise(q))


def processed_counters(processed: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """Per consumer, messages processed and rejects sent to dead letters."""
    p = once(processed).groupBy(F.col("processed_by").alias("consumer")).agg(
        F.count(F.lit(1)).alias("processed"))
    r = dead_letters.groupBy(consumer_of_letter().alias("consumer")).agg(F.count(F.lit(1)).alias("rejected"))
    return (p.join(r, "consumer", "full")
             .select("consumer", F.coalesce("processed", F.lit(0)).alias("processed"),
                     F.coalesce("rejected", F.lit(0)).alias("rejected")))


def own_message(ts) -> Column:
    """What tells routed rows without a message id apart (NULL for the others)."""
    return F.when(F.col("message_id").isNull(), F.concat_ws("|", F.coalesce("target_queue", F.lit("")), F.unix_millis(ts)))


def expire_to_dead_letter(routed: DataFrame, processed: DataFrame, now_ms: int,
                          ttl_ms: int, rejected: DataFrame | None = None) -> DataFrame:
    """ST4 (batch form): messages neither processed nor rejected within ``ttl_ms`` of
    routing, as of ``now_ms``, become dead letters with reason 'expired' (as in the stream
    form): one letter a message, for its first routing.  Rows without their stamp are left
    out; a routed row without a message id is settled by nothing."""
    ts_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    first = (routed.filter(F.col("ts").isNotNull())
             .groupBy(*KEY, own_message(F.col("ts").cast("timestamp")).alias("_own"))
             .agg(F.min(F.struct(ts_ms.alias("ms"), "target_queue")).alias("_r"))
             .select(*KEY, F.col("_r.ms").alias("routed_ms"), F.col("_r.target_queue").alias("target_queue")))
    late = first.filter(F.col("routed_ms") < F.lit(now_ms - ttl_ms))
    settled = processed.select(*KEY, F.col("processed_ms").alias("settled_ms"))
    if rejected is not None:
        settled = settled.unionByName(rejected.select(*KEY, F.unix_millis(F.col("failed_at").cast("timestamp")).alias("settled_ms")))
    settled = settled.filter(F.col("message_id").isNotNull())
    # a message settled only after its time was up had expired before
    exp = late.alias("r").join(settled.alias("d"), same_key("r", "d") & (
        F.col("d.settled_ms") <= F.col("r.routed_ms") + F.lit(ttl_ms)), "left_anti")
    return exp.select(
        F.col("target_queue").alias("original_queue"), "benchmark_id", "message_id",
        F.lit("message expired").alias("error"), F.lit("expired").alias("reason"),
        F.timestamp_millis(F.col("routed_ms") + F.lit(ttl_ms)).alias("failed_at"))


def depth_events(routed: DataFrame, processed: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """+1 when routed, -1 when processed or rejected (``rejected``: original_queue,
    failed_at and, if known, the key), which is +1 for the dead letters: (queue, event
    time, delta).  A rejected message leaves the queue it was routed to, at its first
    letter, and not once more when it is also in the processed log."""
    ev = routed.select("target_queue", F.col("ts").alias("ets"), F.lit(1).alias("delta"))
    if rejected is not None:
        unkeyed = rejected
        if set(KEY) <= set(rejected.columns):
            unkeyed = rejected.filter("message_id IS NULL")
            first = rejected.filter("message_id IS NOT NULL").groupBy(*KEY).agg(F.min("failed_at").alias("ets"))
            processed = _without(processed, first)
            ev = ev.unionByName(routed.alias("r").join(first.alias("d"), same_key("r", "d"))
                                .select("r.target_queue", "d.ets", F.lit(-1).alias("delta")))
        ev = ev.unionByName(reject_deltas(unkeyed).filter(F.col("delta") < 0))
        ev = ev.unionByName(reject_deltas(rejected).filter(F.col("delta") > 0))
    return ev.unionByName(once(processed).select(
        "target_queue", F.timestamp_millis("processed_ms").alias("ets"), F.lit(-1).alias("delta")))


def reject_deltas(rejected: DataFrame) -> DataFrame:
    """-1 for the queue a letter names (none if it was rejected before routing) and +1
    for the dead letters."""
    r = rejected.select(F.col("original_queue").alias("_from"), F.col("failed_at").alias("ets"))
    both = F.array(F.struct(F.col("_from").alias("target_queue"), F.lit(-1).alias("delta")),
                   F.struct(F.lit(DEAD_LETTER_QUEUE).alias("target_queue"), F.lit(1).alias("delta")))
    return r.select("ets", F.inline(both)).select("target_queue", "ets", "delta").filter(
        F.col("target_queue") != TOPIC)


def queue_depth_series(routed: DataFrame, processed: DataFrame, every: str = DEPTH_SAMPLE_EVERY,
                       rejected: DataFrame | None = None) -> DataFrame:
    """ST5 (batch form): depth per queue at the end of every sampling window.
    Deltas are pre-aggregated per (queue, window) with map-side combine; the
    running depth is a distributed ordered scan over the windows of a queue."""
    ev = depth_events(routed, processed, rejected)
    per = (ev.groupBy("target_queue", F.window("ets", every).alias("w"))
           .agg(F.sum("delta").alias("net"))
           .select("target_queue", F.col("w.start").alias("window_start"),
                   F.col("w.end").alias("window_end"), "net"))
    return depth_from_nets(per)


def depth_from_nets(per: DataFrame) -> DataFrame:
    """Running depth per queue over (target_queue, window_start, window_end, net)
    rows — the batch series above, or the nets a depth stream wrote."""
    per = per.withColumn("_wms", F.unix_millis("window_start"))
    s = ordered_scan(per, ["target_queue"], ["_wms"], sums=["net"], pos_col="_p")
    return s.select("target_queue", "window_start", "window_end", "net",
                    F.col("cum_net").alias("depth"))


def last_depth_samples(series: DataFrame, n: int = DEPTH_SAMPLES_KEPT) -> DataFrame:
    """The newest ``n`` samples, one row per window in which any queue changed, with
    the depth of the urgent, batch and dead-letter queues side by side.  A queue that
    did not change in a window has the depth of its last change before (0 if none)."""
    queues = {"urgent_depth": URGENT_QUEUE, "batch_depth": BATCH_QUEUE, "dlq_depth": DEAD_LETTER_QUEUE}
    wide = series.groupBy("window_start").agg(*[
        F.max(F.when(F.col("target_queue") == q, F.col("depth"))).alias(c) for c, q in queues.items()])
    newest = wide.orderBy(F.col("window_start").desc()).limit(n)
    # what was before the oldest sample: one row per queue
    first = newest.agg(F.min("window_start").alias("_first"))
    prior = series.join(F.broadcast(first), F.col("window_start") < F.col("_first")).groupBy().agg(*[
        F.max_by(F.when(F.col("target_queue") == q, F.col("depth")),
                 F.when(F.col("target_queue") == q, F.col("window_start"))).alias(f"_{c}") for c, q in queues.items()])
    w = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # n rows
    rows = newest.join(F.broadcast(prior), F.lit(True))  # one row of three numbers
    return rows.select("window_start", *[
        F.coalesce(F.last(c, True).over(w), F.col(f"_{c}"), F.lit(0)).alias(c) for c in queues])


def priority_drain(routed: DataFrame) -> DataFrame:
    """The order a priority broker delivers: urgent (10) before batch (1),
    FIFO within a queue, message id breaking ties.  A global sort (range
    partitioned), no single-task window."""
    return (routed.withColumn("delivery_priority", delivery_priority(F.col("target_queue")))
            .orderBy(F.col("delivery_priority").desc(), F.col("ts"), F.col("message_id")))


def drain_positions(routed: DataFrame) -> DataFrame:
    """T7 with ``position``: each message's place (from 1) in the order of
    ``priority_drain``, by a distributed ordered scan (ties by cohort, missing ones first)."""
    rows = routed.withColumn("_rank", -delivery_priority(F.col("target_queue"))).withColumn("_all", F.lit(0))
    return ordered_scan(rows, ["_all"], ["_rank", "ts", "message_id", "benchmark_id"], pos_col="position").drop("_rank", "_all")
