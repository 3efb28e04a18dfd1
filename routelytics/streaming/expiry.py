"""ST4 (stream form): routed messages that are neither processed nor rejected within
``ttl`` of routing become dead letters with reason 'expired'.

One stateful operator (``transformWithState``) over buckets of messages: a bucket's state
holds, for each of its open messages, when and where it was routed first and when it was
settled first; one event-time timer fires when the watermark passes the bucket's earliest
deadline.  A state call costs a round trip to the JVM, so a micro-batch makes a few for
each bucket it meets, not for each message, and reads and writes the bucket's open
messages.  A missing cohort is a cohort.  Rows may come in any order within the
watermark's delay; a replayed row finds its message, or comes after the watermark and is
dropped with all late rows.  A message leaves the state when its deadline has passed.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.queues import KEY, own_message

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets that the messages are dealt over, by hash of their key.
BUCKETS = 4096


class Expiry(StatefulProcessor):
    """One bucket: its open messages by key, each with first routing, queue and first
    settling; one timer."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", ", ".join(
            f"{c} array<{t}>" for c, t in (("benchmark_id", "string"), ("message_id", "string"), ("own", "string"),
                                           ("routed_ms", "long"), ("queue", "string"), ("settled_ms", "long"))) + ", timer long")

    def _deadline(self, routed: int | None, settled: int | None) -> int:
        # a message settled before its routing is seen is kept until that would be late
        return settled + 1 if routed is None else routed + self.ttl_ms

    def _load(self) -> tuple[dict, int | None]:
        cohorts, ids, own, routed, queue, settled, timer = self.bucket.get() or ([], [], [], [], [], [], None)
        return dict(zip(zip(cohorts, ids, own), zip(routed, queue, settled))), timer

    def _store(self, messages: dict, timer: int | None) -> None:
        """Keep the messages; the timer stands at their earliest deadline."""
        first = min((self._deadline(routed, settled) for routed, _, settled in messages.values()), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.bucket.clear()
            return
        self.bucket.update((*map(list, zip(*messages)), *map(list, zip(*messages.values())), first))
        if first != timer:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        messages, timer = self._load()
        none = (None, None, None)
        for _, cohort, message, own, target_queue, is_routed, _, at_ms in rows:
            routed, queue, settled = messages.get((cohort, message, own), none)
            if not is_routed:
                settled = at_ms if settled is None else min(settled, at_ms)
            elif routed is None or (at_ms, target_queue or "") < (routed, queue or ""):
                routed, queue = at_ms, target_queue
            messages[cohort, message, own] = routed, queue, settled
        self._store(messages, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        messages, _ = self._load()
        now, kept, letters = timerValues.getCurrentWatermarkInMs(), {}, []
        for (cohort, message, own), (routed, queue, settled) in messages.items():
            if self._deadline(routed, settled) > now:
                kept[cohort, message, own] = routed, queue, settled
            elif routed is not None and (settled is None or settled > routed + self.ttl_ms):
                letters.append(Row(original_queue=queue, benchmark_id=cohort, message_id=message, failed_ms=routed + self.ttl_ms))
        self._store(kept, None)  # the timer that fired goes by itself
        return iter(letters)

    def close(self) -> None:
        pass


def expire_stream(routed: DataFrame, processed: DataFrame, ttl: str = "10 seconds",
                  delay: str = "1 minute", rejected: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``routed``: (benchmark_id, message_id, target_queue, ts TIMESTAMP); ``processed``:
    (benchmark_id, message_id, processed_ms); ``rejected``: (benchmark_id, message_id,
    failed_at).  Each stream has the watermark ``delay``; the slowest one counts.  Rows
    without their stamp are left out, and so are settled rows without a message id; routed
    rows without one are told apart by queue and stamp.  ``buckets`` is fixed for the life
    of a checkpoint; a task holds the open messages of one bucket at a time."""
    spark = routed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    ttl_ms = int(spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {ttl}) AS LONG)").first()[0])
    key = [F.col(k).cast("string").alias(k) for k in KEY]

    def tagged(df: DataFrame, at, is_routed: bool, queue, own) -> DataFrame:
        rows = df.select(*key, own.alias("own"), queue.alias("target_queue"), F.lit(is_routed).alias("is_routed"), at.alias("at"))
        return rows.filter(F.col("at").isNotNull()).withWatermark("at", delay)

    none = F.lit(None).cast("string")
    rows = tagged(routed, F.col("ts").cast("timestamp"), True, F.col("target_queue"), own_message(F.col("ts").cast("timestamp")))
    for df, at in ((processed, F.timestamp_millis("processed_ms")), (rejected, F.col("failed_at"))):
        if df is not None:
            at = at if df is processed else at.cast("timestamp")
            rows = rows.unionByName(tagged(df.filter("message_id IS NOT NULL"), at, False, none, none))
    bucket = F.pmod(F.xxhash64(*KEY, "own"), F.lit(buckets)).cast("int").alias("bucket")
    # the processor takes the columns by place
    rows = rows.select(bucket, *KEY, "own", "target_queue", "is_routed", "at", F.unix_millis("at").alias("at_ms"))
    out = rows.groupBy("bucket").transformWithState(
        statefulProcessor=Expiry(ttl_ms), outputStructType="original_queue string, benchmark_id string, message_id string, failed_ms long",
        outputMode="Append", timeMode="EventTime")
    return out.select("original_queue", *KEY, F.lit("message expired").alias("error"), F.lit("expired").alias("reason"),
                      F.timestamp_millis("failed_ms").alias("failed_at"))
