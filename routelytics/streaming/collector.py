"""ST2: the batch consumer's collector as a stateful streaming operator.

A batch is flushed when it holds ``size`` messages, or ``timeout_ms`` after the
*last* arrival (the timer restarts on every message).  State per collector key
is the pending list (at most ``size - 1`` messages) plus a batch counter, in
the state store (RocksDB provider), with one processing-time timer.

Shutdown ("flush the rest at stop") arrives as a control row: a row with a
NULL ``message_id`` makes its collector flush what it holds at once
(``flushed_by='stop'``); ``stop_markers`` builds one per collector.

Collectors are keyed by a ``shard`` column: one shard reproduces the single
collector of the source system; hashing messages over many shards gives many
independent collectors, so no single task carries the whole queue.  The
event-time replay of the same rule is ``operators.processing.assign_chunks``.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (StatefulProcessor,
                                                      StatefulProcessorHandle)
from pyspark.sql.types import (IntegerType, LongType, StringType, StructField,
                               StructType)

from ..constants import BATCH_SIZE, BATCH_TIMEOUT_MS

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What the collector keeps of a message and hands on: its key and its type.
CARRIED = ["benchmark_id", "message_id", "message_type"]
OUTPUT = StructType([
    StructField("shard", StringType()),
    StructField("batch_no", LongType()),
    *[StructField(c, StringType()) for c in CARRIED],
    StructField("position", IntegerType()),
    StructField("flushed_by", StringType()),
])
_PENDING = StructType([StructField(c, StringType()) for c in CARRIED])
_COUNTER = StructType([StructField("n", LongType())])


class BatchCollector(StatefulProcessor):
    """Count-or-idle-timeout batching of one collector key."""

    def __init__(self, size: int = BATCH_SIZE, timeout_ms: int = BATCH_TIMEOUT_MS):
        self.size = size
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.counter = handle.getValueState("batches", _COUNTER)

    def _next_batch_no(self) -> int:
        cur = self.counter.get()
        n = (cur[0] if cur else 0) + 1
        self.counter.update((n,))
        return n

    def _flush(self, shard: str, items: list, how: str) -> pd.DataFrame:
        no = self._next_batch_no()
        return pd.DataFrame({"shard": [shard] * len(items), "batch_no": [no] * len(items),
                             **{c: [x[i] for x in items] for i, c in enumerate(CARRIED)},
                             "position": list(range(1, len(items) + 1)),
                             "flushed_by": [how] * len(items)})

    def _reset_timer(self, now_ms: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now_ms + self.timeout_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shard = key[0]
        items = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        for chunk in rows:                       # as they arrive; never the whole micro-batch at once
            out = []
            for row in chunk[CARRIED].astype(object).where(chunk[CARRIED].notna(), None).itertuples(index=False):
                if row.message_id is None:                               # stop marker
                    if items:
                        out.append(self._flush(shard, items, "stop"))
                        items = []
                    continue
                items.append(tuple(row))
                if len(items) >= self.size:
                    out.append(self._flush(shard, items, "size"))
                    items = []
            if out:
                yield pd.concat(out, ignore_index=True)
        self.pending.clear()
        if items:
            self.pending.put(items)
            self._reset_timer(timerValues.getCurrentProcessingTimeInMs())
        else:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            items = [tuple(x) for x in self.pending.get()]
            self.pending.clear()
            if items:
                yield self._flush(key[0], items, "timeout")

    def close(self) -> None:
        pass


def stop_markers(spark, shards: int):
    """One stop marker per collector (shards 0..n-1 as keyed by
    ``collect_batches`` without an explicit shard column)."""
    return spark.createDataFrame([(str(i), None, None) for i in range(shards)],
                                 "shard string, message_id string, ts_ms long")


def collect_batches(stream: DataFrame, shard: str | None = None, size: int = BATCH_SIZE,
                    timeout_ms: int = BATCH_TIMEOUT_MS, shards: int | None = None) -> DataFrame:
    """Apply the collector to a stream of messages (message_id; benchmark_id and
    message_type where it has them).  ``shard`` names the collector key column; without
    it ``shards`` must be given: messages are spread over that many collectors by a hash
    of the id (1 is the source system's single collector).  The number is part of the
    query's state, so it is no session setting."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB_PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    if shard is None:
        if not shards:
            raise ValueError("name a shard column or the number of collectors")
        own = F.pmod(F.xxhash64("message_id"), F.lit(shards)).cast("string")
        # stop markers carry their collector
        stream = stream.withColumn("_shard", F.coalesce(F.col("shard"), own) if "shard" in stream.columns else own)
        shard = "_shard"
    have = set(stream.columns)
    keyed = stream.select(F.col(shard).cast("string").alias("shard"), *[
        (F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in CARRIED])
    return keyed.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=BatchCollector(size, timeout_ms), outputStructType=OUTPUT,
        outputMode="Append", timeMode="ProcessingTime")
