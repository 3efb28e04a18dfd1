"""Registered streaming queries: the router and the urgent consumer run as
Structured Streaming queries (``availableNow``) over the ``events`` file; the
result tables they write are read back and must equal the batch results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from ..sinks.commits import CommitLog, read_committed
from ..sources.messages import message_columns, read_table, stream_path, table_path
from ..sources.seed import SEED_RULES
from ..streaming.consumers import depth_deltas_stream, live_metrics_stream, running_depth_stream, start_urgent_consumer
from ..streaming.counters import running_counters
from ..streaming.expiry import expire_stream
from ..streaming.router import route_stream
from . import dirty
from . import fixture as FX
from .catalog import EXPIRY_NOW_MS, EXPIRY_TTL_MS, ORACLE, query


#: Events whose rows make a file of a derived topic, micro-batches a topic is read in at
#: least, and files a router's micro-batch, which is cached, takes at most.
FILE_EVENTS, BATCHES, ROUTED_FILES = 100_000, 3, 48


def _topic(spark: SparkSession, sf: str, df: DataFrame, path: str) -> tuple[StructType, int]:
    """Write ``df``, rows derived from ``events``, as files; their schema and number, which
    grows with the events, so that no task is given more rows of larger tables."""
    files = max(BATCHES, -(-read_table(spark, sf, "events").count() // FILE_EVENTS))
    df.repartition(files).write.parquet(path)
    return df.schema, files


def _topic_stream(spark: SparkSession, sf: str, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """A stream of ``df`` in ``BATCHES`` micro-batches, or more where one would take over ``most`` files."""
    path = scratch_path(spark, name)
    schema, files = _topic(spark, sf, df, path)
    each = -(-files // BATCHES)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", min(each, most or each)).parquet(path)


def _run_router(spark: SparkSession, sf: str) -> str:
    path = table_path(sf, "events")
    schema = spark.read.parquet(path).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(stream_path(path)))
    out = scratch_path(spark, "stream-route")
    q = route_stream(stream, lambda: SEED_RULES, out, f"{out}/_checkpoint",
                     prepare=message_columns, available_now=True)
    q.awaitTermination()
    return out


@query("stream_route_counts", ORACLE["route_queue_counts"])
def stream_route_counts(spark, sf) -> DataFrame:
    """ST1 / S1 / S2 / K1 / K3: the streaming router's queue table, per queue."""
    out = _run_router(spark, sf)
    return (read_committed(spark, out, "routed").groupBy("target_queue")
            .agg(F.count(F.lit(1)).alias("n")))


@query("stream_raw_route_counts", ORACLE["route_json_counts"])
def stream_raw_route_counts(spark, sf) -> DataFrame:
    """ST1 on raw text, over several micro-batches: rules see the JSON values, as in the
    batch form."""
    out = scratch_path(spark, "stream-raw")
    stream = _topic_stream(spark, sf, FX.raw_feed(spark, sf).select("key", "value"), "raw-topic", ROUTED_FILES)
    route_stream(stream, lambda: SEED_RULES, out, f"{out}/_checkpoint", raw=True, available_now=True).awaitTermination()
    return (read_committed(spark, out, "routed").groupBy("target_queue", "matched_priority")
            .agg(F.count(F.lit(1)).alias("n")))


@query("stream_history_rows", ORACLE["history_rows"])
def stream_history_rows(spark, sf) -> DataFrame:
    """ST1 + K3: the history the streaming router appended equals the batch one."""
    out = _run_router(spark, sf)
    from .catalog import _HIST_COLS
    # the stream's own columns are the routing time and latency; ts_ms is the message's stamp
    return read_committed(spark, out, "history").select(*_HIST_COLS)


@query("stream_urgent_actions", ORACLE["urgent_actions"])
def stream_urgent_actions(spark, sf) -> DataFrame:
    """ST3: the urgent consumer as a second stream over the router's output."""
    out = _run_router(spark, sf)
    routed_path = f"{out}/routed"
    schema = spark.read.parquet(routed_path).schema
    rs = spark.readStream.schema(schema).parquet(routed_path)
    proc = scratch_path(spark, "stream-urgent")
    q = start_urgent_consumer(rs, f"{proc}/processed", f"{proc}/_checkpoint", available_now=True)
    q.awaitTermination()
    p = spark.read.parquet(f"{proc}/processed")
    return p.groupBy("action").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum("processing_time").cast("long").alias("cost_ms"))


#: A watermark delay longer than the log, so that its files may come in any order, and the
#: stamp of the rows that end each stream: the watermark then stands at the report's "now".
DELAY_MS = 40 * 86_400_000


def _ended(spark: SparkSession, sf: str, df: DataFrame, name: str, end: dict) -> DataFrame:
    """A stream of ``df`` and one last file with a row that ends it, in two micro-batches."""
    path = scratch_path(spark, name)
    schema, files = _topic(spark, sf, df, f"{path}/rows")
    last = spark.range(1).select(*[F.lit(end.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
    last.write.parquet(f"{path}/zz-end")
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", -(-(files + 1) // 2)).parquet(path))


def _end_rows() -> dict:
    from datetime import datetime, timezone
    at = EXPIRY_NOW_MS + DELAY_MS
    stamp = datetime.fromtimestamp(at / 1000, timezone.utc)
    return {"benchmark_id": "end", "message_id": "end", "target_queue": "end", "original_queue": "end",
            "ts": stamp, "failed_at": stamp, "processed_ms": at}


@query("stream_expired", ORACLE["expired_messages_dirty"])
def stream_expired(spark, sf) -> DataFrame:
    """ST4: expiry by event-time timers over the dirty log's three streams, as of the
    report's "now": equals the batch form."""
    end, key = _end_rows(), ["benchmark_id", "message_id"]
    routed = _ended(spark, sf, dirty.history(spark, sf).select(*key, "target_queue", "ts"), "exp-routed", end)
    done = _ended(spark, sf, dirty.processed(spark, sf).select(*key, "processed_ms"), "exp-processed", end)
    bad = _ended(spark, sf, dirty.rejected(spark, sf).select(*key, "failed_at"), "exp-rejected", end)
    out = scratch_path(spark, "stream-expired")
    letters = expire_stream(routed, done, f"{EXPIRY_TTL_MS // 1000} seconds", f"{DELAY_MS // 1000} seconds", rejected=bad)
    (letters.writeStream.format("parquet").option("path", f"{out}/letters").option("checkpointLocation", f"{out}/_checkpoint")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(letters.schema).parquet(f"{out}/letters").filter(F.col("message_id") != "end").select(
        "original_queue", "benchmark_id", "message_id", "reason", F.unix_millis("failed_at").alias("failed_ms"))


@query("stream_live_metrics", ORACLE["live_metrics"])
def stream_live_metrics(spark, sf) -> DataFrame:
    """ST6: the metrics after the last micro-batch equal the endpoint's over the whole history."""
    out = scratch_path(spark, "stream-live")
    stream = _topic_stream(spark, sf, FX.history(spark, sf), "live-history")
    live_metrics_stream(stream, out, f"{out}/_checkpoint", available_now=True).awaitTermination()
    return CommitLog(spark, out).last("metrics")


@query("stream_queue_depth", ORACLE["queue_depth_series"])
def stream_queue_depth(spark, sf) -> DataFrame:
    """ST5: the running depth that the stream emits, rejects included, equals the batch series."""
    end, key = _end_rows(), ["benchmark_id", "message_id"]
    h, bad = FX.history(spark, sf), FX.rejected_letters(spark, sf).select(*key, "failed_at")
    # the consumers' logs: a message is processed or rejected, by the consumer of its queue
    done = FX.processed(spark, sf).join(bad.select(*key), key, "left_anti").select(*key, "target_queue", "processed_ms")
    bad = bad.join(h.select(*key, F.col("target_queue").alias("original_queue")), key)
    streams = [_ended(spark, sf, df, f"depth-{i}", end) for i, df in enumerate((h.select(*key, "target_queue", "ts"), done, bad))]
    out = scratch_path(spark, "stream-depth")
    nets = depth_deltas_stream(*streams[:2], delay=f"{DELAY_MS // 1000} seconds", rejected_stream=streams[2])
    running_depth_stream(nets, out, f"{out}/_checkpoint", available_now=True).awaitTermination()
    return read_committed(spark, out, "depth").filter(F.col("target_queue") != "end").select(
        "target_queue", F.unix_millis("window_start").alias("window_start_ms"),
        F.col("net").cast("long").alias("net"), F.col("depth").cast("long").alias("depth"))


@query("stream_counters", ORACLE["processed_counters_dirty"])
def stream_counters(spark, sf) -> DataFrame:
    """The running counters after the last micro-batch of the dirty logs."""
    tables = {"processed": dirty.processed(spark, sf), "letters": dirty.rejected(spark, sf)}
    streams = [_topic_stream(spark, sf, df, f"counters-{name}") for name, df in tables.items()]
    out = scratch_path(spark, "stream-counters")
    running_counters(*streams, out, f"{out}/_checkpoint", available_now=True).awaitTermination()
    return CommitLog(spark, out).last("counters")
