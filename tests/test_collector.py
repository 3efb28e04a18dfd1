"""ST2: the stateful collector flushes at 10 messages and after the idle
timeout (37 messages -> 10/10/10 by size, 7 by timeout)."""

import time

from routelytics.session import scratch_path
from routelytics.streaming.collector import collect_batches


def test_collector_size_and_timeout(spark):
    src = scratch_path(spark, "t-coll-src")
    spark.createDataFrame([(f"m{i:03d}", 1000 + i) for i in range(37)], "message_id string, ts_ms long") \
        .coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("message_id string, ts_ms long").parquet(src)
    out = collect_batches(stream, shards=1, size=10, timeout_ms=1500)
    name = "collector_out"
    q = (out.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", scratch_path(spark, "t-coll-ck"))
         .trigger(processingTime="500 milliseconds").start())
    try:
        deadline = time.time() + 90
        while time.time() < deadline:
            if spark.sql(f"select count(*) c from {name}").collect()[0].c >= 37:
                break
            time.sleep(1)
    finally:
        q.stop()
    rows = spark.sql(f"select batch_no, flushed_by, count(*) n from {name} group by 1, 2 order by 1").collect()
    assert [(r.flushed_by, r.n) for r in rows] == [("size", 10), ("size", 10), ("size", 10), ("timeout", 7)]


def test_collector_flushes_at_stop(spark):
    from routelytics.streaming.collector import stop_markers
    src = scratch_path(spark, "t-stop-src")
    schema = "shard string, message_id string, ts_ms long"
    spark.createDataFrame([(None, f"m{i:03d}", 1000 + i) for i in range(13)], schema) \
        .coalesce(1).write.parquet(f"{src}/a")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    out = collect_batches(stream, shards=1, size=10, timeout_ms=3_600_000)   # timer never fires
    name = "collector_stop"
    q = (out.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", scratch_path(spark, "t-stop-ck"))
         .trigger(processingTime="500 milliseconds").start())
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.sql(f"select count(*) c from {name}").collect()[0].c < 10:
            time.sleep(1)
        stop_markers(spark, 1).coalesce(1).write.parquet(f"{src}/b")
        while time.time() < deadline and spark.sql(f"select count(*) c from {name}").collect()[0].c < 13:
            time.sleep(1)
    finally:
        q.stop()
    rows = spark.sql(f"select flushed_by, count(*) n from {name} group by 1 order by 1").collect()
    assert [(r.flushed_by, r.n) for r in rows] == [("size", 10), ("stop", 3)]


def test_batch_consumer_marks_batches_and_rejects_failed_ones_whole(spark):
    from pyspark.sql import functions as F
    from routelytics.streaming.consumers import start_batch_consumer
    src, out = scratch_path(spark, "t-bc-src"), scratch_path(spark, "t-bc-out")
    schema = "benchmark_id string, message_id string, message_type string"
    types = ["report", "sensor", "log"]
    rows = [(None if i % 2 else "b", f"m{i:03d}", types[i % 3]) for i in range(25)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = start_batch_consumer(stream, out, scratch_path(spark, "t-bc-ck"), shards=1, size=10, timeout_ms=1500,
                             failed=F.col("message_id") == "m012", every="500 milliseconds")
    try:
        deadline = time.time() + 90
        done = []
        while time.time() < deadline and len(done) < 15:
            time.sleep(1)
            try:
                done = spark.read.parquet(f"{out}/processed").collect()
            except Exception:  # noqa: BLE001  (not written yet)
                continue
    finally:
        q.stop()
    bad = spark.read.parquet(f"{out}/dead_letters").collect()
    assert {r.message_id for r in bad} == {f"m{i:03d}" for i in range(10, 20)}
    assert {(r.benchmark_id, r.message_id) for r in done} == {r[:2] for i, r in enumerate(rows) if not 10 <= i < 20}
    assert {r.flushed_by for r in done if r.message_id >= "m020"} == {"timeout"}
    by = {}
    for r in done:
        by.setdefault(r.batch_no, set()).add(r.processing_time)
    assert all(len(v) == 1 for v in by.values())
