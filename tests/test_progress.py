"""A24 live: the listener's table against the batch report; A20 running: counters after
every batch and after a replay."""

import time

from pyspark.sql import functions as F

from conftest import SF001
from routelytics.operators.metrics import send_progress
from routelytics.operators.queues import processed_counters
from routelytics.plans import dirty
from routelytics.plans import fixture as FX
from routelytics.session import scratch_path
from routelytics.sinks.commits import CommitLog
from routelytics.streaming.counters import running_counters
from routelytics.streaming.progress import ProgressTable, batch_latency, live_progress, read_progress


def test_live_progress_totals_equal_the_batch_report(spark):
    h = FX.history(spark, SF001).filter("benchmark_id = 'bench-0'")
    src, out, root = (scratch_path(spark, f"t-prog-{k}") for k in ("src", "out", "log"))
    h.repartition(4).write.parquet(src)
    listener = ProgressTable(spark, root, only={"sender"})
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = (stream.writeStream.queryName("sender").format("parquet").option("path", out).option("checkpointLocation", f"{out}-ck")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        deadline = time.time() + 60
        while time.time() < deadline and read_progress(spark, root, "sender").count() < 4:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    p = read_progress(spark, root, "sender")
    live = live_progress(p).orderBy("batch_no").collect()
    assert len(live) == 4 and all(a.sent < b.sent and a.elapsed_s <= b.elapsed_s for a, b in zip(live, live[1:]))
    assert live[-1].sent == send_progress(h).agg(F.max("sent")).first()[0] == h.count()
    lat = batch_latency(p).first()
    assert (lat.batches, lat.rows) == (4, h.count()) and 0 < lat.p50_ms <= lat.p95_ms <= lat.p99_ms
    assert lat.p99_ms == max(r.latency_ms for r in live)


def test_counters_after_every_batch_and_after_a_replay(spark):
    done = dirty.processed(spark, SF001).withColumn("part", F.pmod(F.xxhash64("message_id", "processed_ms"), F.lit(3)))
    bad = dirty.rejected(spark, SF001).withColumn("part", F.pmod(F.xxhash64("message_id", "failed_at"), F.lit(3)))
    where = {k: scratch_path(spark, f"t-count-{k}") for k in ("done", "bad", "out", "ck")}
    key = lambda df: sorted((r.consumer, r.processed, r.rejected) for r in df.collect())
    for i in range(4):  # the last step repeats the first one's rows under new files: a replay
        for k, df in (("done", done), ("bad", bad)):
            rows = df.filter(F.col("part") == i % 3).drop("part")
            (rows if i < 3 or k == "done" else rows.limit(0)).coalesce(1).write.parquet(f"{where[k]}/{i}")
        streams = [spark.readStream.schema(df.drop("part").schema).option("recursiveFileLookup", "true").parquet(where[k])
                   for k, df in (("done", done), ("bad", bad))]
        running_counters(*streams, where["out"], where["ck"], available_now=True).awaitTermination()
        want = processed_counters(done.filter(F.col("part") <= i).drop("part"), bad.filter(F.col("part") <= i).drop("part"))
        assert key(CommitLog(spark, where["out"]).last("counters")) == key(want)
