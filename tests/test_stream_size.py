"""What a stream keeps and what its tasks are given as the input grows."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from conftest import SF001
from routelytics.plans import streaming_queries as S
from routelytics.plans.catalog import all_queries
from routelytics.session import ensure_checkpoint_dir, scratch_path
from routelytics.streaming.expiry import expire_stream


def test_expiry_keeps_state_by_bucket(spark):
    t0, n = dt.datetime(2024, 1, 1), 20_000
    at = F.lit(t0) + F.make_interval(secs=F.col("id") % 50)
    ids = spark.range(n).select(F.when(F.col("id") % 3 > 0, "b").alias("benchmark_id"), F.concat(F.lit("m"), "id").alias("message_id"), "id", at.alias("ts"))
    end = spark.sql("SELECT 'end' AS benchmark_id, 'end' AS message_id, TIMESTAMP'2024-01-02' AS ts")
    routed = ids.select("benchmark_id", "message_id", F.lit("urgent.queue").alias("target_queue"), "ts")
    # of ten messages one is settled within 10 s, one after 11 s, the others never
    done = ids.filter("id % 10 < 2").select("benchmark_id", "message_id", (F.unix_millis("ts") + 5000 + 6000 * (F.col("id") % 10)).alias("processed_ms"))
    rdir, pdir = scratch_path(spark, "t-size-r"), scratch_path(spark, "t-size-p")
    routed.write.parquet(f"{rdir}/1")
    done.write.parquet(f"{pdir}/1")
    end.select("benchmark_id", "message_id", F.lit("end").alias("target_queue"), "ts").write.parquet(f"{rdir}/2")
    end.select("benchmark_id", "message_id", F.unix_millis("ts").alias("processed_ms")).write.parquet(f"{pdir}/2")
    streams = [spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(d) for df, d in ((routed, rdir), (done, pdir))]
    sink = scratch_path(spark, "t-size-out")
    q = expire_stream(*streams).writeStream.format("parquet").option("path", sink).option(
        "checkpointLocation", scratch_path(spark, "t-size-ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # a value and a timer, kept both ways, for each bucket at most; not for each message
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < 15_000
    got = spark.read.parquet(sink)
    assert got.count() == got.select("benchmark_id", "message_id").distinct().count() == n * 9 // 10
    assert got.filter("benchmark_id IS NULL").count() == ids.filter("id % 10 > 0 AND benchmark_id IS NULL").count()
    want = ids.filter("id % 10 > 0").select("message_id", (F.col("ts") + F.expr("INTERVAL 10 SECONDS")).alias("failed_at"))
    assert got.select("message_id", "failed_at").exceptAll(want).isEmpty()


def test_raw_topic_grows_by_files_and_micro_batches(spark, monkeypatch):
    monkeypatch.setattr(S, "FILE_EVENTS", 100, raising=False)
    monkeypatch.setattr(S, "ROUTED_FILES", 2, raising=False)
    base = ensure_checkpoint_dir(spark)
    before = set(glob.glob(f"{base}/*"))
    got = {tuple(r) for r in all_queries()["stream_raw_route_counts"](spark, SF001).collect()}
    assert got == {tuple(r) for r in all_queries()["route_json_counts"](spark, SF001).collect()}
    made = set(glob.glob(f"{base}/*")) - before
    topic, = [p for p in made if "/raw-topic-" in p]
    out, = [p for p in made if "/stream-raw-" in p]
    per_file = spark.read.parquet(topic).groupBy(F.input_file_name()).count()
    assert per_file.agg(F.max("count"), F.sum("count")).first()[:] == (100, 1000)
    assert len(glob.glob(f"{out}/_commits/*.json")) == 5
