"""Depth series with the rejected letters (ST5, T6): against SQL over the same tables,
against queue_stats, and as a stream."""

import duckdb
from pyspark.sql import functions as F

from conftest import SF001

import __spark_entry__ as E
from routelytics.operators import queues as Q
from routelytics.plans import catalog as C
from routelytics.session import scratch_path
from routelytics.streaming.consumers import depth_deltas_stream
from test_unclean_input import _done, _hist

SERIES = C._FEED_ALL + """, gone AS (SELECT key AS message_id, benchmark_id, epoch_us(ts) // 1000 AS ms FROM checked WHERE reason IS NOT NULL),
ev AS (
  SELECT target_queue, ts_ms AS ems, 1 AS delta FROM hist
  UNION ALL
  SELECT h.target_queue, p.processed_ms, -1 FROM processed p JOIN hist h USING (benchmark_id, message_id)
  WHERE p.message_id NOT IN (SELECT message_id FROM gone)
  UNION ALL SELECT h.target_queue, g.ms, -1 FROM gone g JOIN hist h USING (benchmark_id, message_id)
  UNION ALL SELECT 'dead.letter.queue', ms, 1 FROM gone),
per AS (SELECT target_queue, (ems // 2000) * 2000 AS window_start_ms, CAST(sum(delta) AS BIGINT) AS net FROM ev GROUP BY 1, 2)
SELECT target_queue, window_start_ms, net,
       CAST(sum(net) OVER (PARTITION BY target_queue ORDER BY window_start_ms) AS BIGINT) AS depth FROM per"""


def _expected():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF001}/events.parquet')")
    return sorted(c.sql(SERIES).fetchall())


def _ends(series):
    return {q: depth for q, _, _, depth in sorted(series)}  # the last of each queue stays


def test_registered_series_counts_rejects(spark):
    got = sorted(tuple(r) for r in E.queries()["queue_depth_series"](spark, SF001).collect())
    assert got == _expected()
    stats = E.queries()["queue_stats"](spark, SF001).first()
    assert stats.dlq_count > 0 and _ends(got) == {
        "urgent.queue": stats.urgent_count, "batch.queue": stats.batch_count, "dead.letter.queue": stats.dlq_count}


def test_registered_samples_have_dead_letter_depth(spark):
    got = sorted(tuple(r) for r in E.queries()["last_depth_samples"](spark, SF001).select(
        "window_start_ms", "urgent_depth", "batch_depth", "dlq_depth").collect())
    series = _expected()
    at = sorted({r[1] for r in series})[-30:]
    depth = lambda q, t: max(((r[1], r[3]) for r in series if r[0] == q and r[1] <= t), default=(0, 0))[1]
    assert got == [(t, depth("urgent.queue", t), depth("batch.queue", t), depth("dead.letter.queue", t)) for t in at]


BAD = "original_queue string, benchmark_id string, message_id string, ms long"


def _bad(spark, rows):
    return spark.createDataFrame(rows, BAD).withColumn("failed_at", F.timestamp_millis("ms")).drop("ms")


def test_a_reject_leaves_its_routed_queue_once(spark):
    h = _hist(spark).filter("message_id IS NOT NULL")
    done = _done(spark, [(None, "m2", "batch.queue", 20_000), ("b", "m1", "urgent.queue", 6000)])
    bad = _bad(spark, [("urgent.queue", None, "m2", 12_000), ("urgent.queue", None, "m2", 14_000),  # routed to batch, two letters
                       ("urgent.queue", None, None, 16_000), ("events", None, "never", 16_000), ("events", None, None, 16_000)])
    got = sorted((r.target_queue, r.window_start.second, r.depth) for r in Q.queue_depth_series(h, done, rejected=bad).collect())
    assert got == [("batch.queue", 10, 1), ("batch.queue", 12, 0), ("dead.letter.queue", 12, 1), ("dead.letter.queue", 14, 2),
                   ("dead.letter.queue", 16, 5), ("urgent.queue", 0, 2), ("urgent.queue", 6, 1), ("urgent.queue", 16, 0)]


def test_stream_counts_rejects(spark):
    h = _hist(spark).filter("message_id IS NOT NULL")
    tables = {"h": h, "p": _done(spark, [(None, "m1", "urgent.queue", 5000)]),
              "d": _bad(spark, [("urgent.queue", "b", "m1", 8000), ("events", None, "x", 8000), ("batch.queue", None, "m2", 900_000)])}
    streams = {}
    for k, t in tables.items():
        path = scratch_path(spark, f"t-dep-rej-{k}")
        t.write.parquet(path)
        streams[k] = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out, ck = scratch_path(spark, "t-dep-rej-out"), scratch_path(spark, "t-dep-rej-ck")
    for _ in range(2):
        depth_deltas_stream(streams["h"], streams["p"], rejected_stream=streams["d"]).writeStream.format("parquet") \
            .option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.target_queue, r.window_start.second, r.net) for r in spark.read.parquet(out).collect())
    assert got == [("batch.queue", 10, 1), ("dead.letter.queue", 8, 2), ("urgent.queue", 0, 2), ("urgent.queue", 4, -1),
                   ("urgent.queue", 8, -1)]
