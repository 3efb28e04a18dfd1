"""A log as it really comes, derived from ``events``: missing cohorts, replayed routing
and processing, equal stamps, latencies that are NaN or negative, rejected messages with
one letter or two.  The queue and history queries run on it against their DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import metrics as M
from ..operators import queues as Q
from . import fixture as FX
from . import oracle as O
from .catalog import EXPIRY_NOW_MS, EXPIRY_TTL_MS, query

N = "CAST(substr(message_id, 5) AS BIGINT)"


def history(spark: SparkSession, sf: str) -> DataFrame:
    """The decision log; every 17th message was routed twice, 5 s apart."""
    h = FX.history(spark, sf).withColumn("n", F.expr(N))
    h = h.withColumn("ts_ms", F.expr("CASE WHEN n % 19 = 0 THEN ts_ms - ts_ms % 60000 ELSE ts_ms END"))
    h = h.withColumn("benchmark_id", F.expr("CASE WHEN n % 11 = 0 THEN NULL ELSE benchmark_id END"))
    h = h.withColumn("latency_ms", F.expr(
        "CASE WHEN n % 23 = 0 THEN CAST('NaN' AS DOUBLE) WHEN n % 29 = 0 THEN -1D ELSE latency_ms END"))
    again = h.filter("n % 17 = 0").withColumn("ts_ms", F.col("ts_ms") + 5000)
    return h.unionByName(again).withColumn("ts", F.timestamp_millis("ts_ms"))


def processed(spark: SparkSession, sf: str) -> DataFrame:
    """The processed log; every 7th message is in it twice, 1 s apart."""
    first = history(spark, sf).filter("processed_ms IS NOT NULL").groupBy(
        "benchmark_id", "message_id", "target_queue", "processed_ms", "n").agg(F.count(F.lit(1)).alias("_c")).drop("_c")
    log = first.unionByName(first.filter("n % 7 = 0").withColumn("processed_ms", F.col("processed_ms") + 1000))
    return log.select("benchmark_id", "message_id", "target_queue", "processed_ms", H.consumer_of(F.col("target_queue")).alias("processed_by"),
                      F.lit(50.0).alias("processing_time"), F.lit("processed").alias("status"))


def rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Dead letters: every 31st message, every 62nd with two letters."""
    h = history(spark, sf).filter("n % 31 = 0").groupBy("benchmark_id", "message_id", "target_queue", "n").agg(F.min("ts_ms").alias("ms"))
    h = h.select("*", F.explode(F.expr("CASE WHEN n % 62 = 0 THEN array(500L, 2500L) ELSE array(500L) END")).alias("after"))
    return h.select(F.col("target_queue").alias("original_queue"), "benchmark_id", "message_id", F.lit("rejected").alias("error"),
                    F.lit("processing_error").alias("reason"), F.timestamp_millis(F.col("ms") + F.col("after")).alias("failed_at"))


_SQL = O.base() + f""", once AS (
  SELECT message_id, target_queue, n, is_critical, processed_ms,
         CASE WHEN n % 11 = 0 THEN NULL ELSE benchmark_id END AS benchmark_id,
         CASE WHEN n % 19 = 0 THEN ts_ms - ts_ms % 60000 ELSE ts_ms END AS ts_ms,
         CASE WHEN n % 23 = 0 THEN 'NaN'::DOUBLE WHEN n % 29 = 0 THEN -1 ELSE latency_ms END AS latency_ms
  FROM (SELECT *, {N} AS n FROM hist)),
log AS (SELECT * FROM once UNION ALL SELECT * REPLACE (ts_ms + 5000 AS ts_ms) FROM once WHERE n % 17 = 0),
done AS (
  SELECT benchmark_id, message_id, target_queue, n, processed_ms FROM once WHERE processed_ms IS NOT NULL
  UNION ALL SELECT benchmark_id, message_id, target_queue, n, processed_ms + 1000 FROM once WHERE processed_ms IS NOT NULL AND n % 7 = 0),
bad AS (
  SELECT benchmark_id, message_id, target_queue, ts_ms + 500 AS ms FROM once WHERE n % 31 = 0
  UNION ALL SELECT benchmark_id, message_id, target_queue, ts_ms + 2500 FROM once WHERE n % 62 = 0),
settled AS (
  SELECT benchmark_id, message_id, min(processed_ms) AS first_done, max(processed_ms) AS last_done, NULL::BIGINT AS first_bad FROM done GROUP BY 1, 2
  UNION ALL SELECT benchmark_id, message_id, NULL, NULL, min(ms) FROM bad GROUP BY 1, 2),
state AS (SELECT benchmark_id, message_id, max(first_done) AS first_done, max(last_done) AS last_done, max(first_bad) AS first_bad
          FROM settled GROUP BY 1, 2),
j AS (
  SELECT l.*, s.first_done, s.last_done, s.first_bad FROM log l
  LEFT JOIN state s ON s.message_id = l.message_id AND s.benchmark_id IS NOT DISTINCT FROM l.benchmark_id)
"""

_EXPIRED = _SQL + f"""
SELECT any_value(target_queue) AS original_queue, benchmark_id, message_id, 'expired' AS reason, min(ts_ms) + {EXPIRY_TTL_MS} AS failed_ms
FROM j GROUP BY benchmark_id, message_id
HAVING min(ts_ms) < {EXPIRY_NOW_MS - EXPIRY_TTL_MS}
   AND coalesce(least(min(first_done), min(first_bad)) > min(ts_ms) + {EXPIRY_TTL_MS}, true)"""


@query("expired_messages_dirty", _EXPIRED)
def expired_messages_dirty(spark, sf):
    """ST4 (batch form) on the dirty log, with rejects."""
    e = Q.expire_to_dead_letter(history(spark, sf), processed(spark, sf), EXPIRY_NOW_MS, EXPIRY_TTL_MS, rejected=rejected(spark, sf))
    return e.select("original_queue", "benchmark_id", "message_id", "reason", F.unix_millis("failed_at").alias("failed_ms"))


@query("queue_stats_dirty", _SQL + """
SELECT count(*) FILTER (WHERE target_queue = 'urgent.queue') AS urgent_count, count(*) FILTER (WHERE target_queue = 'batch.queue') AS batch_count,
       (SELECT count(*) FROM bad) AS dlq_count,
       (SELECT count(*) FROM (SELECT DISTINCT benchmark_id, message_id FROM done)) AS total_processed
FROM j WHERE first_done IS NULL AND first_bad IS NULL""")
def queue_stats_dirty(spark, sf):
    """A16 on the dirty log."""
    bad = rejected(spark, sf)
    return Q.queue_stats(history(spark, sf), processed(spark, sf), bad, rejected=bad)


@query("processed_counters_dirty", _SQL + """
SELECT coalesce(p.consumer, r.consumer) AS consumer, coalesce(p.n, 0) AS processed, coalesce(r.n, 0) AS rejected
FROM (SELECT CASE WHEN target_queue = 'urgent.queue' THEN 'urgent-consumer' ELSE 'batch-consumer' END AS consumer, count(*) AS n
      FROM (SELECT DISTINCT benchmark_id, message_id, target_queue FROM done) GROUP BY 1) p
FULL JOIN (SELECT CASE WHEN target_queue = 'urgent.queue' THEN 'urgent-consumer' ELSE 'batch-consumer' END AS consumer, count(*) AS n
      FROM bad GROUP BY 1) r USING (consumer)""")
def processed_counters_dirty(spark, sf):
    """A20 on the dirty log: a replayed message counts once, every letter counts."""
    return Q.processed_counters(processed(spark, sf), rejected(spark, sf))


@query("queue_depth_dirty", _SQL + """, ev AS (
  SELECT target_queue, ts_ms AS ems, 1 AS delta FROM log
  UNION ALL SELECT target_queue, first_bad, -1 FROM j WHERE first_bad IS NOT NULL
  UNION ALL SELECT d.target_queue, max(d.processed_ms), -1 FROM done d
    WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.message_id = d.message_id AND b.benchmark_id IS NOT DISTINCT FROM d.benchmark_id)
    GROUP BY d.target_queue, d.benchmark_id, d.message_id
  UNION ALL SELECT 'dead.letter.queue', ms, 1 FROM bad),
per AS (SELECT target_queue, (ems // 2000) * 2000 AS window_start_ms, CAST(sum(delta) AS BIGINT) AS net FROM ev GROUP BY 1, 2)
SELECT *, CAST(sum(net) OVER (PARTITION BY target_queue ORDER BY window_start_ms) AS BIGINT) AS depth FROM per""")
def queue_depth_dirty(spark, sf):
    """ST5 (batch form) on the dirty log."""
    s = Q.queue_depth_series(history(spark, sf), processed(spark, sf), rejected=rejected(spark, sf))
    return s.select("target_queue", F.unix_millis("window_start").alias("window_start_ms"),
                    F.col("net").cast("long").alias("net"), F.col("depth").cast("long").alias("depth"))


@query("send_progress_dirty", _SQL + """, s AS (
  SELECT benchmark_id, ts_ms, row_number() OVER (PARTITION BY benchmark_id ORDER BY ts_ms, message_id) AS sent,
         count(*) OVER (PARTITION BY benchmark_id) AS total, min(ts_ms) OVER (PARTITION BY benchmark_id) AS t0 FROM log)
SELECT benchmark_id, sent, CAST(ts_ms - t0 AS DOUBLE) / 1000.0::DOUBLE AS elapsed_s,
       floor(CAST(sent AS DOUBLE) / (CAST(ts_ms - t0 AS DOUBLE) / 1000.0::DOUBLE)) AS rate
FROM s WHERE sent % 1000 = 0 OR sent = total""")
def send_progress_dirty(spark, sf):
    """A24 / W3 on the dirty log: a missing cohort is a cohort."""
    return M.send_progress(history(spark, sf))


@query("processed_marks_dirty", _SQL + """, d AS (
  SELECT *, row_number() OVER (PARTITION BY benchmark_id, message_id ORDER BY ts_ms) AS rn FROM j)
SELECT message_id, benchmark_id, ts_ms, last_done AS many_ms, CASE WHEN rn = 1 THEN last_done END AS one_ms FROM d""")
def processed_marks_dirty(spark, sf):
    """J2 and J3 on the dirty log: the newest processed row marks all rows of its message,
    or only the first."""
    h, p = history(spark, sf), processed(spark, sf)
    keep = ["message_id", "benchmark_id", "ts_ms"]
    many = H.mark_processed_many(h, p).select(*keep, F.col("processed_ms").alias("many_ms"))
    one = H.mark_processed(h, p).select(*keep, F.col("processed_ms").alias("one_ms"))
    m, o = many.alias("m"), one.alias("o")
    cond = F.lit(True)
    for c in keep:
        cond = cond & F.col(f"m.{c}").eqNullSafe(F.col(f"o.{c}"))
    return m.join(o, cond).select("m.*", "o.one_ms")


@query("priority_drain_positions", _SQL + """
SELECT message_id, benchmark_id, ts_ms, row_number() OVER (
  ORDER BY CASE WHEN target_queue = 'urgent.queue' THEN 10 ELSE 1 END DESC, ts_ms, message_id, benchmark_id NULLS FIRST) AS position
FROM log""")
def priority_drain_positions(spark, sf):
    """T7 on the dirty log: the place of every message in the delivery order."""
    return Q.drain_positions(history(spark, sf)).select("message_id", "benchmark_id", "ts_ms", "position")


@query("latency_percentiles_dirty", _SQL + f"""
SELECT benchmark_id, {O.pdisc('latency_ms', 0.55)} AS p55_ms, {O.pdisc('latency_ms', 0.95)} AS p95_ms,
       {O.pdisc('latency_ms', 0.99)} AS p99_ms FROM log GROUP BY benchmark_id""")
def latency_percentiles_dirty(spark, sf):
    """A3 on the dirty log: NaN and negative latencies are left out, null is a cohort."""
    return M.latency_percentiles(history(spark, sf))
