"""Edge cases of the report / endpoint metrics."""

import datetime as dt

from pyspark.sql import functions as F

from routelytics.functions.timefmt import iso_ms
from routelytics.operators import history as H
from routelytics.operators import metrics as M

S = "message_id string, target_queue string, latency_ms double, ts timestamp, is_critical boolean, benchmark_id string, message_type string"
T0 = dt.datetime(2024, 1, 1)


def _h(spark, rows):
    return spark.createDataFrame(rows, S)


def test_accuracy_when_no_critical(spark):
    h = _h(spark, [("a", "batch.queue", 5.0, T0, False, "b", "log")])
    assert M.priority_accuracy(h).collect()[0].accuracy_pct == 0.0            # reports
    assert M.live_metrics(h).collect()[0].accuracy_pct == 100.0               # endpoint
    empty = _h(spark, [])
    r = M.live_metrics(empty).collect()[0]
    assert (r.total_messages, r.avg_latency_ms, r.accuracy_pct, r.throughput) == (0, 0.0, 0.0, 0.0)


def test_throughput_durations(spark):
    same = _h(spark, [("a", "urgent.queue", 1.0, T0, True, "b", "x"), ("b", "urgent.queue", 1.0, T0, True, "b", "x")])
    assert M.throughput(same).collect()[0].throughput is None                 # reports: /0
    assert M.throughput(same, min_duration_s=1).collect()[0].throughput == 2.0  # endpoint
    one = _h(spark, [("a", "urgent.queue", 1.0, T0, True, "b", "x")])
    assert M.throughput(one).collect()[0].duration_s == 1.0


def test_latency_cleaning_and_targets(spark):
    h = _h(spark, [("a", "urgent.queue", -1.0, T0, True, "b", "x"), ("b", "urgent.queue", float("nan"), T0, True, "b", "x"),
                   ("c", "urgent.queue", None, T0, True, "b", "x"), ("d", "urgent.queue", 50.0, T0, True, "b", "x")])
    s = M.latency_summary(h).collect()[0]
    assert (s.n, s.min_ms, s.p95_ms) == (1, 50.0, 50.0)
    t = {r.target_queue: (r.p95_checked_ms, r.passed) for r in M.latency_targets(h).collect()}
    assert t == {"urgent.queue": (50.0, True), "batch.queue": (999.0, False)}
    q = {r.target_queue: (r.n, r.avg_ms) for r in M.latency_by_queue(h).collect()}
    assert q["batch.queue"] == (0, 0.0)


def test_recent_history_limit(spark):
    rows = [(f"m{i:03d}", "batch.queue", 1.0, T0 + dt.timedelta(seconds=i), False, "b", "x") for i in range(120)]
    h = _h(spark, rows)
    assert H.recent_history(h, "abc").count() == 50 and H.recent_history(h, 0).count() == 50
    top = [r.message_id for r in H.recent_history(h, 3).collect()]
    assert top == ["m119", "m118", "m117"]


def test_type_distribution_unknown_and_ties(spark):
    h = _h(spark, [("a", "urgent.queue", 1.0, T0, True, "b", ""), ("b", "batch.queue", 1.0, T0, True, "b", None),
                   ("c", "urgent.queue", 1.0, T0, True, "b", "fraud"), ("d", "naive.queue", 1.0, T0, True, "b", "fraud")])
    got = [(r.message_type, r.urgent, r.batch, r.tag) for r in M.type_distribution(h).collect()]
    assert got == [("fraud", 1, 1, "batch"), ("unknown", 1, 1, "batch")]


def test_timestamps(spark):
    df = spark.createDataFrame([("2026-04-13T10:00:00Z",), ("not a date",), ("2026-04-13T10:00:00.123Z",)], "ts string")
    assert H.valid_timestamps(df).count() == 2
    t = spark.createDataFrame([(dt.datetime(2026, 4, 13, 10, 0, 0, 123000),)], "ts timestamp")
    assert t.select(iso_ms(F.col("ts")).alias("s")).collect()[0].s == "2026-04-13T10:00:00.123Z"


def test_display_helpers(spark):
    from routelytics.functions.display import clock_time, locale_number, to_fixed
    df = spark.createDataFrame([(1234567.0, 0.925, dt.datetime(2024, 1, 1, 9, 5, 7))], "a double, b double, t timestamp")
    r = df.select(locale_number(F.col("a")).alias("a"), to_fixed(F.col("b")).alias("b"),
                  locale_number(F.col("b")).alias("c"), clock_time(F.col("t")).alias("t")).collect()[0]
    assert (r.a, r.c, r.t) == ("1,234,567", "0.925", "09:05:07")
    assert r.b in ("0.92", "0.93")


def test_exact_percentiles_match_percentile_disc(spark):
    import random
    rnd = random.Random(4)
    rows = [(rnd.choice(["u", "b"]), rnd.random() * 1000 if rnd.random() < 0.9 else float(rnd.randint(0, 5)))
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "q string, x double")
    a = {r.q: (r.p55_ms, r.p95_ms, r.p99_ms) for r in M.exact_percentiles(df, "x", (0.55, 0.95, 0.99), by=["q"]).collect()}
    b = {r.q: (r.a, r.b, r.c) for r in df.groupBy("q").agg(
        F.expr("percentile_disc(0.55) WITHIN GROUP (ORDER BY x)").alias("a"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY x)").alias("b"),
        F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY x)").alias("c")).collect()}
    assert a == b
    g = M.exact_percentiles(df, "x", (0.95,)).collect()[0]
    assert g.p95_ms == df.selectExpr("percentile_disc(0.95) WITHIN GROUP (ORDER BY x) AS p").collect()[0].p
