"""Inputs a real log contains: missing cohorts, replays, repeated ids, infinities,
tied priorities, changed tables."""

import math

import pytest
from pyspark.sql import functions as F

from routelytics.operators import queues as Q
from routelytics.operators.history import mark_processed, mark_processed_many
from routelytics.operators.metrics import send_progress
from routelytics.operators.routing import explain_route, route, route_join_form
from routelytics.session import scratch_path

HIST = "benchmark_id string, message_id string, target_queue string, ts timestamp"
DONE = "benchmark_id string, message_id string, target_queue string, processed_ms long, processed_by string, " \
       "processing_time double, status string"


def _hist(spark):
    rows = [(None, "m1", "urgent.queue", 0), ("b", "m1", "urgent.queue", 0), (None, "m2", "batch.queue", 10_000),
            (None, None, "batch.queue", 0), (None, None, "batch.queue", 1)]
    return spark.createDataFrame(rows, "benchmark_id string, message_id string, target_queue string, ms long") \
        .select("benchmark_id", "message_id", "target_queue", F.timestamp_millis("ms").alias("ts"))


def _done(spark, rows):
    return spark.createDataFrame([(b, m, q, t, "urgent-consumer", 1.0, "processed") for b, m, q, t in rows], DONE)


def test_a_missing_cohort_is_marked_not_pending_and_not_expired(spark):
    h, p = _hist(spark), _done(spark, [(None, "m1", "urgent.queue", 5)])
    for mark in (mark_processed, mark_processed_many):
        got = {(r.benchmark_id, r.message_id): r.status for r in mark(h, p).collect() if r.message_id}
        assert got == {(None, "m1"): "processed", ("b", "m1"): None, (None, "m2"): None}
    assert {(r.benchmark_id, r.message_id) for r in Q.pending(h, p).collect()} == {("b", "m1"), (None, "m2"), (None, None)}
    expired = Q.expire_to_dead_letter(h, p, now_ms=100_000, ttl_ms=1000)
    assert (None, "m1") not in {(r.benchmark_id, r.message_id) for r in expired.collect()}


def test_replayed_processed_rows_count_once(spark):
    h = _hist(spark)
    p = _done(spark, [(None, "m1", "urgent.queue", 5), (None, "m1", "urgent.queue", 6)])
    none = p.select(F.lit("urgent.queue").alias("original_queue"), *Q.KEY).limit(0)
    assert Q.queue_stats(h, p, none).first().total_processed == 1
    assert Q.processed_counters(p, none).first().processed == 1
    assert min(r.depth for r in Q.queue_depth_series(h, p).collect()) >= 0


def test_late_processing_has_expired_before(spark):
    h, p = _hist(spark), _done(spark, [("b", "m1", "urgent.queue", 60_000)])
    expired = Q.expire_to_dead_letter(h, p, now_ms=100_000, ttl_ms=10_000)
    assert ("b", "m1") in {(r.benchmark_id, r.message_id) for r in expired.collect()}


def test_depth_samples_carry_forward_and_count_rejects(spark):
    h = _hist(spark).filter("message_id IS NOT NULL AND benchmark_id IS NULL")     # urgent at 0 s, batch at 10 s
    none = _done(spark, [])
    got = Q.last_depth_samples(Q.queue_depth_series(h, none)).orderBy("window_start").collect()
    assert [(r.urgent_depth, r.batch_depth, r.dlq_depth) for r in got] == [(1, 0, 0), (1, 1, 0)]
    assert Q.last_depth_samples(Q.queue_depth_series(h, none), 1).first().urgent_depth == 1
    bad = spark.createDataFrame([("urgent.queue", 12_000)], "original_queue string, ms long").select(
        "original_queue", F.timestamp_millis("ms").alias("failed_at"))
    got = Q.last_depth_samples(Q.queue_depth_series(h, none, rejected=bad)).orderBy("window_start").collect()
    assert [(r.urgent_depth, r.batch_depth, r.dlq_depth) for r in got][-1] == (0, 1, 1)


def test_progress_of_a_missing_cohort(spark):
    h = spark.createDataFrame([(b, f"m{i}", 1000 * i) for b in (None, "b") for i in range(5)],
                              "benchmark_id string, message_id string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = sorted(((r.benchmark_id or "", r.sent, r.elapsed_s, r.rate) for r in send_progress(h, 2).collect()))
    assert got == [(b, n, n - 1.0, rate) for b in ("", "b") for n, rate in ((2, 2.0), (4, 1.0), (5, 1.0))]


RULES = [[("x", "lessThan", 10.0, "urgent"), ("x", "lessThan", math.inf, "batch")], [("x", "lessThan", math.inf, "urgent")],
         [("x", "greaterThan", -math.inf, "urgent"), ("x", "greaterThan", 0.0, "batch")],
         [("x", "lessThan", 0.0, "urgent"), ("x", "lessThan", -math.inf, "urgent"), ("x", "greaterThan", -0.0, "urgent")],
         [("x", "greaterThan", 3.0, "urgent"), ("x", "lessThan", -3.0, "urgent"), ("x", "equals", 0.0, "urgent")]]


@pytest.mark.parametrize("n", range(len(RULES)))
def test_both_rule_forms_agree_on_extreme_numbers(spark, n):
    values = [math.inf, -math.inf, math.nan, None, 0.0, -0.0, 3.0, -3.0, 9.99, 10.0, 1e308]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    rules = [(p, *r) for p, r in enumerate(RULES[n], 1)]
    a, b = ({r.id: r.matched_priority for r in route(df, rules, method=m).collect()} for m in ("chain", "decomposed"))
    assert a == b


def test_routing_twice_tied_priorities_and_repeated_ids(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 50.0)], "id string, x double")
    rules = [(5, "x", "lessThan", 10.0, "urgent"), (5, "x", "greaterThan", 10.0, "batch")]
    routed = route(route(df, rules), rules)
    assert routed.count() == 2
    assert explain_route(route(df, rules), rules).count() == 2
    assert sorted(r.target_queue for r in route_join_form(df, rules).collect()) == ["batch.queue", "urgent.queue"]


def test_field_names_are_case_sensitive(spark):
    df = spark.createDataFrame([("fraud", 0.9)], "type string, risk_score double")
    assert route(df, [(1, "TYPE", "equals", "fraud", "urgent")]).first().target_queue == "batch.queue"
    assert route(df, [(1, "riskScore", "greaterThan", 0.5, "urgent")]).first().target_queue == "urgent.queue"


def test_sinks_append_without_a_batch_and_replace_with_one(spark):
    from routelytics.sinks.tables import write_dead_letters, write_routed
    r = spark.createDataFrame([("m", "urgent.queue")], "id string, target_queue string")
    a, b = scratch_path(spark, "t-append"), scratch_path(spark, "t-letters")
    for _ in range(2):
        write_routed(r, a)
        write_routed(r, f"{a}-batches", batch_id=1)
        write_dead_letters(r, b)
    assert spark.read.parquet(a).count() == 2 and spark.read.parquet(b).count() == 2
    assert spark.read.parquet(f"{a}-batches").count() == 1


def test_raw_feed_follows_its_table(spark, tmp_path):
    from conftest import SF001
    from routelytics.plans.fixture import raw_feed
    events = spark.read.parquet(f"{SF001}/events.parquet")
    events.write.parquet(f"{tmp_path}/events.parquet")
    n = raw_feed(spark, str(tmp_path)).count()
    events.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert raw_feed(spark, str(tmp_path)).count() == 2 * n


def test_raw_stream_routes_by_the_json_values(spark):
    from routelytics.operators.quality import parse_and_validate
    from routelytics.operators.routing import route_json
    from routelytics.streaming.router import routing_batch
    raw = spark.createDataFrame([
        ('{"id":"1","type":"a","amount":null}',), ('{"id":"2","type":"a","tenant":"vip"}',),
        ('{"id":"3","type":"a","amount":"7"}',), ('{"id":"4","type":5}',), ("[1]",), ("null",), ("{",)], "value string")
    rules = [(1, "amount", "equals", 7.0, "urgent"), (2, "type", "equals", "5", "urgent"), (3, "tenant", "equals", "vip", "urgent"),
             (4, "amount", "lessThan", 5.0, "other")]
    out = scratch_path(spark, "t-raw")
    routing_batch(lambda: rules, out, raw=True)(raw, 0)
    got = {r.id: r.matched_priority for r in spark.read.parquet(f"{out}/routed").collect()}
    want = {r.id: r.matched_priority for r in route_json(parse_and_validate(raw).filter("reason IS NULL"), rules)
            .selectExpr("try_variant_get(v, '$.id', 'string') AS id", "matched_priority").collect()}
    assert got == want == {"1": 4, "2": 3, "3": None, "4": None}
    letters = spark.read.parquet(f"{out}/dead_letters").collect()
    assert sorted(r.reason for r in letters) == ["malformed_json", "missing_required", "processing_error"]
    assert {r.original_queue for r in letters} == {"events"}
    stamps = [r.ts for r in spark.read.parquet(f"{out}/history").collect()]
    assert len(stamps) == 4 and None not in stamps      # the routing time, also without a message stamp


def test_iso_text_is_utc_in_any_time_zone(spark):
    from routelytics.functions.timefmt import iso_ms
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert spark.range(1).select(iso_ms(F.timestamp_millis(F.lit(0)))).first()[0] == "1970-01-01T00:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
