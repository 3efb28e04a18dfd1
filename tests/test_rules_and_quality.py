"""Rule validation / typing / change log (P11, P12, R12) and message
validation with dead letters (P1, P10, K2; FIXTURES.md 1.5, 1.6)."""

from pyspark.sql import functions as F

from routelytics.operators.quality import (dead_letters, parse_and_validate, preview_raw,
                                           split_valid)
from routelytics.operators.rules import (apply_rule_changes, rules_by_category,
                                         type_rule_values, validate_rules)
from routelytics.schemas import RULE, RULE_CHANGE
from routelytics.sources.seed import SEED_RULES, seed_rules


def test_validate_rules(spark):
    rows = [
        ("a", "type", "equals", "fraud", None, "urgent", 1, None, None),
        ("b", None, "equals", "fraud", None, "urgent", 1, None, None),
        ("c", "type", "", "fraud", None, "urgent", 1, None, None),
        ("d", "type", "equals", None, None, "urgent", 1, None, None),
        ("e", "type", "equals", "x", None, None, 1, None, None),
        ("f", "type", "equals", "x", None, "urgent", 0, None, None),
        ("g", "type", "notEquals", "x", None, "urgent", 2, None, None),
        ("h", "amount", "lessThan", None, 0.0, "later", 3, None, None),
    ]
    out = {r.rule_id: (r.error, r.warning) for r in validate_rules(spark.createDataFrame(rows, RULE)).collect()}
    assert out == {"a": (None, None), "b": ("missing_field", None), "c": ("missing_operator", None),
                   "d": ("missing_value", None), "e": ("missing_target", None),
                   "f": ("missing_priority", None), "g": (None, "unknown_operator"),
                   "h": (None, "unknown_target")}


def test_type_rule_values(spark):
    df = spark.createDataFrame([("1000",), ("fraud",), ("0.95",)], "value_text string")
    out = {(r.value_str, r.value_num) for r in type_rule_values(df).collect()}
    assert out == {(None, 1000.0), ("fraud", None), (None, 0.95)}


def test_apply_rule_changes(spark):
    rules = seed_rules(spark, SEED_RULES[:3])
    changes = spark.createDataFrame([
        (1, "update", "r0001", "type", "equals", "breach", None, "urgent", 1, "fraud", None),
        (2, "delete", "r0002", None, None, None, None, None, None, None, None),
        (3, "create", "r0100", "region", "equals", "EU", None, "batch", 100, "region", None),
        (4, "update", "r0999", "type", "equals", "x", None, "urgent", 5, None, None),
        (5, "create", "r0101", None, "equals", "x", None, "urgent", 5, None, None),   # invalid
    ], RULE_CHANGE)
    new, errors = apply_rule_changes(rules, changes)
    got = {r.rule_id: r.value_str for r in new.collect()}
    assert got == {"r0001": "breach", "r0003": "chargeback", "r0100": "EU"}
    assert {r.seq: r.error for r in errors.collect()} == {4: "unknown_rule", 5: "missing_field"}


def test_rule_changes_are_folded_one_after_the_other(spark):
    rules = seed_rules(spark, SEED_RULES[:2])
    changes = spark.createDataFrame([
        (1, "delete", "r0001", None, None, None, None, None, None, None, None),
        (2, "update", "r0001", "type", "equals", "back", None, "urgent", 1, None, None),     # it is gone
        (3, "update", "r0200", "type", "equals", "early", None, "urgent", 9, None, None),    # not there yet
        (4, "create", "r0200", "type", "equals", "x", None, "urgent", 9, "cat", "text"),
        (5, "update", "r0200", None, None, None, 7.0, None, None, None, None),               # the rest stays
        (6, "delete", "r0002", None, None, None, None, None, None, None, None),
        (7, "create", "r0002", "amount", "lessThan", None, 5.0, "batch", 3, None, None),     # a new life
        (8, "rename", "r0002", None, None, None, None, None, None, None, None),
        (9, "update", "r0200", None, "", None, None, None, None, None, None),
    ], RULE_CHANGE)
    new, errors = apply_rule_changes(rules, changes)
    got = {r.rule_id: r for r in new.collect()}
    assert set(got) == {"r0200", "r0002"}
    r = got["r0200"]
    assert (r.field, r.operator, r.value_str, r.value_num, r.priority, r.category, r.description) == (
        "type", "equals", None, 7.0, 9, "cat", "text")
    assert (got["r0002"].category, got["r0002"].value_num, got["r0002"].value_str) == (None, 5.0, None)
    assert {r.seq: r.error for r in errors.collect()} == {
        2: "unknown_rule", 3: "unknown_rule", 8: "unknown_op", 9: "missing_operator"}


def test_rules_by_category(spark):
    out = {r.category: (r.rules, r.urgent_rules, r.batch_rules)
           for r in rules_by_category(seed_rules(spark)).collect() if r.category or r.is_total}
    assert out[None] == (50, 28, 22)
    assert out["fraud"] == (8, 8, 0) and out["payment"] == (10, 5, 5) and out["region"] == (4, 2, 2)


def test_reject_cases(spark):
    raw = spark.createDataFrame([
        ("k1", "{ this is broken json !!!"), ("k2", '{"type":"fraud"}'), ("k3", '{"id":"x","type":""}'),
        ("k4", "null"), ("k5", '{"id":"x","type":"fraud"}'), ("k6", '{"id":0,"type":"fraud"}'),
        ("k7", '{"id":"0","type":"fraud"}'), ("k8", ""), ("k9", "[1,2]"), ("k10", '{"id":"y","type":false}'),
    ], "key string, value string")
    v = parse_and_validate(raw)
    out = {r.key: r.reason for r in v.collect()}
    assert out == {"k1": "malformed_json", "k2": "missing_required", "k3": "missing_required",
                   "k4": "processing_error", "k5": None, "k6": "missing_required", "k7": None,
                   "k9": "missing_required", "k10": "missing_required"}   # k8 blank: skipped
    good, bad = split_valid(v)
    assert good.count() + bad.count() == 9
    env = dead_letters(bad, "urgent.queue").collect()
    assert {e.reason for e in env} == {"malformed_json", "missing_required", "processing_error"}
    assert all(e.original_queue == "urgent.queue" and e.message for e in env)


def test_preview(spark):
    raw = spark.createDataFrame([("x" * 100,), ("short",)], "value string")
    out = {r.raw_length: r.preview for r in preview_raw(raw).collect()}
    assert out[100] == "x" * 80 + "..." and out[5] == "short"


def test_sinks(spark):
    from routelytics.session import scratch_path
    from routelytics.sinks.tables import append_history, to_kafka_records, write_routed
    df = spark.createDataFrame([("a", "urgent.queue", None), ("b", "batch.queue", 5.0)],
                               "id string, target_queue string, amount double")
    p = scratch_path(spark, "t-sink")
    write_routed(df, p, batch_id=0)
    write_routed(df, p, batch_id=0)            # replayed batch: replaced, not duplicated
    back = spark.read.parquet(p)
    assert back.count() == 2 and set(back.columns) >= {"target_queue", "delivery_priority", "batch_id"}
    assert back.filter("target_queue = 'urgent.queue'").collect()[0].delivery_priority == 10
    rec = to_kafka_records(df).collect()
    assert rec[0].key == "a" and '"amount":null' in rec[0].value
    assert to_kafka_records(df, key=None).columns == ["value"]
    h = scratch_path(spark, "t-hist")
    append_history(df, h); append_history(df, h)
    assert spark.read.parquet(h).count() == 4


def test_minimal_rule_table_loads(spark):
    from routelytics.operators.routing import route
    rules = spark.createDataFrame([("type", "equals", "fraud", None, "urgent", 1),
                                   ("amount", "lessThan", None, 10.0, "batch", 2)],
                                  "field string, operator string, value_str string, value_num double, "
                                  "target_queue string, priority int")
    msgs = spark.createDataFrame([("a", "fraud", 50.0), ("b", "log", 5.0), ("c", "log", 50.0)],
                                 "id string, type string, amount double")
    got = {r.id: r.matched_priority for r in route(msgs, rules).collect()}
    assert got == {"a": 1, "b": 2, "c": None}
