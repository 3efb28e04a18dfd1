"""Golden rows: the engine's nine unit cases (ten mock rules) and the five
sample messages under the 50 seed rules (FIXTURES.md 1.2-1.4)."""

import random

import pytest
from pyspark.sql import functions as F

from routelytics.operators.routing import route, route_join_form
from routelytics.schemas import MESSAGE
from routelytics.sources.seed import SEED_RULES, UNIT_RULES

UNIT_MSGS = [  # id, type, priority, amount, risk, expected queue, expected rule
    ("t1", "fraud", "medium", 500.0, 0.3, "urgent", 1),
    ("t2", "payment", "low", 150000.0, 0.1, "urgent", 2),
    ("t3", "payment", "low", 500.0, 0.92, "urgent", 4),
    ("t4", "payment", "critical", 500.0, 0.1, "urgent", 6),
    ("t5", "analytics", "low", 50.0, 0.1, "batch", 7),
    ("t6", "payment", "low", 200.0, 0.1, "batch", 8),
    ("t7", "payment", "medium", 49.0, 0.1, "batch", 9),
    ("t8", "unknown", "medium", 500.0, 0.3, "batch", None),
    ("t9", "monthly-report", "medium", 500.0, 0.3, "batch", 10),
]

SAMPLE_MSGS = [
    ("msg-001", "payment", "critical", 75000.0, 0.5, "urgent", 10),
    ("msg-002", "analytics", "low", 0.0, 0.1, "batch", 14),
    ("msg-003", "payment", "high", 500.0, 0.2, "batch", 18),
    ("msg-004", "payment", "critical", 15000.0, 0.4, "urgent", 11),
    ("msg-005", "report", "low", 0.0, 0.95, "batch", 14),
]


def _df(spark, rows):
    data = [(i, None, t, p, a, r, "EU", "USD", "u", "web", None, None) for i, t, p, a, r, *_ in rows]
    return spark.createDataFrame(data, MESSAGE)


@pytest.mark.parametrize("method", ["chain", "decomposed"])
@pytest.mark.parametrize("rules,rows", [(UNIT_RULES, UNIT_MSGS), (SEED_RULES, SAMPLE_MSGS)])
def test_golden(spark, rules, rows, method):
    out = {r.id: r for r in route(_df(spark, rows), rules, method=method).collect()}
    for mid, *_, queue, prio in rows:
        assert out[mid].matched_rule == queue, mid
        assert out[mid].matched_priority == prio, mid
        assert out[mid].target_queue == f"{queue}.queue"


def test_join_form_equals_chain(spark):
    df = _df(spark, UNIT_MSGS + SAMPLE_MSGS)
    a = {r.id: r.matched_priority for r in route(df, SEED_RULES).collect()}
    b = {r.id: r.matched_priority for r in route_join_form(df, SEED_RULES).collect()}
    assert a == b


def test_rule_order_does_not_matter(spark):
    df = _df(spark, UNIT_MSGS)
    shuffled = list(UNIT_RULES)
    random.Random(7).shuffle(shuffled)
    a = {r.id: r.matched_priority for r in route(df, UNIT_RULES).collect()}
    b = {r.id: r.matched_priority for r in route(df, shuffled).collect()}
    assert a == b


def test_lower_precedence_rule_never_changes_a_match(spark):
    df = _df(spark, UNIT_MSGS)
    extra = UNIT_RULES + [(99, "type", "contains", "", "urgent", None)]
    a = {r.id: r.matched_priority for r in route(df, UNIT_RULES).collect()}
    b = {r.id: r.matched_priority for r in route(df, extra).collect()}
    for k, v in a.items():
        if v is not None:
            assert b[k] == v
        else:
            assert b[k] == 99          # '' is contained in every present value


def test_unknown_operator_and_field_never_match(spark):
    df = _df(spark, UNIT_MSGS)
    rules = [(1, "type", "notEquals", "fraud", "urgent"), (2, "nosuchfield", "equals", "x", "urgent"),
             (3, "nosuchfield", "greaterThan", 1, "urgent")]
    assert all(r.matched_priority is None and r.target_queue == "batch.queue"
               for r in route(df, rules).collect())


def test_missing_field_contains_reads_undefined(spark):
    df = _df(spark, UNIT_MSGS[:1])
    r = route(df, [(1, "nosuchfield", "contains", "def", "urgent")]).collect()[0]
    assert r.matched_priority == 1


def test_other_target_goes_to_batch_queue_keeps_label(spark):
    df = _df(spark, UNIT_MSGS[:1])
    r = route(df, [(1, "type", "equals", "fraud", "review")]).collect()[0]
    assert r.matched_rule == "review" and r.target_queue == "batch.queue"


def test_equals_is_type_strict(spark):
    df = spark.createDataFrame([("a", "1000", 1000.0)], "id string, s string, n double")
    rules = [(1, "s", "equals", 1000, "urgent"), (2, "n", "equals", "1000", "urgent"),
             (3, "n", "equals", 1000, "urgent")]
    assert route(df, rules).collect()[0].matched_priority == 3


def test_nan_never_compares(spark):
    df = spark.createDataFrame([("a", float("nan"))], "id string, amount double")
    rules = [(1, "amount", "greaterThan", 5, "urgent"), (2, "amount", "lessThan", 5, "urgent"),
             (3, "amount", "equals", float("nan"), "urgent")]
    for method in ("chain", "decomposed"):
        assert route(df, rules, method=method).collect()[0].matched_priority is None


def test_decomposed_equals_chain_on_random_rules(spark):
    rnd = random.Random(3)
    fields = [("type", ["fraud", "payment", "report", "log"]), ("priority", ["low", "high"])]
    rules = []
    for p in range(1, 121):
        k = rnd.random()
        if k < 0.4:
            f, vals = rnd.choice(fields)
            rules.append((p, f, "equals", rnd.choice(vals), rnd.choice(["urgent", "batch"])))
        elif k < 0.8:
            rules.append((p, rnd.choice(["amount", "riskScore"]), rnd.choice(["greaterThan", "lessThan"]),
                          round(rnd.uniform(0, 1000), 2), rnd.choice(["urgent", "batch"])))
        else:
            rules.append((p, "type", "contains", rnd.choice(["port", "ay", "x"]), "batch"))
    rows = [(f"m{i}", rnd.choice(["fraud", "payment", "report", "log", "x"]), rnd.choice(["low", "high"]),
             rnd.choice([None, rnd.uniform(0, 1200), float("nan")]), rnd.choice([None, rnd.random() * 1000]),
             "", None) for i in range(300)]
    df = spark.createDataFrame([(i, None, t, p, a, r, "EU", "USD", "u", "web", None, None)
                                for i, t, p, a, r, *_ in rows], MESSAGE)
    a = {r.id: r.matched_priority for r in route(df, rules, method="chain").collect()}
    b = {r.id: r.matched_priority for r in route(df, rules, method="decomposed").collect()}
    assert a == b


def test_auto_switches_to_decomposed_for_large_rule_sets(spark):
    rnd = random.Random(11)
    rules = [(p, "type", "equals", f"t{rnd.randint(0, 700)}", "urgent") if p % 2 else
             (p, "amount", rnd.choice(["greaterThan", "lessThan"]), rnd.uniform(0, 1000), "batch")
             for p in range(1, 602)]
    rows = [(f"m{i}", f"t{rnd.randint(0, 700)}", "low", rnd.uniform(0, 1000), 0.1, "", None) for i in range(200)]
    df = _df(spark, rows)
    auto = route(df, rules)
    assert "_bk_" not in " ".join(auto.columns)            # helper columns dropped
    a = {r.id: r.matched_priority for r in auto.collect()}
    b = {r.id: r.matched_priority for r in route(df, rules, method="chain").collect()}
    assert a == b
    plan = auto._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan                                    # the decomposed form was chosen
