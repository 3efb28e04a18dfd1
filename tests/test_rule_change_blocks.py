"""The rule change log (R12) without a window over a whole rule: a hot rule over many
blocks against a fold in order."""

import random

from routelytics.operators.rules import apply_rule_changes
from routelytics.operators.scan import last_before
from routelytics.schemas import RULE_CHANGE
from routelytics.sources.seed import SEED_RULES, seed_rules

COLS = ["field", "operator", "value_str", "value_num", "target_queue", "priority", "category"]


def _log(n=600):
    r = random.Random(5)
    out = []
    for seq in range(n):
        op = r.choice(["create", "update", "update", "update", "delete"])
        text = r.random() < 0.5
        some = lambda v: v if op == "create" or r.random() < 0.3 else None
        value = op == "create" or r.random() < 0.3
        out.append((None if seq == 0 else seq, op, "hot" if r.random() < 0.7 else r.choice(["r0001", "r0002", "x", None]), some("type"),
                    some(r.choice(["equals", "contains"])), f"v{seq}" if value and text else None,
                    float(seq) if value and not text else None, some(r.choice(["urgent", "batch"])),
                    some(r.randint(1, 9)), some(f"c{seq}"), None))
    return out


def _fold(rules, log):
    state, bad = {r.rule_id: {c: r[c] for c in COLS} for r in rules}, []
    for seq, op, rid, *v in sorted(log, key=lambda x: (x[0] is not None, x[0] or 0)):
        new = dict(zip(COLS, v))
        if op == "create":
            state[rid] = new
        elif rid not in state:
            bad.append((seq, op, rid, "unknown_rule"))
        elif op == "delete":
            del state[rid]
        else:
            if new["value_str"] is None and new["value_num"] is None:
                new = {k: x for k, x in new.items() if not k.startswith("value")}
            state[rid].update({k: x for k, x in new.items() if x is not None or k.startswith("value")})
    return state, bad


def test_a_hot_rule_over_many_blocks(spark):
    rules = seed_rules(spark, SEED_RULES[:2])
    log = [x for x in _log() if x[0] is not None or x[2] not in ("r0001", "r0002")]
    new, errors = apply_rule_changes(rules, spark.createDataFrame(log, RULE_CHANGE).repartition(7))
    state, bad = _fold(rules.collect(), log)
    assert {r.rule_id: {c: r[c] for c in COLS} for r in new.collect()} == state
    assert sorted(map(tuple, errors.select("seq", "op", "rule_id", "error").collect()), key=repr) == sorted(bad, key=repr)
    assert "Window" not in new._jdf.queryExecution().executedPlan().toString()  # partial aggregates only


def test_last_value_is_carried_over_blocks(spark):
    d = spark.createDataFrame([(k, i, i if i in (3, 40) else None) for k in ("a", None) for i in range(60)], "k string, i long, v long")
    got = last_before(d, ["k"], ["i"], "v", "was", blocks=16)
    assert {(r.k, r.i): r.was for r in got.collect()} == {
        (k, i): None if i <= 3 else 3 if i <= 40 else 40 for k in ("a", None) for i in range(60)}
    for r in last_before(d, ["k"], ["i"], "v", "was", blocks=16)._jdf.queryExecution().executedPlan().toString().split("\n"):
        assert "Window [last(v" not in r or "_scan_blk" in r
