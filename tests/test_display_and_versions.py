"""F10 / F15 (exact rounding), A3 (distributed selection) and R13 (rules as of a time)."""

import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from conftest import SF001
from routelytics.functions.display import locale_number, money, to_fixed
from routelytics.operators.metrics import exact_percentiles
from routelytics.operators.routing import route, route_as_of
from routelytics.operators.rules import RuleVersions, collect_rules, rule_versions
from routelytics.plans import catalog as C
from routelytics.plans import fixture as FX
from routelytics.session import scratch_path
from routelytics.sinks.commits import read_committed
from routelytics.sources.seed import SEED_RULES, seed_rules
from routelytics.streaming.router import routing_batch


def _fixed(x, d):
    q = Decimal(abs(x)).quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_UP)
    return ("-" if x < 0 else "") + f"{q:.{d}f}"


def test_to_fixed_rounds_the_exact_binary_value(spark):
    r = random.Random(1)
    xs = [1.005, 1.45, 8.345, 0.125, 0.375, 2.5, 1e-9, 999.995, 0.995, 0.9949999999999999, 1e10 + .125, -1.005, -0.125, 0.0, 5e-324,
          0.005, 0.0005, 0.00005, 99999999.995, 2.0 ** 52 + 0.5, 2.0 ** 53, 1e15 + 0.3]
    xs += [round(r.random() * 10 ** r.randint(0, 7), r.randint(0, 5)) for _ in range(2000)]
    xs += [r.randint(0, 10 ** 6) / 8 for _ in range(300)] + [(2 * r.randint(0, 10 ** 5) + 1) / 2000 for _ in range(1000)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for d in (0, 1, 2, 3, 5):
        assert [(x, t) for x, t in df.select("x", to_fixed(F.col("x"), d)).collect() if t != _fixed(x, d)] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (1234567.0625,), (-1234.5,), (0.0004,)], "x double")
    assert [tuple(r) for r in odd.select(to_fixed(F.col("x")), locale_number(F.col("x")), money(F.col("x"))).collect()] == [
        (None, None, None), ("NaN", "NaN", "$NaN"), ("1234567.06", "1,234,567.063", "$1,234,567.063"),
        ("-1234.50", "-1,234.5", "$-1,234.5"), ("0.00", "0", "$0")]


def test_percentiles_by_selection(spark):
    r = random.Random(2)
    groups = {None: [r.random() * 1e-7 for _ in range(400)], "wide": [10 ** r.uniform(-9, 300) * r.choice([-1, 1]) for _ in range(400)],
              "same": [7.25] * 50, "one": [0.0], "ends": [math.inf, -math.inf, 1e308, -1e308, 3.0], "ties": [r.randint(0, 4) for _ in range(300)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", None), ("ties", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    ps = (0.0, 0.01, 0.5, 0.95, 1.0)
    got = exact_percentiles(df, "x", ps, ["g"])
    want = {g: tuple(sorted(map(float, vs))[max(1, math.ceil(p * len(vs))) - 1] for p in ps) for g, vs in groups.items()}
    assert {row[0]: tuple(row[1:]) for row in got.collect()} == want
    assert "rangepartitioning" not in got._jdf.queryExecution().toString().lower()


def test_a_replayed_log_routes_as_it_did_then(spark):
    versions = rule_versions(seed_rules(spark).drop("description"), spark.createDataFrame(C.RULE_LOG, C._LOG_SCHEMA))
    assert [t for t, _ in versions] == [None, *sorted({x[-1] for x in C.RULE_LOG if x[0] != 5})]  # a refused change is no version
    assert versions[0][1] == collect_rules(seed_rules(spark).drop("description"))
    msgs = FX.messages(spark, SF001)
    cuts = [t or 0 for t, _ in versions] + [1 << 62]
    want = {}
    for (a, z), (_, rules) in zip(zip(cuts, cuts[1:]), versions):
        want |= {r.id: r.target_queue for r in route(msgs.filter((F.col("ts_ms") >= a) & (F.col("ts_ms") < z)), rules).collect()}
    out = scratch_path(spark, "t-asof")
    routing_batch(lambda: versions, out)(msgs, 0)   # the whole log at once, long after
    got = {r.id: r.target_queue for r in read_committed(spark, out, "routed").collect()}
    assert got == want and got != {r.id: r.target_queue for r in route(msgs, SEED_RULES).collect()}
    one = spark.createDataFrame([("m", None, "fraud"), ("n", dt.datetime(2024, 1, 30), "fraud")], "id string, ts timestamp, type string")
    first = RuleVersions([(None, collect_rules([(1, "type", "equals", "fraud", "urgent", None)])), (1, [])])
    assert {r.id: (r.target_queue, r.matched_rule_id is None) for r in route_as_of(one, first).collect()} == {
        "m": ("urgent.queue", False), "n": ("batch.queue", True)}
