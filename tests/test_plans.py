"""Plan shape: routing adds no shuffle; filters on input columns still reach
the Parquet scan (through the routing generator); filters on the decision stay
above the rule chain (evaluated once)."""

from pyspark.sql import functions as F

from conftest import SF001
from routelytics.operators.routing import route
from routelytics.sources.messages import read_table
from routelytics.sources.seed import ORDER_RULES, SEED_RULES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routing_adds_no_exchange(spark):
    o = read_table(spark, SF001, "orders")
    p = _plan(route(o, ORDER_RULES).select("o_orderkey", "target_queue"))
    assert "Exchange" not in p


def test_input_filter_pushed_to_scan(spark):
    o = read_table(spark, SF001, "orders")
    r = route(o, ORDER_RULES).filter(F.col("o_orderstatus") == "F").select("o_orderkey", "target_queue")
    p = _plan(r)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in p


def test_decision_filter_stays_above_chain(spark):
    o = read_table(spark, SF001, "orders")
    p = _plan(route(o, ORDER_RULES).filter(F.col("target_queue") == "urgent.queue"))
    # the rule chain appears once (inside the generator), not also in a pushed filter
    assert p.count("1-URGENT") == 1


def test_two_cohort_comparison_is_one_aggregation(spark):
    from routelytics.operators.metrics import compare_cohorts
    from routelytics.plans import fixture as FX
    p = _plan(compare_cohorts(FX.all_history(spark, SF001), FX.SMART_ID, FX.NAIVE_ID))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_join_form_has_no_nested_loop(spark):
    from routelytics.operators.routing import route_join_form
    o = read_table(spark, SF001, "orders")
    p = _plan(route_join_form(o, ORDER_RULES, key="o_orderkey"))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
