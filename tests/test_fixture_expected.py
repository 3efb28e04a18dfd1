"""Expected results of the message view under the 50 seed rules
(FIXTURES.md section 2, table "Expected results")."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from routelytics.operators import metrics as M
from routelytics.operators import processing as PR
from routelytics.plans import fixture as FX

EXPECTED = {
    SF001: dict(urgent=538, batch=462, crit_ok=516, crit=750, correct=744, rules=37, default=0,
                p_u=(380, 394), p_b=(379, 397), processed=(427, 373), actions=(32, 49, 92, 365),
                chunks=(419, 3, 0)),
    SF01: dict(urgent=5257, batch=4743, crit_ok=5119, crit=7500, correct=7481, rules=45, default=4,
               p_u=(378, 394), p_b=(381, 398), processed=(4191, 3809), actions=(313, 448, 1011, 3485),
               chunks=(1745, 10, 17)),
}


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_expected(spark, sf):
    e = EXPECTED[sf]
    r = FX.routed(spark, sf)
    a = r.agg(F.count_if(F.col("target_queue") == "urgent.queue").alias("u"),
              F.count_if(F.col("target_queue") == "batch.queue").alias("b"),
              F.count_if(F.col("is_critical") & (F.col("target_queue") == "urgent.queue")).alias("co"),
              F.count_if("is_critical").alias("c"),
              F.count_distinct("matched_priority").alias("rules"),
              F.count_if(F.col("matched_priority").isNull()).alias("dflt")).collect()[0]
    assert (a.u, a.b, a.co, a.c, a.rules, a.dflt) == (e["urgent"], e["batch"], e["crit_ok"], e["crit"],
                                                    e["rules"], e["default"])
    h = FX.history(spark, sf)
    assert M.overall_accuracy(h).collect()[0].critical_correct + \
        M.overall_accuracy(h).collect()[0].noncritical_correct == e["correct"]
    q = {x.target_queue: (x.p95_ms, x.p99_ms) for x in M.latency_by_queue(h).collect()}
    assert q["urgent.queue"] == e["p_u"] and q["batch.queue"] == e["p_b"]
    p = {x.processed_by: x.n for x in FX.processed(spark, sf).groupBy("processed_by")
         .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (p["urgent-consumer"], p["batch-consumer"]) == e["processed"]
    act = {x.action: x.n for x in PR.classify_urgent_action(
        h.filter(F.col("target_queue") == "urgent.queue"), "message_type", "amount", "risk_score")
        .groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (act["fraud_alert"], act["manual_approval"], act["block_transaction"], act["fast_track"]) == e["actions"]
    b = h.filter(F.col("target_queue") == "batch.queue").select("message_id", "ts_ms")
    st = PR.chunk_stats(PR.assign_chunks(b, timeout_ms=600_000)).collect()[0]
    assert (st.chunks, st.largest, st.full_chunks) == e["chunks"]
