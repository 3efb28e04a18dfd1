"""Structured Streaming: the router and the urgent consumer as streams give
the batch results (availableNow over file sources)."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF001
from routelytics.plans import fixture as FX
from routelytics.session import scratch_path
from routelytics.sources.messages import message_columns, read_messages_stream, table_path
from routelytics.sources.seed import SEED_RULES
from routelytics.streaming.router import route_stream


def test_stream_equals_batch(spark):
    path = table_path(SF001, "events")
    stream = read_messages_stream(spark, path, spark.read.parquet(path).schema)
    out = scratch_path(spark, "t-stream")
    q = route_stream(stream, lambda: SEED_RULES, out, f"{out}/_ck", prepare=message_columns,
                     available_now=True)
    q.awaitTermination()
    got = {(r.id, r.target_queue) for r in spark.read.parquet(f"{out}/routed").select("id", "target_queue").collect()}
    exp = {(r.id, r.target_queue) for r in FX.routed(spark, SF001).select("id", "target_queue").collect()}
    assert got == exp and len(got) == 1000


def test_raw_stream_dead_letters_and_rule_refresh(spark, tmp_path):
    src = scratch_path(spark, "t-raw-src")
    os.makedirs(src, exist_ok=True)
    msgs = [{"id": "a", "type": "fraud", "amount": 5}, {"id": "b", "type": "report", "amount": 5},
            {"type": "fraud"}]
    with open(f"{src}/part-0.json", "w") as f:
        for m in msgs:
            f.write(json.dumps({"value": json.dumps(m)}) + "\n")
        f.write(json.dumps({"value": "{ this is broken json !!!"}) + "\n")
    rules_state = {"rules": [(1, "type", "equals", "fraud", "urgent")]}
    stream = spark.readStream.schema("value string").json(src)
    out = scratch_path(spark, "t-raw-out")
    q = route_stream(stream, lambda: rules_state["rules"], out, f"{out}/_ck", raw=True,
                     available_now=True)
    q.awaitTermination()
    routed = {r.id: r.target_queue for r in spark.read.parquet(f"{out}/routed").collect()}
    assert routed == {"a": "urgent.queue", "b": "batch.queue"}
    hist = spark.read.parquet(f"{out}/history").collect()
    assert all(h.latency_ms is not None and h.latency_ms > 0 for h in hist)
    dl = {r.reason for r in spark.read.parquet(f"{out}/dead_letters").collect()}
    assert dl == {"missing_required", "malformed_json"}
    # A rule change is picked up by the next micro-batch
    rules_state["rules"] = [(1, "type", "equals", "report", "urgent")]
    with open(f"{src}/part-1.json", "w") as f:
        f.write(json.dumps({"value": json.dumps({"id": "c", "type": "report"})}) + "\n")
    q = route_stream(spark.readStream.schema("value string").json(src), lambda: rules_state["rules"],
                     out, f"{out}/_ck", raw=True, available_now=True)
    q.awaitTermination()
    routed = {r.id: r.target_queue for r in spark.read.parquet(f"{out}/routed").collect()}
    assert routed["c"] == "urgent.queue" and routed["a"] == "urgent.queue"


def test_rule_table_changes_reach_the_router(spark):
    from routelytics.operators.rules import apply_rule_changes
    from routelytics.schemas import RULE_CHANGE
    from routelytics.sources.seed import seed_rules, write_rules
    from routelytics.streaming.router import rules_from_table
    rules_path = scratch_path(spark, "t-rules")
    write_rules(seed_rules(spark, [(1, "type", "equals", "fraud", "urgent", "fraud")]), rules_path)
    src = scratch_path(spark, "t-rt-src")
    os.makedirs(src, exist_ok=True)
    with open(f"{src}/0.json", "w") as f:
        f.write(json.dumps({"value": json.dumps({"id": "a", "type": "report"})}) + "\n")
    out = scratch_path(spark, "t-rt-out")
    loader = rules_from_table(spark, rules_path)
    run = lambda: route_stream(spark.readStream.schema("value string").json(src), loader, out,
                               f"{out}/_ck", raw=True, available_now=True).awaitTermination()
    run()
    change = spark.createDataFrame([(1, "create", "r0002", "type", "equals", "report", None, "urgent", 2,
                                     "eventType", None)], RULE_CHANGE)
    new_rules, _ = apply_rule_changes(spark.read.parquet(rules_path), change)
    from routelytics.schemas import RULE
    snapshot = spark.createDataFrame(new_rules.collect(), RULE)   # rule tables are bounded
    write_rules(snapshot, rules_path)                             # same table, same loader
    with open(f"{src}/1.json", "w") as f:
        f.write(json.dumps({"value": json.dumps({"id": "b", "type": "report"})}) + "\n")
    run()
    got = {r.id: r.target_queue for r in spark.read.parquet(f"{out}/routed").collect()}
    assert got == {"a": "batch.queue", "b": "urgent.queue"}


def test_latest_start_skips_existing_messages(spark):
    import time
    src = scratch_path(spark, "t-latest")
    spark.createDataFrame([("old",)], "id string").write.mode("append").parquet(src)
    time.sleep(1.2)
    s = read_messages_stream(spark, src, spark.createDataFrame([], "id string").schema, start="latest")
    time.sleep(1.2)
    spark.createDataFrame([("new",)], "id string").write.mode("append").parquet(src)
    out = scratch_path(spark, "t-latest-out")
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_ck") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.read.parquet(out).collect()] == ["new"]


def test_restart_of_a_latest_stream_reads_what_came_while_it_was_down(spark):
    from routelytics.sources.messages import first_start
    src, out, ck = (scratch_path(spark, f"t-down-{k}") for k in ("src", "out", "ck"))
    schema = spark.createDataFrame([], "id string").schema

    def write(x):
        spark.createDataFrame([(x,)], "id string").coalesce(1).write.mode("append").parquet(src)

    def run():
        s = read_messages_stream(spark, src, schema, start="latest", since_ms=first_start(spark, ck))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck) \
            .trigger(availableNow=True).start().awaitTermination()
    first_start(spark, ck)
    write("while up")
    run()
    write("while down")
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["while down", "while up"]


def test_console_sink_runs(spark):
    from routelytics.streaming.router import console_sink
    src = scratch_path(spark, "t-console")
    spark.createDataFrame([("a", "fraud")], "id string, type string").write.parquet(src)
    s = read_messages_stream(spark, src, spark.read.parquet(src).schema)
    q = console_sink(s, scratch_path(spark, "t-console-ck"))
    q.processAllAvailable()
    progress = q.lastProgress
    q.stop()
    assert progress is not None and progress["numInputRows"] == 1


def test_urgent_consumer_sends_five_broken_messages_to_dead_letters(spark):
    from routelytics.streaming.consumers import start_urgent_consumer_raw
    src, out = scratch_path(spark, "t-urgent-src"), scratch_path(spark, "t-urgent-out")
    texts = ['{"id":"a","type":"fraud","benchmarkId":"b1"}', "{ broken", "not json at all", '{"type":"fraud"}',
             '{"id":"x"}', '{"id":"","type":"fraud"}', '{"id":"c","type":"payment","amount":5}']
    spark.createDataFrame([(t,) for t in texts], "value string").write.parquet(src)
    start_urgent_consumer_raw(spark.readStream.schema("value string").parquet(src), out, f"{out}/_ck",
                              available_now=True).awaitTermination()
    assert sorted(r.message_id for r in spark.read.parquet(f"{out}/processed").collect()) == ["a", "c"]
    letters = [r.reason for r in spark.read.parquet(f"{out}/dead_letters").collect()]
    assert sorted(letters) == ["malformed_json"] * 2 + ["missing_required"] * 3
