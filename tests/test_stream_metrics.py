"""ST5 (depth nets and running depth as streams), ST6 (live metrics per trigger) and ST8
(one commit a micro-batch) against the batch forms."""

import pytest

from pyspark.sql import functions as F

from conftest import SF001
from routelytics.operators.metrics import live_metrics
from routelytics.operators.queues import depth_from_nets, queue_depth_series
from routelytics.plans import fixture as FX
from routelytics.session import scratch_path
from routelytics.sinks.commits import CommitLog
from routelytics.sources.seed import SEED_RULES
from routelytics.streaming.consumers import depth_deltas_stream, live_metrics_stream, running_depth_stream
from routelytics.streaming.router import routing_batch, stamp_received


def test_depth_stream_matches_batch_on_closed_windows(spark):
    h = FX.history(spark, SF001).select("benchmark_id", "message_id", "target_queue", "ts")
    p = FX.processed(spark, SF001)
    hdir, pdir = scratch_path(spark, "t-dep-h"), scratch_path(spark, "t-dep-p")
    h.write.parquet(hdir)
    p.select("benchmark_id", "message_id", "target_queue", "processed_ms").write.parquet(pdir)
    hs = spark.readStream.schema(spark.read.parquet(hdir).schema).parquet(hdir)
    ps = spark.readStream.schema(spark.read.parquet(pdir).schema).parquet(pdir)
    out, ck = scratch_path(spark, "t-dep-out"), scratch_path(spark, "t-dep-ck")
    for _ in range(2):  # the second run closes the windows below the watermark
        q = depth_deltas_stream(hs, ps).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    streamed = {(r.target_queue, r.window_start): r.net for r in spark.read.parquet(out).collect()}
    batch = {(r.target_queue, r.window_start): r.net
             for r in queue_depth_series(FX.history(spark, SF001), FX.processed(spark, SF001)).collect()}
    assert streamed and all(batch[k] == v for k, v in streamed.items())
    closed_until = max(k[1] for k in streamed)
    assert {k for k in batch if k[1] <= closed_until} == set(streamed)
    d = depth_from_nets(spark.read.parquet(out))
    assert d.count() == len(streamed)


def _arriving(spark, df, name, order, n=4):
    """A stream whose ``n`` files come one after the other, in the order of a column."""
    path, parts = scratch_path(spark, name), [r[0] for r in df.selectExpr(f"inline(transform(approx_percentile({order}, array({', '.join(str((i + 1) / n) for i in range(n - 1))})), x -> named_struct('x', x)))").collect()]
    lows = [None, *parts]
    for i, low in enumerate(lows):
        rows = df if low is None else df.filter(F.col(order) > F.lit(low))
        rows = rows if i == len(lows) - 1 else rows.filter(F.col(order) <= F.lit(parts[i]))
        rows.coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_live_metrics_equal_the_endpoints_after_every_batch(spark):
    h = FX.history(spark, SF001).withColumn("n", F.substring("message_id", 5, 9).cast("long"))
    src = _arriving(spark, h, "t-live-h", "n")
    out, ck = scratch_path(spark, "t-live-out"), scratch_path(spark, "t-live-ck")
    q = live_metrics_stream(src, out, ck, rows=300, available_now=True)
    q.awaitTermination()
    log = CommitLog(spark, out)
    reads = {p["batchId"]: p["numInputRows"] for p in q.recentProgress if p["numInputRows"]}
    cuts = sorted(reads)
    assert len(cuts) == 4 and sum(reads.values()) == h.count()
    seen = 0
    for b in cuts:
        seen += reads[b]
        so_far = h.orderBy("n").limit(seen)
        assert log.last("metrics", before=b + 1).collect() == live_metrics(so_far, 300).collect()
        assert log.last("newest", before=b + 1).count() == min(300, seen)
    # a replay of the last batch, whose commit is there, changes nothing
    before = [tuple(r) for r in log.read("metrics").collect()]
    fn = {}
    live_metrics_stream(_Fake(h, fn), out, ck, rows=300, available_now=True)
    fn["run"](h.limit(5), cuts[-1])
    assert [tuple(r) for r in log.read("metrics").collect()] == before


class _Fake:
    """A stream that hands its foreachBatch function out."""

    def __init__(self, df, fn):
        self.writeStream, self.fn = self, fn

    def foreachBatch(self, run):
        self.fn["run"] = run
        return self

    def __getattr__(self, name):
        return lambda *a, **k: self


def test_running_depth_equals_the_batch_series(spark):
    h = FX.history(spark, SF001).select("benchmark_id", "message_id", "target_queue", "ts")
    p = FX.processed(spark, SF001).select("benchmark_id", "message_id", "target_queue", "processed_ms")
    bad = FX.rejected_letters(spark, SF001).select("original_queue", "benchmark_id", "message_id", "failed_at")
    # a message is in the processed log or in the dead letters
    p = p.join(bad.select("benchmark_id", "message_id"), ["benchmark_id", "message_id"], "left_anti")
    bad = bad.join(h.select("benchmark_id", "message_id", "target_queue"), ["benchmark_id", "message_id"]).select(
        F.col("target_queue").alias("original_queue"), "benchmark_id", "message_id", "failed_at")
    ms = lambda df, c: df.withColumn("at", c)
    streams = [_arriving(spark, ms(df, c), f"t-run-{i}", "at") for i, (df, c) in enumerate([
        (h, F.unix_millis("ts")), (p, F.col("processed_ms")), (bad, F.unix_millis("failed_at"))])]
    out, ck = scratch_path(spark, "t-run-out"), scratch_path(spark, "t-run-ck")
    nets = depth_deltas_stream(streams[0], streams[1], rejected_stream=streams[2], delay="20 days")  # files end at different stamps
    running_depth_stream(nets, out, ck, available_now=True).awaitTermination()
    log = CommitLog(spark, out)
    got = {(r.target_queue, r.window_start): (r.net, r.depth) for r in log.read("depth").collect()}
    want = {(r.target_queue, r.window_start): (r.net, r.depth) for r in queue_depth_series(
        FX.history(spark, SF001), FX.processed(spark, SF001), rejected=bad).collect()}
    closed = max(k[1] for k in got)
    assert got == {k: v for k, v in want.items() if k[1] <= closed} and len(got) > 100
    assert len([1 for _ in log._live()]) > 2  # over several batches


STEPS = ["wrote dead_letters", "wrote routed", "wrote history", "publish"]


def test_a_failure_between_any_two_writes_leaves_readers_on_the_old_state(spark):
    out = scratch_path(spark, "t-commit")
    rules = lambda: SEED_RULES
    feed = FX.raw_feed(spark, SF001).select("key", "value")
    parts = [stamp_received(x) for x in feed.randomSplit([1.0, 1.0, 1.0], seed=1)]
    state = lambda: {t: sorted(map(str, CommitLog(spark, out).read(t).collect())) for t in ("routed", "dead_letters", "history")}
    routing_batch(rules, out, raw=True)(parts[0], 0)
    old = state()
    for at in STEPS:
        def fail(name):
            if name == at:
                raise RuntimeError(at)
        with pytest.raises(RuntimeError, match=at):
            routing_batch(rules, out, raw=True, step=fail)(parts[1], 1)
        assert state() == old and not CommitLog(spark, out).committed(1)
    with pytest.raises(RuntimeError):  # published, but the stream did not hear of it
        def late(name):
            if name == "published":
                raise RuntimeError
        routing_batch(rules, out, raw=True, step=late)(parts[1], 1)
    new = state()
    assert all(len(new[t]) > len(old[t]) for t in new)
    routing_batch(rules, out, raw=True)(parts[1], 1)  # its replay
    assert state() == new
    routing_batch(rules, out, raw=True)(parts[2], 2)
    whole = state()
    for at in ["wrote dead_letters", "wrote routed", "wrote history", "publish"]:
        def fail(name):
            if name == at:
                raise RuntimeError(at)
        with pytest.raises(RuntimeError):
            CommitLog(spark, out, fail).compact(1)
        assert state() == whole
    log = CommitLog(spark, out)
    log.compact(1)
    assert state() == whole and [n for _, _, n in log._live()] == ["0-1.json", "2.json"]
    log.vacuum()
    assert state() == whole and log.committed(0) and log.committed(1) and not log.committed(3)
    routing_batch(rules, out, raw=True)(parts[1], 1)
    assert state() == whole
    log.compact(2)
    log.vacuum()
    assert state() == whole and [n for _, _, n in log._live()] == ["0-2.json"]
    assert len(whole["routed"]) + len(whole["dead_letters"]) == feed.count()
