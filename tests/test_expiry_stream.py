"""ST4: the stream-stream expiry join emits exactly the unprocessed messages
once a later row moves the watermark; the batch form agrees."""

import datetime as dt

from routelytics.operators.queues import expire_to_dead_letter
from routelytics.session import scratch_path
from routelytics.streaming.expiry import expire_stream

R = "benchmark_id string, message_id string, target_queue string, ts timestamp"
P = "benchmark_id string, message_id string, processed_ms long"


def test_expiry_stream(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    ms = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    routed1 = [("b", f"m{i}", "urgent.queue", t0 + dt.timedelta(seconds=i)) for i in range(6)]
    proc1 = [("b", "m0", ms(t0) + 2000), ("b", "m2", ms(t0) + 2000 + 3000), ("b", "m4", ms(t0) + 4000 + 60_000)]
    late = [("b", "z", "batch.queue", t0 + dt.timedelta(hours=2))]
    late_p = [("b", "z", ms(t0 + dt.timedelta(hours=2)) + 1)]
    rdir, pdir = scratch_path(spark, "t-exp-r"), scratch_path(spark, "t-exp-p")
    spark.createDataFrame(routed1, R).coalesce(1).write.parquet(f"{rdir}/1")
    spark.createDataFrame(proc1, P).coalesce(1).write.parquet(f"{pdir}/1")
    rs = spark.readStream.schema(R).option("recursiveFileLookup", "true").parquet(rdir)
    ps = spark.readStream.schema(P).option("recursiveFileLookup", "true").parquet(pdir)
    out = expire_stream(rs, ps, ttl="10 seconds", delay="1 minute")
    sink = scratch_path(spark, "t-exp-out")
    ck = scratch_path(spark, "t-exp-ck")
    q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck) \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.createDataFrame(late, R).coalesce(1).write.parquet(f"{rdir}/2")
    spark.createDataFrame(late_p, P).coalesce(1).write.parquet(f"{pdir}/2")
    for _ in range(2):   # the watermark moves after the batch that sees the late rows
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck) \
            .outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(r.message_id for r in spark.read.parquet(sink).collect())
    # m0, m2 processed within 10 s; m4 processed after 64 s: expired; others never processed
    assert got == ["m1", "m3", "m4", "m5"]
    batch = expire_to_dead_letter(spark.createDataFrame(routed1, R), spark.createDataFrame(
        [p for p in proc1 if p[2] - ms(t0) <= 10_000 + int(p[1][1:]) * 1000], P),
        now_ms=ms(t0) + 3_600_000, ttl_ms=10_000)
    assert sorted(r.message_id for r in batch.collect()) == got


def test_expiry_with_missing_cohorts_rejects_replays_and_late_rows(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    ms = lambda s: int((at(s) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    B = "benchmark_id string, message_id string, failed_at timestamp"
    steps = [  # routed, processed, rejected of each micro-batch
        ([(None, "done", "urgent.queue", at(0)), (None, "open", "urgent.queue", at(0)), ("b", "open", "batch.queue", at(1)),
          ("b", "bad", "urgent.queue", at(1)), ("b", "late-bad", "urgent.queue", at(1)), ("b", "twice", "urgent.queue", at(5)),
          ("b", "nostamp", "urgent.queue", None), ("b", None, "urgent.queue", at(2)), (None, "replayed", "urgent.queue", at(3))],
         [(None, "done", ms(1)), ("b", "early", ms(2)), (None, None, ms(3))], [("b", "bad", at(4)), ("b", "late-bad", at(40))]),
        ([("b", "twice", "batch.queue", at(2)), ("b", "early", "batch.queue", at(1)), (None, "replayed", "urgent.queue", at(3)),
          ("t", "tick", "batch.queue", at(7200))], [(None, "replayed", ms(4)), ("t", "tick", ms(7200))], [("t", "tick", at(7200))]),
        # after the letters: replays and rows that come too late change nothing
        ([(None, "open", "urgent.queue", at(0)), ("b", "twice", "urgent.queue", at(5)), ("t", "tock", "batch.queue", at(14_400))],
         [("b", "open", ms(2)), ("t", "tock", ms(14_400))], [("b", "twice", at(3)), ("t", "tock", at(14_400))])]
    kinds = {"r": R, "p": P, "x": B}
    where = {k: scratch_path(spark, f"t-exq-{k}") for k in kinds}
    sink, ck = scratch_path(spark, "t-exq-out"), scratch_path(spark, "t-exq-ck")
    all_ = {k: [] for k in kinds}
    for i, step in enumerate(steps):
        for k, data in zip(kinds, step):
            spark.createDataFrame(data, kinds[k]).coalesce(1).write.parquet(f"{where[k]}/{i}")
            all_[k] += data if i < 2 else []
        streams = {k: spark.readStream.schema(s).option("recursiveFileLookup", "true").parquet(where[k]) for k, s in kinds.items()}
        expire_stream(streams["r"], streams["p"], rejected=streams["x"]).writeStream.format("parquet").option("path", sink) \
            .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(((r.benchmark_id, r.message_id, r.original_queue, r.failed_at) for r in df.collect()), key=repr)
    got = key(spark.read.parquet(sink))
    assert got == sorted([(None, "open", "urgent.queue", at(10)), ("b", "open", "batch.queue", at(11)), ("b", "late-bad", "urgent.queue", at(11)),
                          ("b", "twice", "batch.queue", at(12)), ("b", None, "urgent.queue", at(12))], key=repr)
    r, p, x = (spark.createDataFrame(all_[k], s) for k, s in kinds.items())
    assert key(expire_to_dead_letter(r, p, ms(7000), 10_000, rejected=x)) == got
