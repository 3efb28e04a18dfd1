"""Distributed ordered scan and chunk assignment against plain sequential
computations (many blocks, several partition keys, ties on the lead column)."""

import random

from routelytics.operators.processing import assign_chunks
from routelytics.operators.scan import ordered_scan


def _rows(n=2000, seed=1):
    rnd = random.Random(seed)
    t = 0
    rows = []
    for i in range(n):
        t += rnd.choice([0, 1, 5, 50, 400, 2000])
        rows.append((f"k{i:05d}", rnd.choice(["a", "b", "c"]), t, rnd.randint(-5, 9)))
    return rows


def test_ordered_scan_matches_sequential(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id string, g string, t long, v long")
    out = {r.id: r for r in ordered_scan(df, ["g"], ["t", "id"], sums=["v"], maxes=["v"],
                                          lags=["t"], blocks=7).collect()}
    for g in "abc":
        seq = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        cum, mx, prev = 0, None, None
        for pos, (i, _, t, v) in enumerate(seq, 1):
            cum += v
            mx = v if mx is None else max(mx, v)
            o = out[i]
            assert (o.pos, o.cum_v, o.cummax_v, o.lag_t) == (pos, cum, mx, prev)
            prev = t


def _simulate(seq, size, timeout):
    """The collector: flush at ``size`` messages or after ``timeout`` idle."""
    chunks, cur, last = [], [], None
    for i, t in seq:
        if cur and last is not None and t - last >= timeout:
            chunks.append(cur)
            cur = []
        cur.append(i)
        last = t
        if len(cur) >= size:
            chunks.append(cur)
            cur = []
    if cur:
        chunks.append(cur)
    return chunks


def test_chunks_match_collector_simulation(spark):
    rows = _rows(3000, seed=5)
    df = spark.createDataFrame([(i, t) for i, _, t, _ in rows], "message_id string, ts_ms long")
    got = {}
    for r in assign_chunks(df, size=10, timeout_ms=1000, blocks=9).collect():
        got.setdefault(r.chunk_id, []).append(r.message_id)
    expected = _simulate(sorted(((i, t) for i, _, t, _ in rows), key=lambda x: (x[1], x[0])), 10, 1000)
    assert sorted(sorted(c) for c in got.values()) == sorted(sorted(c) for c in expected)


def test_chunks_per_shard(spark):
    rows = _rows(1500, seed=9)
    df = spark.createDataFrame([(i, g, t) for i, g, t, _ in rows], "message_id string, shard string, ts_ms long")
    got = {}
    for r in assign_chunks(df, shard="shard", size=4, timeout_ms=300, blocks=5).collect():
        got.setdefault(r.chunk_id, []).append(r.message_id)
    expected = []
    for g in "abc":
        seq = sorted(((i, t) for i, gg, t, _ in rows if gg == g), key=lambda x: (x[1], x[0]))
        expected += _simulate(seq, 4, 300)
    assert sorted(sorted(c) for c in got.values()) == sorted(sorted(c) for c in expected)


def test_hot_key_is_spread_over_blocks(spark):
    from pyspark.sql import functions as F
    from routelytics.operators.scan import BLK, ordered_blocks
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i, 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, t long, v long")
    per = ordered_blocks(df, ["t"], 12).filter(F.col("g") == "hot").groupBy(BLK).count().collect()
    assert len(per) >= 10 and max(r["count"] for r in per) <= 2000 / 6
    out = ordered_scan(df, ["g"], ["t"], sums=["v"], blocks=12).filter(F.col("g") == "hot")
    got = sorted((r.t, r.pos, r.cum_v) for r in out.collect())
    assert [(p, c) for _, p, c in got] == [(i, i) for i in range(1, 2001)]


def test_tied_and_missing_stamps_are_spread_over_blocks(spark):
    from routelytics.operators.scan import BLK, ordered_blocks
    rows = [(None if i % 20 == 0 else 5 if i % 10 else i, f"k{i:05d}", "a" if i % 2 else None, 1) for i in range(10000)]
    df = spark.createDataFrame(rows, "t long, id string, g string, v long").repartition(5)
    per = [r["count"] for r in ordered_blocks(df, ["t", "id"], 8).groupBy(BLK).count().collect()]
    assert len(per) == 8 and max(per) < 2500
    out = {r.id: (r.pos, r.cum_v) for r in ordered_scan(df, ["g"], ["t", "id"], sums=["v"], blocks=8).collect()}
    for g in ("a", None):
        seq = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [out[r[1]] for r in seq] == [(n, n) for n in range(1, len(seq) + 1)]


def test_more_blocks_than_any_planning_grid(spark):
    rows = [(i, f"k{i:05d}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "t long, id string, v long")
    out = sorted((r.t, r.cum_v) for r in ordered_scan(df, [], ["t", "id"], sums=["v"], blocks=1500).collect())
    assert out == [(i, i + 1) for i in range(300)]
