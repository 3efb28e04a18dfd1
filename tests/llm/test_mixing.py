import hashlib
import re
from collections import Counter, defaultdict

from helpers import EDGE_ROWS, SCHEMA, clashing, edge, empty, rows

from conftest import SF001
from routelytics.llm.common import Scratch, running_totals
from routelytics.llm.mixing import mix


def _brute(data):
    """Sequential weighted fair queueing; (doc_id, size, source_size, target, taken) rows."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data]
    per = defaultdict(int)
    for r, n in zip(data, size):
        per[r[3]] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, budget = set(), 1.5 * sum(per.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (budget - sum(2 * per[s] for s in capped)) / sum(weight[s] for s in free) if free and budget else 0
        new = {s for s in free if weight[s] * level > 2 * per[s]}
        if not new:
            break
        capped |= new
    target = {s: min(2.0 * per[s], weight[s] * level) for s in order}
    key = [hashlib.sha256(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest() for r in data]
    copies = []
    for s in order:
        sent = 0
        for i in sorted((i for i, r in enumerate(data) if r[3] == s), key=lambda i: (key[i], i)):
            sent += size[i]
            if size[i]:
                copies += [((e * per[s] + sent) / target[s], s is None, s or "", key[i], i, e) for e in (0, 1)]
    taken, total = Counter(), 0
    for *_, i, _ in sorted(copies):
        total += size[i]
        if total > sum(target.values()):
            break
        taken[i] += size[i]
    return [(r[0], size[i], per[r[3]], target[r[3]], taken[i]) for i, r in enumerate(data)]


COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    data = [tuple(r) for r in docs.collect()]
    want = sorted(_brute(data))
    assert rows(mix(docs), *COLUMNS) == sorted(want, key=repr)
    assert rows(mix(docs.repartition(7)), *COLUMNS) == sorted(want, key=repr)


def test_hot_source_and_targets(spark):
    data = [(i, "w " * (1 + i % 9), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(900)]
    data += [(1000 + i, "w " * 4, "en", None, 1) for i in range(20)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = mix(df).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(_brute(data))
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    per = defaultdict(lambda: [0, 0, 0])
    source = {r[0]: r[3] for r in data}
    for r in got:
        x = per[(source[r["doc_id"]], r["target"])]
        x[0] += r["taken"]
        x[1] = max(x[1], r["size"])
    assert all(abs(taken - target) <= big for (_, target), (taken, big, _) in per.items())


def test_edges(spark):
    got = mix(edge(spark)).collect()
    assert len(got) == len(EDGE_ROWS) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert rows(mix(clashing(spark)), *COLUMNS) == rows(mix(edge(spark)), *COLUMNS)
    assert mix(empty(spark)).collect() == []
    assert {r["taken"] for r in mix(spark.createDataFrame([(1, "", "a", "a", 0), (2, None, "a", "b", 0)], SCHEMA)).collect()} == {0}


def test_running_totals(spark):
    data = [(g, i, (i * 7) % 5) for g in ("a", "b", None) for i in range(100 if g == "a" else 13)]
    df = spark.createDataFrame(data, "g string, i int, v long").repartition(5)
    s = Scratch(spark, "test-totals")
    from pyspark.sql import functions as F
    got = {(r["g"], r["i"]): r["t"] for r in running_totals(df, [F.col("g").asc_nulls_last(), "i"], "v", "t", s, "g").collect()}
    for g in ("a", "b", None):
        total = 0
        for _, i, v in sorted((x for x in data if x[0] == g), key=lambda x: x[1]):
            total += v
            assert got[(g, i)] == total
