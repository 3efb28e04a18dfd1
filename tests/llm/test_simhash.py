import random

import numpy as np
import pytest
import xxhash
from helpers import EDGE_ROWS, Union, clashing, edge, empty, rows

from conftest import SF001
from routelytics.llm import simhash as SH
from routelytics.llm.common import Scratch
from routelytics.llm.components import components


def _fingerprint(text):
    """Bit by bit, as the contract says it."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    ws = [w for w in low.split(" ") if w]
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, fps, most=4):
    u = Union(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                u.join(i, j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[u.find(i)] = min(low.get(u.find(i), x), x)
    return [low.get(u.find(i)) for i in range(len(fps))]


def _check(data, got):
    fps = [_fingerprint(t) for _, t in data]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(data, fps, _components([i for i, _ in data], fps))), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == want


def test_documents_and_edges_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    _check([(r.doc_id, r.text) for r in docs.collect()], SH.simhash_components(docs).collect())
    _check([(r[0], r[1]) for r in EDGE_ROWS], SH.simhash_components(edge(spark)).collect())


@pytest.mark.parametrize("cell_rows", [100_000, 9])
def test_links_lose_no_connection(spark, cell_rows):
    """Dense clusters, chains of single flips and noise; also with cells split into chunks."""
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        centre = r.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(150)}
    x = r.getrandbits(64)
    for _ in range(60):
        x ^= sum(1 << b for b in r.sample(range(64), 4))
        fps.add(x)
    fps = sorted(fps)
    as_long = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in as_long], "fp long").repartition(4)
    s = Scratch(spark, "test-simhash")
    edges = s.table(SH.links(df, s, 4, cell_rows), "edges")
    u, place = Union(len(fps)), {f: i for i, f in enumerate(as_long)}
    for e in edges.collect():
        assert (fps[place[e.a]] ^ fps[place[e.b]]).bit_count() <= 4
        u.join(place[e.a], place[e.b])
    close = sum((a ^ b).bit_count() <= 4 for i, a in enumerate(fps) for b in fps[:i])
    assert edges.count() <= max(close / 2, 6 * len(fps))  # forests of the large cells, not all pairs
    want = Union(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                want.join(i, j)
    same = {}
    for i in range(len(fps)):
        assert same.setdefault(want.find(i), u.find(i)) == u.find(i)
    assert len(set(same.values())) == len(same)


def test_manhattan_distance_of_the_embedding_is_a_lower_bound(spark):
    r = random.Random(6)
    pairs = [(a := r.getrandbits(64), a ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9)))) for _ in range(500)]
    as_long = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(as_long(a), as_long(b)) for a, b in pairs], "a long, b long")
    got = df.select("a", "b", SH._counts(df.a).alias("ca"), SH._counts(df.b).alias("cb")).collect()
    for row in got:
        a, b, ca, cb = (x % (1 << 64) for x in row)
        counts = lambda f: [(f >> 2 * i & 1) + (f >> 2 * i + 1 & 1) for i in range(32)]
        assert [ca >> 2 * i & 3 for i in range(32)] == counts(a)
        assert sum(abs(p - q) for p, q in zip(counts(a), counts(b))) <= (a ^ b).bit_count()


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test-components")).collect()
    root = {r.u: r.v for r in got}
    assert all(root[i] == 0 for i in range(1, 41)) and all(root[100 + i] == 100 for i in range(1, 30))
    assert root[201] == root[202] == 200 and len(got) == 40 + 29 + 2
    none = spark.createDataFrame([], "a long, b long")
    assert components(none, Scratch(spark, "test-components")).collect() == []


def test_empty_and_clashing(spark):
    assert SH.simhash_components(empty(spark)).collect() == []
    assert rows(SH.simhash_components(clashing(spark))) == rows(SH.simhash_components(edge(spark)))
