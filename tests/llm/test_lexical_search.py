import math
import random
import re

import numpy as np
import pytest
from helpers import EDGE_ROWS, clashing, edge, empty, rows

from conftest import SF001
from routelytics.llm import lexical_search as LS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, k=10):
    """Every item against every document, in plain integers."""
    docs = [(i, _terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n, total, df = len(docs), sum(len(t) for _, t in docs), {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, t in docs:
            m = 25 + 75 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 8 * m))
                    for w in _terms(text) if w in df)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def _words(r, n):
    return " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(min(r.randint(0, 40), r.randint(0, 40))) for _ in range(n))


def test_terms():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["a", "Z", "é", "É", "1", "-", "_", " ", "\n", "\x00", "\x7f", "漢", "\U0001f600", "@", "[", "`", "{", "/", ":"])
                       for _ in range(r.randint(0, 20)))
        assert [w.decode() for w in LS.terms(text.encode())] == _terms(text)


@pytest.mark.parametrize("block,seed,cells", [(1000, 8192, 4_000_000), (7, 50, 4_000_000), (1000, 100, 1)])
def test_random_tables(spark, monkeypatch, block, seed, cells):
    monkeypatch.setattr(LS, "CELLS", cells)  # small batches: many trees per task
    r = random.Random(2)
    docs = [(i // 2 if i % 9 == 0 else i, _words(r, r.choice([0, 1, 3, 20, 60, 300]))) for i in range(700)]
    docs += [(i, "same text here a1 b2") for i in range(2000, 2030)]           # ties, more than k
    items = [(i, _words(r, r.randint(1, 30))) for i in range(40)] + [(50, "same here"), (51, "zz"), (50, "a1 a1 a1")]
    got = LS.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                    spark.createDataFrame(items, "item_id long, text string"), item_block=block, seed_docs=seed)
    assert rows(got) == _brute(docs, items)


def test_bounds_pass_over_most_pairs():
    r = np.random.default_rng(3)
    texts = [" ".join(f"g{g}w{x}" for x in r.integers(0, 60, 30)) for g in range(20) for _ in range(8)]
    items = LS.Items([t.encode() for t in texts])
    items.weigh(np.full(items.width, 1000))
    s = LS.Search(items, 10, np.zeros(len(items.rows), np.int64))
    known = items.words
    ids = [sorted({known[w] for w in f"g{i % 20}w{x}".encode().split() if w in known} for x in r.integers(0, 60, 40)) for i in range(4000)]
    ids = [sorted(set().union(*x)) for x in ids]
    ptr = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    s.add(LS.Rows(ptr, np.concatenate([np.array(x, np.int64) for x in ids]), np.full(ptr[-1], 10, np.int64)),
          np.arange(4000), np.zeros(4000, bool))
    assert s.pairs < 0.4 * 160 * 4000 / LS.LEAF_DOCS  # node pairs of all levels, of the item-leaf pairs alone


def test_maxima_bound_every_member():
    r = np.random.default_rng(4)
    items = LS.Items([(" ".join(f"w{x}" for x in r.integers(0, 80, 12))).encode() for _ in range(200)])
    items.weigh(r.integers(1, 50, items.width))
    assert sorted(items.rows.tolist()) == list(range(200)) and len(items.levels[0]) == 1
    dense = []
    for level in items.levels:
        d = np.zeros((len(level), items.width), np.int64)
        d[np.repeat(np.arange(len(level)), np.diff(level.ptr)), level.terms] = level.vals
        dense.append(d)
    for up, down, fan in zip(dense, dense[1:], items.fans):
        for i in range(len(down)):
            assert (up[i // fan] >= down[i]).all()


def test_documents(spark):
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows(LS.search(docs, items)) == _brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_edges(spark):
    items = [(1, "the quick dog"), (None, "another id"), (1, "the quick dog"), (2, None), (3, ""), (4, "x" * 70_000), (5, "é 漢字 ONE")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = _brute([r[:2] for r in EDGE_ROWS], items)
    assert rows(LS.search(edge(spark), table)) == want
    clash = spark.createDataFrame([(*x, 0, 0) for x in items], "item_id long, text string, rank int, item int")
    assert rows(LS.search(clashing(spark), clash)) == want
    assert LS.search(empty(spark), table).collect() == []
    assert LS.search(edge(spark), table.limit(0)).collect() == []
    assert LS.search(edge(spark), table.filter("item_id = 2")).collect() == []
