import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import rows

from conftest import SF001
from routelytics.llm import prefix_trie as PT

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _brute(table):
    own = {}
    for c, turn, role, text in table:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [x[2:] for x in sorted(own[c])]
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def under(k):
        todo, out = [k], []
        while todo:
            out.append(todo.pop())
            todo += kids.get(out[-1], [])
        return out
    out = []
    for k, cs in members.items():
        sub = under(k)
        ends = ",".join(str(c) for c in sorted(cs) if len(full[c]) == len(k))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids.get(k, [])),
                    sum(not kids.get(x) for x in sub), sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _table(r, n, texts, most):
    out = []
    for c in r.sample(range(0, 4 * n), n) + [100, 200]:
        out += [(c, r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(texts)) for t in range(r.randint(1, most))]
    return out


@pytest.mark.parametrize("seed,texts,most,shard,piece", [
    (1, ["a", "b", None, "é\U0001f600", ""], 4, 500_000, 1000), (2, ["a"], 9, 40, 3), (3, ["x", "yy"], 3, 25, 2)])
def test_random_conversations(spark, monkeypatch, seed, texts, most, shard, piece):
    monkeypatch.setattr(PT, "SHARD_TURNS", shard)
    monkeypatch.setattr(PT, "PIECE", piece)
    table = _table(random.Random(seed), 150, texts, most)
    assert rows(PT.prefix_trie(spark.createDataFrame(table, SCHEMA).repartition(3)), *COLUMNS) == _brute(table)


def test_a_conversation_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(PT, "SHARD_TURNS", 20)
    r = random.Random(4)
    long = [(r.choice(["user", "bot"]), r.choice(["a", "bb"])) for _ in range(400)]
    table = [(c, t, *x) for c, cut in ((500, 400), (501, 400), (502, 233), (503, 7), (507, 390)) for t, x in enumerate(long[:cut])]
    table += [(600 + i, t, *long[t]) for i in range(40) for t in range(3)]
    assert rows(PT.prefix_trie(spark.createDataFrame(table, SCHEMA)), *COLUMNS) == _brute(table)


def test_perfect_hash():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        keys = PT.distinct((r.integers(0, 30, n), r.integers(0, 2**60, n), r.integers(0, 3, n)))
        t = PT.PerfectHash(keys)
        assert sorted(t.slots(keys).tolist()) == list(range(len(keys[0])))
        other = tuple(k + 1 for k in keys)
        have = set(zip(*(k.tolist() for k in keys)))
        want = [x in have for x in zip(*(k.tolist() for k in other))]
        assert [s >= 0 for s in t.slots(other).tolist()] == want


def test_colliding_digests_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(PT, "PRIME", 13)
    monkeypatch.setattr(PT, "BASES", (5, 7))
    table = [(c, t, "user", f"text {c} {t}") for c in range(1, 400) for t in range(4)]
    with pytest.raises(Exception, match="share a digest"):
        PT.prefix_trie(spark.createDataFrame(table, SCHEMA)).collect()


def test_documents_table(spark):
    table = spark.read.parquet(f"{SF001}/conversations.parquet")
    assert rows(PT.prefix_trie(table), *COLUMNS) == _brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_edges(spark):
    table = [(1, 0, None, None), (1, 0, "", ""), (1, None, "user", "first"), (None, 0, "user", "no conversation"), (1, 0, "", ""),
             (7, 1, "user", "x" * 100_000), (7, 1, "user", "x" * 100_000), (300, 5, "a", "é"), (301, 5, "a", "é"), (-5, 0, "a", "b"), (-3, 1, "a", "b")]
    want = _brute([x for x in table if x[0] is None or x[0] >= 0])
    make = lambda t, s=SCHEMA: spark.createDataFrame(t, s)
    assert rows(PT.prefix_trie(make([x for x in table if x[0] is None or x[0] >= 0])), *COLUMNS) == want
    assert {r.n_convs for r in PT.prefix_trie(make(table)).filter('depth = 0').collect()} == {6}
    clash = make([(*x, "c", 1, 2, 3) for x in table if x[0] is None or x[0] >= 0], SCHEMA + ", depth string, h1 int, pos int, shard int")
    assert rows(PT.prefix_trie(clash), *COLUMNS) == want
    assert PT.prefix_trie(make([])).collect() == []
    assert PT.prefix_trie(make([(None, 1, "a", "b")])).collect() == []
