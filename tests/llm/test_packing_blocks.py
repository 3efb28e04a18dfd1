"""The rounds of packing: blocks as the rows ask for, pairs across blocks, workers' memory."""

import numpy as np
import pytest

from routelytics.llm import packing as P
from routelytics.llm.common import Scratch


@pytest.fixture()
def wide(spark):
    """A session that asks for more shuffle partitions than small tables need."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _lengths(spark, n=600):
    rng = np.random.default_rng(3)
    sizes = np.where(rng.random(n) < .3, rng.integers(1, 40, n), rng.integers(1, P.CAPACITY + 1, n))
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "item long, size int")


def _packed(lengths, spark, monkeypatch):
    """Placed rows by sequence, and the number of partitions of each swept table."""
    blocks, table = [], Scratch.table

    def spied(self, df, name, keep=True):
        if name == "swept":
            blocks.append(df.rdd.getNumPartitions())
        return table(self, df, name, keep)
    monkeypatch.setattr(Scratch, "table", spied)
    rows = P.best_fit(lengths, Scratch(spark, "t-blocks")).collect()
    assert sorted((r.item, r.size) for r in rows) == sorted(map(tuple, lengths.collect()))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.size))
    for parts in seqs.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= P.CAPACITY
    return seqs, blocks


def test_blocks_are_as_many_as_the_rows_ask_for(wide, monkeypatch):
    lengths = _lengths(wide)
    few, blocks = _packed(lengths, wide, monkeypatch)
    assert blocks and set(blocks) == {1}  # not one a shuffle partition
    monkeypatch.undo()
    monkeypatch.setattr(P, "BLOCK_ROWS", 50)
    many, blocks = _packed(lengths, wide, monkeypatch)
    assert max(blocks) > 8 and max(blocks) <= 24
    bound = P.lower_bound({r[0]: r[1] for r in lengths.groupBy("size").count().collect()}, P.CAPACITY)
    assert bound <= len(few) <= 1.02 * bound + 1 and bound <= len(many) <= 1.02 * bound + 1


def test_rounds_give_back_the_words_of_tokenising(spark):
    def used(batches):
        import pyarrow as pa
        import tokenizers  # noqa: F401
        encode = P._worker_ids(open(P.default_tokenizer()).read())
        for _ in batches:
            encode([b"some words to remember"])
            known = len(encode.known)
            assert list(P._sweep(iter([]))) == []
            yield pa.RecordBatch.from_arrays([pa.array([known]), pa.array([len(encode.known)])], ["before", "after"])

    got = spark.range(1).mapInArrow(used, "before long, after long").first()
    assert got.before > 0 and got.after == 0
