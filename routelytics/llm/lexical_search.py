"""Ranked lexical search by dual trees: the best documents of every item, exactly.

Items are queries; a document's score for an item sums, over the item's terms, the term's
weight times the document's saturated, length-normalised frequency.  Both sides are
vectors over the items' terms with no negative entry, so the coordinate-wise maxima of a
group of items and of a group of documents bound the score of every pair between them.

The items of a block form one tree (small, on every worker), the documents of a task form
trees batch by batch; both are split in halves again and again between two unlike members,
so that alike ones share a node.  A pair of nodes is opened only if its bound reaches the
weakest k-th score known for an item below; otherwise all its pairs are passed over at
once.  k-th scores begin with those of a sample of documents, which can only be too low,
and rise as a task goes on; so nothing that belongs to the result is passed over, and the
final ranking merges the best of every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Items of a block and the bytes of their texts; cells of a batch's maxima; documents that give the first k-th scores.
ITEM_BLOCK, ITEM_BYTES, CELLS, SEED_DOCS = 1000, 4 << 20, 4_000_000, 8192
LEAF_DOCS, LEAF_ITEMS, FAN = 32, 8, 4
#: Two-level merge: the candidates of an item meet in this many groups first.
MERGE = 256

#: Bytes of a term (ASCII letters and digits, and all of other characters), capitals A-Z lowered; the rest are blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


# ------------------------------------------------------------------ sparse rows
class Rows:
    """Sparse rows: row i has ``terms[ptr[i]:ptr[i + 1]]`` (ascending) with ``vals``."""

    def __init__(self, ptr, terms_, vals):
        self.ptr, self.terms, self.vals = ptr, terms_, vals

    def __len__(self):
        return len(self.ptr) - 1

    def places(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, and where each row begins among them."""
        n = self.ptr[rows + 1] - self.ptr[rows]
        end = np.cumsum(n)
        return np.repeat(self.ptr[rows] - (end - n), n) + np.arange(end[-1] if len(end) else 0), end - n

    def take(self, rows) -> Rows:
        at, begin = self.places(rows)
        return Rows(np.append(begin, len(at)), self.terms[at], self.vals[at])

    def grouped(self, group, width: int) -> Rows:
        """Coordinate-wise maxima of groups of rows (``group``: ascending numbers from 0)."""
        key = np.repeat(group, np.diff(self.ptr)).astype(np.int64) * width + self.terms
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key = key[first]
        ptr = np.searchsorted(key, np.arange(int(group[-1]) + 2) * width)
        return Rows(ptr, key % width, np.maximum.reduceat(self.vals[order], first))


def halved(rows: Rows, width: int, leaf: int, rounds: int = 2) -> np.ndarray:
    """An order of the rows (none empty) in which alike ones stand together: each part is
    split between two unlike members, then ``rounds`` times between the means of its
    halves; the first half is a power of two leaves long."""
    order, todo = np.arange(len(rows)), [(0, len(rows))]
    size = np.diff(rows.ptr)
    norm = np.sqrt(np.add.reduceat(rows.vals.astype(float) ** 2, rows.ptr[:-1]))
    unit = rows.vals / np.repeat(np.where(norm > 0, norm, 1), size)
    pivot = np.zeros(width)

    def likeness(at, begin, row):
        a, z = rows.ptr[row], rows.ptr[row + 1]
        pivot[rows.terms[a:z]] = unit[a:z]
        out = np.add.reduceat(unit[at] * pivot[rows.terms[at]], begin)
        pivot[rows.terms[a:z]] = 0
        return out

    while todo:
        a, z = todo.pop()
        if z - a <= leaf:
            continue
        half = leaf
        while 2 * half < z - a:
            half *= 2
        part = order[a:z].copy()
        at, begin = rows.places(part)
        to_one = likeness(at, begin, part[np.argmin(likeness(at, begin, part[0]))])
        place = np.argsort(likeness(at, begin, part[np.argmin(to_one)]) - to_one, kind="stable")
        owner, term, val = np.repeat(np.arange(z - a), size[part]), rows.terms[at], unit[at]
        for _ in range(rounds):
            first = np.zeros(z - a, bool)
            first[place[:half]] = True
            mine = np.where(first[owner], 1 / half, -1 / (z - a - half)) * val
            apart = np.bincount(term, mine, width)
            place = np.argsort(-np.add.reduceat(val * apart[term], begin), kind="stable")
        order[a:z] = part[place]
        todo += [(a, a + half), (a + half, z)]
    return order


class Items:
    """The tree over a block of items; ``levels`` run from the root to single items."""

    def __init__(self, texts: list[bytes]):
        self.words: dict[bytes, int] = {}
        counts = []
        for t in texts:
            c: dict[int, int] = {}
            for w in terms(t):
                i = self.words.setdefault(w, len(self.words))
                c[i] = c.get(i, 0) + 1
            counts.append(sorted(c.items()))
        self.counts, self.width = counts, len(self.words)

    def weigh(self, weights: np.ndarray) -> None:
        """Build the tree, with one weight per term.  ``rows``: the item of each place."""
        lists = [[(t, n) for t, n in c if weights[t] > 0] for c in self.counts]
        rows = np.array([i for i, c in enumerate(lists) if c], np.int64)  # others score 0 everywhere
        self.rows, self.levels = rows, []
        if not len(rows):
            return
        ptr = np.concatenate(([0], np.cumsum([len(lists[i]) for i in rows])))
        flat = np.array([x for i in rows for x in lists[i]], np.int64)
        all_ = Rows(ptr, flat[:, 0], flat[:, 1] * weights[flat[:, 0]])
        order = halved(all_, self.width, LEAF_ITEMS)
        self.rows, level = rows[order], all_.take(order)
        self.levels, size = [level], LEAF_ITEMS
        while len(level) > 1:
            level = level.grouped(np.arange(len(level)) // size, self.width)
            self.levels.insert(0, level)
            size = FAN
        #: how many nodes of the level below one node has
        self.fans = [FAN] * (len(self.levels) - 2) + [LEAF_ITEMS] * (len(self.levels) > 1)


class Search:
    """The best ``k`` of the documents seen so far for every item of a tree."""

    def __init__(self, items: Items, k: int, least: np.ndarray):
        self.items, self.k, n = items, k, len(items.rows)
        self.least = least.copy()       # by place: no score below it can be among the best
        self.item, self.score, self.id, self.no_id = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.new, self.waiting, self.opened, self.pairs = [], 0, 0, 0
        self.low = [None] * len(items.levels)
        self.dense = np.zeros((LEAF_DOCS, items.width), np.int64)
        self.limit = max(20_000, 4 * n * k)
        self._lower()

    def _lower(self) -> None:
        """Of every node, the weakest k-th score below it."""
        low = self.least
        for i in range(len(self.items.levels) - 1, -1, -1):
            self.low[i] = low
            if i:
                low = np.minimum.reduceat(low, np.arange(0, len(low), self.items.fans[i - 1]))

    def settle(self) -> None:
        """Keep the best of each item: highest score, then smallest id, rows without id last."""
        if not self.new:
            return
        item, score, id_, none = (np.concatenate(x) for x in zip((self.item, self.score, self.id, self.no_id), *self.new))
        self.new, self.waiting = [], 0
        order = np.lexsort((id_, none, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        keep = np.arange(len(item)) - first < self.k
        order, item = order[keep], item[keep]
        self.item, self.score, self.id, self.no_id = item, score[order], id_[order], none[order]
        full = np.flatnonzero(np.bincount(item, minlength=len(self.least)) == self.k)
        last = np.searchsorted(item, full, "right") - 1
        self.least[full] = np.maximum(self.least[full], self.score[last])
        self._lower()

    def add(self, docs: Rows, ids: np.ndarray, none: np.ndarray) -> None:
        """Search a batch of documents (no row empty)."""
        it, width = self.items, self.items.width
        order = halved(docs, width, LEAF_DOCS)
        docs, ids, none = docs.take(order), ids[order], none[order]
        leaf = np.arange(len(docs)) // LEAF_DOCS
        top = np.zeros((int(leaf[-1]) + 1, width), np.int64)
        np.maximum.at(top.ravel(), np.repeat(leaf, np.diff(docs.ptr)) * width + docs.terms, docs.vals)
        maxima = [top]
        while len(maxima[-1]) > 1:
            m = maxima[-1]
            maxima.append(np.maximum.reduceat(m, np.arange(0, len(m), FAN), axis=0))
        todo = [(len(maxima) - 1, 0, 0, np.zeros(1, np.int64))]
        while todo:
            dl, d, il, nodes = todo.pop()
            level, most = it.levels[il], maxima[dl][d]
            at, begin = level.places(nodes)
            bound = np.add.reduceat(level.vals[at] * most[level.terms[at]], begin)
            self.pairs += len(nodes)
            nodes = nodes[bound >= np.maximum(self.low[il][nodes], 1)]
            if not len(nodes):
                continue
            self.opened += len(nodes)
            single = il == len(it.levels) - 1
            if not single:
                fan = it.fans[il]
                nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
                il += 1
                nodes = nodes[nodes < len(it.levels[il])]
            if dl:
                todo += [(dl - 1, c, il, nodes) for c in range(d * FAN, min((d + 1) * FAN, len(maxima[dl - 1])))]
            elif not single:
                todo.append((0, d, il, nodes))
            else:
                self._leaf(docs, d, nodes, ids, none)
        self.settle()

    def _leaf(self, docs: Rows, d: int, nodes: np.ndarray, ids, none) -> None:
        """Score the documents of a leaf for some items."""
        a, z = d * LEAF_DOCS, min((d + 1) * LEAF_DOCS, len(docs))
        p, q = docs.ptr[a], docs.ptr[z]
        cells = np.repeat(np.arange(z - a), np.diff(docs.ptr[a:z + 1])) * self.items.width + docs.terms[p:q]
        flat = self.dense.ravel()
        flat[cells] = docs.vals[p:q]
        level = self.items.levels[-1]
        at, begin = level.places(nodes)
        scores = np.add.reduceat(self.dense[:z - a, level.terms[at]] * level.vals[at], begin, axis=1)
        flat[cells] = 0
        doc, place = np.nonzero(scores >= np.maximum(self.least[nodes], 1))
        if len(doc):
            self.new.append((nodes[place], scores[doc, place], ids[a + doc], none[a + doc]))
            self.waiting += len(doc)
            if self.waiting > self.limit:
                self.settle()


# ------------------------------------------------------------------ Spark
VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"


def _vectors(docs: DataFrame, words) -> DataFrame:
    """Per document with a term: its id, number of terms, and frequencies of the items' terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        width = len(known) + 1
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.large_binary())
            for a, z in _stretches(texts):
                lists = [terms(t.as_py() or b"") for t in texts[a:z]]
                n = np.array([len(x) for x in lists], np.int64)
                found = np.fromiter((known.get(w, -1) for x in lists for w in x), np.int64, int(n.sum()))
                key = np.repeat(np.arange(z - a), n) * width + found
                key, tf = np.unique(key[found >= 0], return_counts=True)
                ptr = np.searchsorted(key, np.arange(z - a + 1) * width)
                keep = np.flatnonzero(n > 0)
                offsets = pa.array(np.concatenate((ptr[keep], ptr[-1:])), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % width, tf)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a).take(pa.array(keep)), pa.array(n[keep]), *lists],
                                                 ["doc_id", "n", "terms", "tfs"])
    return docs.mapInArrow(run, VECTORS)


def _stretches(texts, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) rows of a binary column, about ``size`` bytes at a time."""
    length = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part, a = np.cumsum(length) // size, 0
    while a < len(part):
        z = int(np.searchsorted(part, part[a], "right"))
        yield a, z
        a = z


def _statistics(vectors: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and the documents that hold each of ``width`` terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, total = np.zeros(width, np.int64), 0, 0
        for b in batches:
            docs, total = docs + b.num_rows, total + (pa.compute.sum(b.column(0)).as_py() or 0)
            held += np.bincount(b.column(1).flatten().to_numpy(), minlength=width)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], at))), pa.array(np.concatenate(([docs, total], held[at])))],
                                         ["term", "n"])
    got = vectors.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    all_ = dict(map(tuple, got))
    held = np.zeros(width, np.int64)
    for t, n in all_.items():
        if t >= 0:
            held[t] = n
    return all_.get(-2, 0), all_.get(-1, 0), held


def _best(vectors: DataFrame, items: Items, least: np.ndarray, k: int, docs: int, total: int) -> DataFrame:
    """(item: place in the tree, score, doc_id): the ``k`` best of every task for each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, k, least)
        size = LEAF_DOCS * max(1, CELLS // max(1, items.width) * 3 // 4)
        size = min(size, 8192)
        for part in _sized(batches, size):
            ids, n, lists, tfs = (part.column(c) for c in ("doc_id", "n", "terms", "tfs"))
            keep = np.flatnonzero(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False) > 0)
            if not len(keep):
                continue
            take = pa.array(keep)
            lists, tfs, ids, n = lists.take(take), tfs.take(take), ids.take(take), n.take(take).to_numpy()
            ptr = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy()))).astype(np.int64)
            tf = tfs.flatten().to_numpy().astype(np.int64)
            m = 25 + (75 * n * docs) // total
            vals = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(ptr)))
            none = pa.compute.is_null(ids).to_numpy(zero_copy_only=False)
            search.add(Rows(ptr, lists.flatten().to_numpy().astype(np.int64), vals),
                       pa.compute.fill_null(ids, 0).to_numpy(), none)
        yield pa.RecordBatch.from_arrays(
            [pa.array(search.item), pa.array(search.score), pa.array(search.id, mask=search.no_id),
             pa.array(np.full(len(search.item), TaskContext.get().partitionId() % MERGE))], ["item", "score", "doc_id", "part"])
    return vectors.mapInArrow(run, "item long, score long, doc_id long, part long")


def _sized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows again, ``size`` at a time."""
    kept, n = [], 0
    for b in batches:
        while b.num_rows:
            x = b.slice(0, size - n)
            kept.append(x)
            b, n = b.slice(x.num_rows), n + x.num_rows
            if n == size:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, n = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item over all tasks: first within groups of tasks, then over these."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item", "part").orderBy(*order)
    some = best.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= k)
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", item_block: int = ITEM_BLOCK,
           seed_docs: int = SEED_DOCS) -> DataFrame:
    """(``item_col``, rank, ``id_col``, score): the ``k`` rows of ``docs`` with the highest
    scores above 0 for every row of ``items`` (all, if fewer), best first, equal scores by
    ascending id.  ``id_col`` must be an integer column.

    Texts are taken whole; null has no terms.  Rows are ranked as they come: repeated rows
    are documents of their own, a null id comes after all others with its score, repeated
    or null item ids are items of their own.  Items without terms have no rows, and neither
    has anything when a table is empty.  Extra columns are ignored.

    Items are handled ``item_block`` (and ``ITEM_BYTES`` of text) at a time, which bounds
    what the driver and the workers hold of them; ``seed_docs`` documents, drawn at random,
    give the first k-th scores.  Neither changes the result.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "lexical-search")
    found = items.agg(F.count(F.lit(1)), F.sum(F.octet_length(item_text))).first()
    blocks = max(1, math.ceil(found[0] / item_block), math.ceil((found[1] or 0) / ITEM_BYTES))
    queries = s.table(items.select(F.col(item_col).alias("id"), F.col(item_text).alias("text"))
                      .repartition(blocks).withColumn("block", F.spark_partition_id()), "items")
    kind = items.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = []
    for block in range(blocks):
        rows = queries.filter(F.col("block") == block).select("id", "text").collect()  # at most a block
        tree = Items([(r.text or "").encode() for r in rows])
        if not tree.width:
            continue
        words = spark.sparkContext.broadcast(tree.words)
        vectors = s.table(_vectors(texts, words), f"vectors-{block}", keep=False)
        n, total, held = _statistics(vectors, tree.width)
        if not n:
            break
        tree.weigh(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * h + 1))) for h in held.tolist()], np.int64))
        if not len(tree.rows):
            continue
        tree.words, tree.counts = {}, []  # workers need the tree alone
        least = np.zeros(len(tree.rows), np.int64)
        if n > seed_docs:
            some = _ranked(_best(vectors.sample(seed_docs / n, seed=1), tree, least.copy(), k, n, total), k)
            for r in some.filter(F.col("rank") == k).select("item", "score").collect():
                least[r.item] = r.score
        best = _ranked(_best(vectors, tree, least, k, n, total), k)
        of = spark.createDataFrame([(i, rows[r].id) for i, r in enumerate(tree.rows.tolist())], f"item long, `{item_col}` {kind}")
        best = best.join(of, "item").select(item_col, "rank", F.col("doc_id").alias(id_col), "score")
        out.append(s.table(best, f"best-{block}") if blocks > 1 else best)
        if blocks > 1:  # the vectors of a block have served
            s.release()
    if not out:
        return spark.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` long, score long")
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result
