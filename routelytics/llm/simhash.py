"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two; the vector of their
popcounts embeds it in a grid, where the Manhattan distance of two vectors is a lower
bound of the fingerprints' bit distance.  The range join on that grid: the axes form
``max_bits + 3`` groups, and a pair within ``max_bits`` differs on at most that many
of them, so it agrees on at least three groups; every fingerprint is therefore filed
under each choice of three groups (its projected grid cell), and pairs meet in a cell.
There the Manhattan bound is tested over all axes, then the bit distance exactly.

Copies fall together first (one row per distinct fingerprint), and a cell of more than
a few rows emits a spanning forest of its links, never all pairs; an edge is emitted only in the first
cell its ends share, which loses no connection (by induction over the cells' order).
Cells above ``cell_rows`` are split into chunks whose pairs are searched separately.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .components import components

SEED = 42
LOW = 0x5555555555555555
#: Cells up to this size are searched by comparing rows at every offset, and all their links
#: (fewer than this for a row) emitted; larger ones give a spanning forest.
SHORT = 12


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash (unsigned) of a text's word shingles; no words: zero."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not ws:
        return 0
    buf, h = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return h(buf, SEED)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(ws) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    counts, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(starts), step):
        x = np.array([h(buf[a:b], SEED) for a, b in zip(starts[i:i + step], stops[i:i + step])], np.uint64)
        counts += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(id, text_hash, fp) of every row; ``fp`` holds the 64 bits as a long."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, text_hash long, fp long")


def _counts(fp: Column) -> Column:
    """The 32 popcounts, each in two bits of a long."""
    high = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(high).bitwiseAND(F.lit(LOW))
    two = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _plan(max_bits: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Masks of the axis groups, and the choices of three groups in order."""
    n = max_bits + 3
    axes = [range(i * 32 // n, (i + 1) * 32 // n) for i in range(n)]
    return [sum(3 << (2 * a) for a in x) for x in axes], list(combinations(range(n), 3))


def _searcher(max_bits: int):
    masks, choices = _plan(max_bits)
    masks_u = [np.uint64(m) for m in masks]
    #: groups below a choice's last that it leaves out: none of them may agree
    earlier = [[g for g in range(c[-1]) if g not in c] for c in choices]
    low, one = np.uint64(LOW), np.uint64(1)

    def counts(f):
        return ((f ^ (f >> one)) & low) | ((f & (f >> one) & low) << one)

    def close(f, g):
        """Manhattan distance of the count vectors first, bit distance of what is left."""
        x = counts(f) ^ counts(g)
        a, b = x & low, (x >> one) & low
        near = np.bitwise_count(a).astype(np.int16) + 2 * np.bitwise_count(b & ~a) <= max_bits
        near[near] = np.bitwise_count((f ^ g)[near] if len(f) == len(near) else f ^ g[near]) <= max_bits
        return near

    def first_cell(f, g, choice):
        """Whether this choice is the first that the pair shares."""
        x, ok = counts(f) ^ counts(g), np.ones(len(f), bool)
        for k in np.unique(choice):
            at = choice == k
            for e in earlier[k]:
                ok[at] &= (x[at] & masks_u[e]) != 0
        return ok

    def forest(f):
        """Edges of a spanning forest of the links among the fingerprints of one cell."""
        left, out = np.arange(len(f)), []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                p = queue.pop()
                near = close(f[left], np.full(len(left), f[p]))
                hit = left[near]
                if len(hit):
                    out.append(np.stack([np.full(len(hit), p), hit]))
                    queue.extend(hit.tolist())
                    left = left[~near]
        return np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)

    def search(choice, group, f):
        """Edges among rows sorted by (choice, group)."""
        new = np.flatnonzero(np.concatenate(([True], (choice[1:] != choice[:-1]) | (group[1:] != group[:-1]))))
        size = np.diff(np.concatenate((new, [len(f)])))
        run = np.repeat(np.arange(len(new)), size)
        pairs = []
        short = size[run] <= SHORT
        for d in range(1, min(SHORT, int(size.max()))):
            i = np.flatnonzero((run[d:] == run[:-d]) & short[d:])
            if not len(i):
                break
            i = i[close(f[i], f[i + d])]
            pairs.append(np.stack([i, i + d]))
        for r in np.flatnonzero(size > SHORT):
            pairs.append(forest(f[new[r]:new[r] + size[r]]) + new[r])
        if not pairs:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        i, j = np.concatenate(pairs, 1)
        ok = (f[i] != f[j]) & first_cell(f[i], f[j], choice[i])
        return f[i[ok]], f[j[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the group that may go on in the next batch
        def emit(c, g, f):
            a, b = search(c, g, f)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        for batch in batches:
            now = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("choice", "cell", "fp")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            c, g, f = now
            cut = int(np.searchsorted((c == c[-1]) & (g == g[-1]), True))  # the last group stands at the end
            held = [x[cut:] for x in now]
            if cut:
                yield emit(c[:cut], g[:cut], f[:cut].astype(np.int64).view(np.uint64))
        if held is not None and len(held[0]):
            yield emit(held[0], held[1], held[2].astype(np.int64).view(np.uint64))
    return run


def links(fps: DataFrame, s: Scratch, max_bits: int = 4, cell_rows: int = 100_000) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints ``fps.fp`` (distinct) which
    are joined by steps of at most ``max_bits`` differing bits."""
    spark = fps.sparkSession
    masks, choices = _plan(max_bits)
    cells = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("_c").bitwiseAND(
        F.lit(_signed(sum(masks[g] for g in c)))).alias("cell")) for k, c in enumerate(choices)])
    filed = (fps.select("fp", _counts(F.col("fp")).alias("_c")).select("fp", F.explode(cells).alias("x"))
             .select("x.choice", "x.cell", "fp"))
    # cells by size: partial counts first; only the oversize ones are kept
    big = s.table(filed.groupBy("choice", "cell").count().filter(F.col("count") > cell_rows), "big")
    if not big.isEmpty():
        n = F.ceil(F.col("count") / cell_rows).cast("int")
        mine = F.pmod(F.xxhash64("fp"), n).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.xxhash64(
            F.least(j, F.col("_i")), F.greatest(j, F.col("_i")), F.col("cell")))
        split = filed.join(big, ["choice", "cell"]).select("choice", "cell", "fp", n.alias("_n"), mine.alias("_i"))
        split = split.select("choice", F.explode(pair).alias("cell"), "fp")
        filed = filed.join(big, ["choice", "cell"], "left_anti").select("choice", "cell", "fp").union(split)
    sorted_cells = (filed.repartition(partitions(spark), "choice", "cell")
                    .sortWithinPartitions("choice", "cell", "fp"))
    return sorted_cells.mapInArrow(_searcher(max_bits), "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                       cell_rows: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, fingerprint (16 hex digits),
    component_id (smallest id reachable over links of at most ``max_bits`` bits),
    component (a number of the component, also where it has no id), text_hash.

    Null, empty and white-space texts have fingerprint zero and are linked like any
    other; a text of fewer words than a shingle is one shingle.  Null ids take part and
    are passed over by the smallest id (null if a component has no other); repeated rows
    each give a row.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "simhash")
    fps = s.table(fingerprints(docs, shingle, id_col), "fingerprints")
    classes = s.table(fps.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    edges = s.table(links(classes, s, max_bits, cell_rows), "links")
    tree = components(edges, s)
    named = s.table(classes.join(tree, classes.fp == tree.u, "left").select(
        "fp", "low", F.coalesce("v", "fp").alias("root")), "named")
    roots = s.table(named.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    # written first, so that both sides of the joins are shuffled (or measured small) and hot keys can be split
    by_fp = s.table(named.join(roots, "root").select("fp", "component_id", "root"), "by_fp")
    return fps.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id", F.col("root").alias("component"), "text_hash")
