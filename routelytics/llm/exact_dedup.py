"""Exact deduplication by a content sort.

Rows are range-partitioned by sampled splitters over the normalised bytes and
sorted externally, so equal texts stand next to each other; a pass over each block
compares every text in full with its neighbour and so finds the runs of equals.

The sort key is (first bytes, SHA-256, whole text, preference): splitters stay small
whatever the texts' length, and since the preference (longest original, then
smallest id) is part of the key, a group of copies of any size spreads over many
blocks with its survivor first.  A group that crosses block borders is put together
from one row per block: whether its first text equals the last of the block before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, Scratch, partitions

#: Bytes of the text that lead the sort key (and are all of it that splitters hold).
KEY_CHARS = 32


def normalise(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours in a sorted block; texts leave the stream
    but for the block's first and last row, which the border comparison needs."""
    block, run, previous, held, place = TaskContext.get().partitionId(), -1, None, None, 0

    def out(b, runs, places, texts):
        cols = [b.column(c) for c in b.schema.names if c != "_norm"]
        names = [c for c in b.schema.names if c != "_norm"]
        n = b.num_rows
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array([block] * n, pa.int32()), pa.array(runs, pa.int64()),
             pa.array(places, pa.int64()), texts],
            [*names, "_block", "_run", "_place", "_edge"])

    for b in batches:
        if not b.num_rows:
            continue
        norm = b.column("_norm")
        if norm.type != pa.large_string():
            norm = norm.cast(pa.large_string())
        same = pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        head = previous is not None and norm[0].as_py() == previous
        runs, r = [], run if head else run + 1
        runs.append(r)
        for x in same:
            r += not x
            runs.append(r)
        if held is not None:
            yield held
        edges = [None] * b.num_rows
        if place == 0:
            edges[0] = norm[0].as_py()
        previous, run = norm[-1].as_py(), r
        places = list(range(place, place + b.num_rows))
        place += b.num_rows
        if b.num_rows > 1:  # the last row waits: it may be the block's last
            yield out(b.slice(0, b.num_rows - 1), runs[:-1], places[:-1],
                      pa.array(edges[:-1], pa.large_string()))
        held = out(b.slice(b.num_rows - 1, 1), runs[-1:], places[-1:],
                   pa.array(edges[-1:], pa.large_string()))
    if held is not None:
        yield pa.RecordBatch.from_arrays(
            [*held.columns[:-1], pa.array([previous], pa.large_string())], held.schema.names)


def exact_dedup(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text",
                id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id (id of the row that stays),
    group_size, kept, text_sha256 (of the normalised text), then the ``carry`` columns
    in one struct ``row`` if given.

    Texts are equal when identical without ASCII white space; null counts as empty.
    Of equals the row with the most code points stays, then the smallest id (null ids
    last, then any one of rows alike in both: exactly one row of a group is kept).
    Extra columns are ignored, an empty table gives an empty result, and texts of any
    length are compared whole.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "dedup")
    row = [F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []
    keyed = docs.select(F.col(id_col).alias("_id"), F.length(F.coalesce(text_col, F.lit(""))).alias("_len"),
                        normalise(F.col(text_col)).alias("_norm"), *row)
    keyed = keyed.withColumns({"_sha": F.sha2(F.col("_norm"), 256), "_head": F.substring("_norm", 1, KEY_CHARS)})
    prefer = [F.col("_len").desc(), F.col("_id").asc_nulls_last()]
    n = partitions(spark)
    ordered = (keyed.repartitionByRange(n, "_head", "_sha", *prefer)
               .sortWithinPartitions("_head", "_sha", "_norm", *prefer)
               .select("_id", "_sha", "_norm", *(["row"] if carry else [])))
    schema = T.StructType([f for f in ordered.schema.fields if f.name != "_norm"])
    for name, kind in (("_block", T.IntegerType()), ("_run", T.LongType()), ("_place", T.LongType()), ("_edge", T.StringType())):
        schema = schema.add(name, kind)
    runs = s.table(ordered.mapInArrow(_runs, schema), "runs")

    # one row per block: its edges and the sizes and survivors of its first and last run
    narrow = runs.select("_id", "_block", "_run", "_place", "_edge")
    per_run = s.table(narrow.groupBy("_block", "_run").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_place", "_id")).alias("first")), "per_run")
    blocks = per_run.groupBy("_block").agg(
        F.max("_run").alias("last_run"), F.min_by("n", "_run").alias("first_n"),
        F.max_by("n", "_run").alias("last_n"), F.max_by("first", "_run")["_id"].alias("last_keep"),
        F.min_by("first", "_run")["_id"].alias("first_keep"))
    edge = narrow.filter("_edge is not null").groupBy("_block").agg(
        F.min_by("_edge", "_place").alias("head"), F.max_by("_edge", "_place").alias("tail"))
    # blocks can be empty: the neighbour is the block of the next lower rank
    ids = [r[0] for r in blocks.select("_block").orderBy("_block").collect()]  # at most one per partition
    follow = spark.createDataFrame(list(zip(ids[1:], ids[:-1])), "_block int, _before int")
    joined = {r[0] for r in edge.join(follow, "_block").join(
        edge.select(F.col("_block").alias("_before"), F.col("tail").alias("before")), "_before")
        .filter(F.col("head") == F.col("before")).select("_block").collect()}
    info = {r["_block"]: r for r in blocks.collect()}

    # chains of runs across borders: (block, run) -> survivor and size of the whole group
    patches, chain = [], []

    def close():
        if len(chain) > 1:
            keep, size = chain[0][2], sum(c[3] for c in chain)
            patches.extend((b, r, keep, size, i == 0) for i, (b, r, _, _) in enumerate(chain))
        chain.clear()

    for b in ids:
        x = info[b]
        if b not in joined:
            close()
        chain.append((b, 0, x["first_keep"], x["first_n"]))
        if x["last_run"] > 0:
            close()
            chain.append((b, x["last_run"], x["last_keep"], x["last_n"]))
    close()
    id_type = docs.schema[id_col].dataType.simpleString()
    fix = F.broadcast(spark.createDataFrame(  # at most two rows per partition
        patches, f"_block int, _run long, _keep {id_type}, _size long, _leads boolean"))
    # a run's rows share its row of per_run; a long run is split by the skew join
    whole = per_run.join(fix, ["_block", "_run"], "left").select(
        "_block", "_run", F.when(F.col("_size").isNull(), F.col("first")["_id"]).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", "n").alias("group_size"), F.col("first")["_place"].alias("_first"),
        F.coalesce("_leads", F.lit(True)).alias("_leads"))
    out = runs.drop("_edge").join(s.table(whole, "groups"), ["_block", "_run"])
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_leads") & (F.col("_place") == F.col("_first"))).alias("kept"),
        F.col("_sha").alias("text_sha256"), *(["row"] if carry else []))
