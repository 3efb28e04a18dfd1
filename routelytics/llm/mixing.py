"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in a shuffled order (a hash of the id) and may
send them a second time; a copy's virtual finish time is the number of tokens its
source has sent up to and including it, divided by the source's target.  All
copies are range-sorted by finish time and the sequence is cut at the total
budget, so every source stops at (about) virtual time 1, its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running_totals, words


def source_targets(sizes: DataFrame, scratch: Scratch, weights=(5, 2, 1),
                   share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``(source, source_size, target)`` for a table ``(source, size)`` of documents.

    Sources by code point, null last, take ``weights`` in turn.  The budget
    (``share`` times all sizes) is dealt out by weight; a target stops at ``epochs``
    times its source's size and the excess is dealt again among the others until none
    is above.  One row per source; only sums over sources reach the driver.
    """
    per = scratch.table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = running_totals(per.withColumn("_one", F.lit(1).cast("long")),
                            [F.col("source").asc_nulls_last()], "_one", "_rank", scratch)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    per = scratch.table(ranked.select("source", "source_size", w.alias("_w")), "weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = share * total, 0.0, -1
    while True:  # each turn caps at least one more source or ends
        free = (F.col("_w") * F.lit(level) <= epochs * F.col("source_size"))
        row = per.agg(F.sum(F.when(~free, epochs * F.col("source_size"))).alias("c"),
                      F.sum(F.when(free, F.col("_w"))).alias("w"),
                      F.count(F.when(~free, 1)).alias("n")).first()
        if row.n == capped or not row.w or not total:
            break
        level, capped = (budget - (row.c or 0)) / row.w, row.n
    return per.select("source", "source_size", F.least(
        (epochs * F.col("source_size")).cast("double"), F.col("_w") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, epochs: int = 2,
        seed: str = "mix") -> DataFrame:
    """One row per document of ``docs`` (doc_id, text, source): doc_id, size (words),
    source_size, target (of its source), taken (words the mix takes; a multiple of
    size, at most ``epochs`` times it), row_hash (of text and source).

    Null text has size 0; documents of size 0 are never taken.  Null sources form one
    source, the last.  Null and repeated ids are ordinary rows (rows alike in id,
    source and text are exchangeable).  An empty table gives an empty result.  Reruns
    give the same result: the shuffle is a hash of the id and ties go by source, hash,
    id, row hash and copy number.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "mix")
    sized = s.table(docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
        F.xxhash64("text", "source").alias("row_hash"),
        F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        .alias("_key"), F.monotonically_increasing_id().alias("_row")), "sized")
    targets = s.table(source_targets(sized, s, weights, share, epochs), "targets")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    tie = ["_key", "doc_id", "row_hash", "_row"]
    sent = running_totals(sized, [F.col("source").asc_nulls_last(), *tie], "size", "_sent", s, "source")
    # the source table is joined by hash partitions of a few rows; hot sources: AQE splits them
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    sent = sent.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    copies = sent.filter("size > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.select("_row", "source", *tie[:3], "size", "_copy", (
        (F.col("_copy") * F.col("source_size") + F.col("_sent")) / F.col("target")).alias("_finish"))
    queue = running_totals(copies, ["_finish", F.col("source").asc_nulls_last(), *tie, "_copy"],
                           "size", "_all", s)
    taken = (queue.filter(F.col("_all") <= F.lit(budget)).groupBy("_row")
             .agg(F.sum("size").alias("_taken")))
    return sent.join(taken, "_row", "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "row_hash")
