"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, s: Scratch) -> DataFrame:
    """``(u, v)`` for edges ``(a, b)`` of longs: every node that is not the smallest of
    its component, with that smallest node.

    Each step hangs neighbours onto minima, which are aggregated with partial sums and
    written before they are joined, so a hub's rows can be split by the skew join.
    """
    e = s.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "edges", keep=False)
    before = None
    while (now := _digest(e)) != before and now[0]:
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = s.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low", keep=False)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = s.table(large.distinct(), "large", keep=False)
        low = s.table(large.groupBy("u").agg(F.min("v").alias("m")), "low", keep=False)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = s.table(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", keep=False)
        s.release(but_last=1)
    return e
