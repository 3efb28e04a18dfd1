"""Distributed ordered scans: running count / sum / max and lag over a total
order, without putting a whole partition key into one task.

A plain ``Window.partitionBy(queue).orderBy(ts)`` sends every row of a queue
(or cohort, or the single collector of the batch consumer) to one task.  Here
the rows are range-sorted on the whole order, so equal stamps and missing stamps
are cut by the later order columns, and written once with the number of their
block to the shared folder: the input is evaluated once, and every retry sees the
same blocks.

Each (partition key, block) is scanned by a window; the per-block totals (one
row per key and block) are scanned in a second, tiny window; the offsets are
joined back (AQE broadcasts them on their measured size).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

BLK = _BLK = "_scan_blk"


def ordered_blocks(df: DataFrame, order_by: Sequence[str], blocks: int | None = None) -> DataFrame:
    """The rows as a table with the number of their block in the order of
    ``order_by`` (NULL first).  ``blocks`` defaults to the shuffle partitions, so a
    block is as large as any other shuffle partition of the job."""
    spark = df.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ordered-blocks")
    out = df.repartitionByRange(n, *order_by).withColumn(BLK, F.spark_partition_id())
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def ordered_scan(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str],
                 sums: Sequence[str] = (), maxes: Sequence[str] = (),
                 lags: Sequence[str] = (), blocks: int | None = None,
                 pos_col: str = "pos") -> DataFrame:
    """Add ``pos`` (1-based rank in the order within ``partition_by``),
    ``cum_<c>`` (inclusive running sum), ``cummax_<c>`` (inclusive running max)
    and ``lag_<c>`` (previous row's value) columns.

    ``order_by`` must be a total order (end it with a unique key)."""
    P, O = list(partition_by), list(order_by)
    d = ordered_blocks(df, O, blocks)

    w = Window.partitionBy(*P, _BLK).orderBy(*O)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loc = d.withColumn("_lpos", F.row_number().over(w))
    for c in sums:
        loc = loc.withColumn(f"_ls_{c}", F.sum(c).over(wr))
    for c in maxes:
        loc = loc.withColumn(f"_lm_{c}", F.max(c).over(wr))
    for c in lags:
        loc = loc.withColumn(f"_ll_{c}", F.lag(c).over(w))

    order_key = F.struct(*[F.col(o) for o in O])
    aggs = [F.count(F.lit(1)).alias("_bn")]
    aggs += [F.sum(c).alias(f"_bs_{c}") for c in sums]
    aggs += [F.max(c).alias(f"_bm_{c}") for c in maxes]
    aggs += [F.max_by(c, order_key).alias(f"_bl_{c}") for c in lags]
    tot = d.groupBy(*P, _BLK).agg(*aggs)
    wb = Window.partitionBy(*P).orderBy(_BLK)
    wprev = wb.rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum("_bn").over(wprev), F.lit(0)).alias("_on")]
    offs += [F.sum(f"_bs_{c}").over(wprev).alias(f"_os_{c}") for c in sums]
    offs += [F.max(f"_bm_{c}").over(wprev).alias(f"_om_{c}") for c in maxes]
    offs += [F.lag(f"_bl_{c}").over(wb).alias(f"_ol_{c}") for c in lags]
    off = tot.select(*P, _BLK, *offs)

    keys = F.col(f"l.{_BLK}") == F.col(f"o.{_BLK}")
    for c in P:  # a missing key is a key
        keys = keys & F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}"))
    out = loc.alias("l").join(off.alias("o"), keys, "left").select(
        "l.*", *[F.col(f"o.{c}") for c in off.columns if c not in (*P, _BLK)])
    out = out.withColumn(pos_col, F.col("_on") + F.col("_lpos"))
    drop = [_BLK, "_lpos", "_on"]
    for c in sums:
        out = out.withColumn(
            f"cum_{c}",
            F.when(F.col(f"_os_{c}").isNull(), F.col(f"_ls_{c}"))
             .otherwise(F.col(f"_os_{c}") + F.coalesce(F.col(f"_ls_{c}"), F.lit(0))))
        drop += [f"_ls_{c}", f"_os_{c}"]
    for c in maxes:
        out = out.withColumn(f"cummax_{c}", F.greatest(F.col(f"_om_{c}"), F.col(f"_lm_{c}")))
        drop += [f"_lm_{c}", f"_om_{c}"]
    for c in lags:
        out = out.withColumn(
            f"lag_{c}", F.when(F.col("_lpos") == 1, F.col(f"_ol_{c}"))
                         .otherwise(F.col(f"_ll_{c}")))
        drop += [f"_ll_{c}", f"_ol_{c}"]
    return out.drop(*drop)


def last_before(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], col: str,
                out: str, blocks: int | None = None) -> DataFrame:
    """Add ``out``: the last value of ``col`` that is not NULL in the rows before, within
    ``partition_by`` in the order of ``order_by`` (NULL first)."""
    P, O = list(partition_by), list(order_by)
    d = ordered_blocks(df, [*P, *O], blocks)
    prev = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    loc = d.withColumn("_in", F.last(col, True).over(prev(Window.partitionBy(*P, _BLK).orderBy(*O))))
    # one row per key and block
    end = d.groupBy(*P, _BLK).agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.struct(*O))).alias("_end"))
    end = end.select(*P, _BLK, F.last("_end", True).over(prev(Window.partitionBy(*P).orderBy(_BLK))).alias("_carry"))
    keys = F.col(f"l.{_BLK}") == F.col(f"o.{_BLK}")
    for c in P:  # a missing key is a key
        keys = keys & F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}"))
    return loc.alias("l").join(end.alias("o"), keys, "left").select(
        *[F.col(f"l.{c}") for c in df.columns], F.coalesce("l._in", "o._carry").alias(out))
