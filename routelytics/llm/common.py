"""Helpers shared by the training-data operators.

Rules that hold for all of them:

* Operators select the columns they need first, so extra columns of the input,
  whatever their names, are ignored (or carried along where stated).
* Intermediate tables are written once, as Parquet, to the shared folder that
  ``spark.checkpoint.dir`` names, and read back: the result is frozen (partition
  numbers and row ids survive a retry), lineage is cut, and a lost executor costs
  only its own tasks.
* White space is the six ASCII characters of ``WS``; a word is a maximal run of
  anything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Character class of white space, for Java, RE2 and Python patterns alike.
WS = r"\x20\x09-\x0D"


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Intermediate tables of one operator call, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self.made: list[str] = []

    def table(self, df: DataFrame, name: str, keep: bool = True) -> DataFrame:
        """Write ``df`` once and return the table.  ``keep=False``: ``release`` may delete it."""
        path = f"{self.root}/{len(self.made)}-{name}"
        df.write.mode("overwrite").parquet(path)
        self.made.append("" if keep else path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, but_last: int = 0) -> None:
        """Delete the tables written with ``keep=False``, all but the newest ``but_last``."""
        old = [i for i, p in enumerate(self.made) if p]
        for i in old[:len(old) - but_last]:
            delete_path(self.spark, self.made[i])
            self.made[i] = ""


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones
    for themselves, the others in turn from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; null or empty text: no words."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{WS}]+")
    return F.filter(parts, lambda w: w != "")


def running_totals(df: DataFrame, order: list, value: str, out: str, scratch: Scratch,
                   group: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` (a long) over all rows up to and including
    this one in the order of ``order`` (within ``group``, which must then be the
    leading order column; null is a group).

    The rows are range-sorted on all of ``order``, so a hot group spreads over many
    blocks; each block sums its own rows and the blocks' totals (one row per block
    and group that meets it) give the offsets.  Nothing gathers a group.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_block", T.IntegerType()),
                           T.StructField("_run", T.LongType())])
    names = [f.name for f in schema.fields]

    def block_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId()
        last, total = object(), 0
        for x in frames:
            if x.empty:
                continue
            v = x[value].astype("int64")
            if group is None:
                run = v.cumsum() + total
                total = int(run.iloc[-1])
            else:
                g = x[group]
                new = g.ne(g.shift()) & ~(g.isna() & g.shift().isna())
                new.iloc[0] = True
                ids = new.cumsum()
                run = v.groupby(ids).cumsum()
                head, tail = g.iloc[0], g.iloc[-1]
                if head == last or (last is None and pd.isna(head)):
                    run = run + (ids == 1) * total
                last, total = (None if pd.isna(tail) else tail), int(run.iloc[-1])
            yield x.assign(_block=block, _run=run)[names]

    blocks = scratch.table(
        df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        .mapInPandas(block_sums, schema), "blocks")
    g = F.lit("") if group is None else F.col(group)
    totals = blocks.groupBy(g.alias("_g"), F.col("_block").alias("_b")).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block and group; a source's rows meet at most as many blocks as there are partitions
    offsets = scratch.table(totals.select("_g", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0))
                                          .alias("_offset")), "offsets")
    on = (F.col("_block") == F.col("_b")) & g.eqNullSafe(F.col("_g"))
    return (blocks.join(offsets, on, "left")
            .withColumn(out, F.col("_run") + F.col("_offset"))
            .select(*df.columns, out))


def numbered(df: DataFrame, hash_col: str, id_col: str = "doc_id", first=None) -> DataFrame:
    """Add ``_n``: a running number among rows that agree on the id and ``hash_col`` (in
    the order of ``first``, if given).  Id, hash and number together name one row, also
    where ids are null or repeated; rows that agree on what is hashed are exchangeable."""
    w = Window.partitionBy(id_col, hash_col).orderBy(hash_col if first is None else first)
    return df.withColumn("_n", F.row_number().over(w))
