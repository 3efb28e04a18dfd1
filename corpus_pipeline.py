"""From raw documents to packed training sequences: score, deduplicate, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelytics.llm.common import Scratch, numbered
from routelytics.llm.exact_dedup import exact_dedup
from routelytics.llm.mixing import mix
from routelytics.llm.packing import pack
from routelytics.llm.quality_mil import fit_quality, score_quality
from routelytics.llm.simhash import simhash_components

QUALITY_THRESHOLD = 0.7

#: The stages learn a model, tokenise and link by bit distance, which SQL cannot state;
#: the tests hold each of them against a brute-force version.
ORACLE_SQL = None


def _rows(docs: DataFrame):
    """All columns of a document in one."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def _same_row(key: str = "doc_id"):
    return F.col(f"d.{key}").eqNullSafe(F.col(f"k.{key}")) & (F.col("d._h") == F.col("k._h"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, does not reject."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = fit_quality(docs, labels)
    scored = score_quality(docs.select(_rows(docs).alias("row")), model, ["row"], within="row")
    return scored.filter(F.col("_score") >= QUALITY_THRESHOLD).select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs, carry=docs.columns).filter("kept").select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id."""
    found = simhash_components(docs)
    stays = found.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", F.col("text_hash").alias("_h"))).alias("k"))
    stays = Scratch(spark, "simhash-stage").table(stays.select("k.doc_id", "k._h"), "stays")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), _rows(docs).alias("row"))
    kept = rows.alias("d").join(stays.alias("k"), _same_row(), "left_semi")
    return numbered(kept, "_h").filter("_n = 1").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each as often as it takes it."""
    taken = mix(docs).filter("taken > 0").select(
        "doc_id", F.col("row_hash").alias("_h"), (F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = Scratch(spark, "mixing-stage").table(
        numbered(taken, "_h", first=F.col("times").desc()), "taken")
    rows = numbered(docs.select("doc_id", F.xxhash64("text", "source").alias("_h"), _rows(docs).alias("row")), "_h")
    mixed = rows.alias("d").join(taken.alias("k"), _same_row() & (F.col("d._n") == F.col("k._n")))
    return mixed.select("d.row", F.explode(F.sequence(F.lit(1), F.col("k.times"))).alias("_time")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    s = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = s.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
