"""Live progress of a stream (A24): a listener that appends every micro-batch's counts and
times to a table, and the report over it.

The table is a commit log (``sinks.commits``): one folder per query and micro-batch, so a
batch that is reported again replaces nothing and counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.metrics import exact_percentiles
from ..sinks.commits import CommitLog

SCHEMA = "query string, batch_no long, started_ms long, rows long, latency_ms double"


class ProgressTable(StreamingQueryListener):
    """Writes what every micro-batch with rows reports below ``root``.  Register it with
    ``spark.streams.addListener``; ``only`` keeps the queries of these names."""

    def __init__(self, spark: SparkSession, root: str, only: set[str] | None = None):
        super().__init__()
        self.spark, self.root, self.only = spark, root.rstrip("/"), only

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows or self.only is not None and p.name not in self.only:
            return
        started = F.unix_millis(F.to_timestamp(F.lit(p.timestamp)))
        row = self.spark.range(1).select(
            F.lit(p.name or str(p.id)).alias("query"), F.lit(p.batchId).cast("long").alias("batch_no"), started.alias("started_ms"),
            F.lit(p.numInputRows).cast("long").alias("rows"),
            F.lit(float(p.durationMs.get("triggerExecution", 0))).alias("latency_ms"))
        CommitLog(self.spark, f"{self.root}/{p.name or p.id}").commit(p.batchId, {"progress": row})


def read_progress(spark: SparkSession, root: str, query: str) -> DataFrame:
    """The micro-batches of a query so far (SCHEMA)."""
    found = CommitLog(spark, f"{root.rstrip('/')}/{query}").read("progress")
    return spark.createDataFrame([], SCHEMA) if found is None else found


def live_progress(progress: DataFrame) -> DataFrame:
    """Per query and micro-batch: rows sent so far, seconds since the first batch began and
    the rate, as the batch report ``metrics.send_progress`` has them per thousand rows.
    One row a micro-batch, so a query's window is as long as its number of batches."""
    w = Window.partitionBy("query").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = progress.withColumn("sent", F.sum("rows").over(w)).withColumn("_t0", F.min("started_ms").over(Window.partitionBy("query")))
    elapsed = (F.col("started_ms") + F.col("latency_ms") - F.col("_t0")) / 1000.0
    return p.select("query", "batch_no", "sent", elapsed.alias("elapsed_s"),
                    F.floor(F.try_divide(F.col("sent").cast("double"), elapsed)).cast("double").alias("rate"), "latency_ms")


def batch_latency(progress: DataFrame) -> DataFrame:
    """Per query: micro-batches, rows, and the p50, p95 and p99 of the batch latency, for
    the 100 ms and 300 ms targets."""
    n = progress.groupBy("query").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"))
    return n.join(exact_percentiles(progress, "latency_ms", (0.5, 0.95, 0.99), ["query"]), "query")
