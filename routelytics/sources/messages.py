"""Message sources (S1-S3, S5, S7) and the deterministic message view over the
``events`` table that stands in for the producer.

The view is a narrow projection (no shuffle): every column is a function of one
``events`` row, so it scales with the scan and keeps Parquet pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (ALL_PRIORITIES, ALL_REGIONS, BATCH_TYPES, CURRENCIES,
                         FRAUD_TYPES, SOURCES, URGENT_TYPES)
from ..functions.coercion import q_str
from ..schemas import MESSAGE

# group -> type pool and amount scale (groups are event_id % 4)
TYPE_POOLS = [
    FRAUD_TYPES,
    URGENT_TYPES,
    URGENT_TYPES + BATCH_TYPES + ["unknown"],
    BATCH_TYPES + ["monthly-report", "unknown"],
]
AMOUNT_SCALE = [100.0, 400.0, 10.0, 1.0]
PRIORITY_POOL = ALL_PRIORITIES + ["medium"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _pick(pool: list[str], idx: str) -> str:
    arr = ", ".join(q_str(v) for v in pool)
    return f"element_at(array({arr}), CAST(({idx}) + 1 AS INT))"


def _pad_id(prefix: str, n: str, width: int) -> str:
    s = f"CAST({n} AS STRING)"
    # lpad truncates longer values; pad only up to max(width, len)
    return f"concat({q_str(prefix)}, lpad({s}, greatest({width}, length({s})), '0'))"


def message_columns(events: DataFrame) -> DataFrame:
    """events -> one message per event (schema MESSAGE + fixture extras:
    latency_ms, ts_ms, processed_ms).  One ``selectExpr``: a narrow projection
    that stays inside whole-stage codegen."""
    g, e4 = "(event_id % 4)", "floor(event_id / 4)"
    types = " ".join(f"WHEN {i} THEN {_pick(p, f'{e4} % {len(p)}')}" for i, p in enumerate(TYPE_POOLS))
    scale = " ".join(f"WHEN {i} THEN {v!r}D" for i, v in enumerate(AMOUNT_SCALE))
    if dict(events.dtypes).get("ts") == "timestamp_ntz":
        # wall-clock UTC time -> instant, independent of the session time zone
        ts = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"
    else:
        ts = "CAST(ts AS TIMESTAMP)"
    ts_ms = f"unix_millis({ts})"
    return events.selectExpr(
        f"{_pad_id('msg-', 'event_id', 6)} AS id",
        f"{ts} AS ts",
        f"CASE {g} {types} END AS type",
        f"{_pick(PRIORITY_POOL, f'user_id % {len(PRIORITY_POOL)}')} AS priority",
        f"CASE WHEN event_id % 7 = 2 THEN CAST(NULL AS DOUBLE) ELSE value * (CASE {g} {scale} END) END AS amount",
        "try_cast(get_json_object(props, '$.k') AS DOUBLE) / 100.0D AS risk_score",
        f"{_pick(ALL_REGIONS, f'user_id % {len(ALL_REGIONS)}')} AS region",
        f"{_pick(CURRENCIES, f'user_id % {len(CURRENCIES)}')} AS currency",
        f"{_pad_id('user-', 'user_id', 4)} AS user_id",
        f"{_pick(SOURCES, f'event_id % {len(SOURCES)}')} AS source",
        f"concat('bench-', CAST({e4} % 2 AS STRING)) AS benchmark_id",
        f"{g} <> 3 AS is_critical",
        "CAST((event_id * 37) % 400 AS DOUBLE) AS latency_ms",
        f"{ts_ms} AS ts_ms",
        f"CASE WHEN event_id % 5 <> 0 THEN {ts_ms} + (event_id * 13) % 9000 END AS processed_ms",
    )


def message_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message stream as a batch DataFrame over ``events``."""
    return message_columns(read_table(spark, sf_dir, "events"))


def read_messages_json(spark: SparkSession, path: str, schema=MESSAGE) -> DataFrame:
    """JSON-lines messages with a declared schema (no inference)."""
    return spark.read.schema(schema).json(path)


def stream_path(path: str) -> str:
    """A file stream source lists a directory, or the files a glob matches; a
    single file is given as a one-file glob (the source would otherwise take
    the file itself as the partition base path)."""
    import os
    if os.path.isfile(path):
        return path[:-1] + "[" + path[-1] + "]"
    return path


def read_messages_stream(spark: SparkSession, path: str, schema,
                         fmt: str = "parquet", start: str = "earliest",
                         max_files_per_trigger: int | None = None,
                         since_ms: int | None = None, options: dict | None = None) -> DataFrame:
    """The message topic as a streaming DataFrame.

    ``fmt='kafka'``: ``path`` is the topic, ``options`` hold the broker settings
    (``kafka.bootstrap.servers``, ...), ``start`` becomes ``startingOffsets``, which the
    checkpoint overrides on a restart; the rows are ``key``, ``value`` (text),
    ``timestamp``.  The broker package must be on the session's class path.

    Files otherwise: ``start='earliest'`` replays every file; ``start='latest'`` reads
    files written from ``since_ms`` on.  That instant belongs to the first start: pass
    the same one (``first_start``) on a restart, else files that came while the query
    was down would be passed over."""
    reader = spark.readStream.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if fmt == "kafka":
        return (reader.option("subscribe", path).option("startingOffsets", start).load()
                .select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.schema(schema).load(stream_path(path))
    if start == "latest":
        import time
        since_ms = int(time.time() * 1000) if since_ms is None else since_ms
        df = (df.filter(F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(since_ms)))
                .select(*[f.name for f in schema.fields]))
    return df


def first_start(spark: SparkSession, checkpoint: str) -> int:
    """The instant (epoch ms) of the first start of the query with this checkpoint: kept
    beside it, written once."""
    import time
    path = f"{checkpoint.rstrip('/')}-first-start"
    try:
        return spark.read.schema("ms long").parquet(path).first()[0]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    now = int(time.time() * 1000)
    spark.createDataFrame([(now,)], "ms long").write.parquet(path)
    return now


def read_queue(routed: DataFrame, queue: str) -> DataFrame:
    """S3: one queue's messages (partition pruning when the routed table is
    partitioned by ``target_queue``)."""
    return routed.filter(F.col("target_queue") == queue)


def scan_history(history: DataFrame, benchmark_id: str | None = None) -> DataFrame:
    """All history, or one cohort (filter pushed to the scan)."""
    if benchmark_id is None:
        return history
    return history.filter(F.col("benchmark_id") == benchmark_id)


def list_cohorts(history: DataFrame) -> DataFrame:
    """Distinct benchmark ids."""
    return history.select("benchmark_id").distinct()
