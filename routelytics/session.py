"""SparkSession construction and the shared checkpoint folder.

On a cluster the session is created by the platform and ``spark.checkpoint.dir``
names a shared folder; we only read it.  Local runs (tests, bench) get a
scratch folder when the setting is absent.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "routelytics",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session with the settings the library relies on.

    ANSI mode stays on (Spark 4 default); every division and cast in the library is
    written with ``try_*`` forms so it is safe either way.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cores = os.cpu_count() or 8
    builder = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  Where the setting is missing, a local
    session gets a scratch folder; a cluster is refused, since its executors do not
    share the driver's disk."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="routelytics-ckpt-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, path)
    try:
        spark.sparkContext.setCheckpointDir(path)   # for DataFrame.checkpoint()
    except Exception:  # noqa: BLE001  (no SparkContext handle, e.g. a remote session)
        pass
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (tables, stream state)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
