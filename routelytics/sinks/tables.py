"""Sinks (K1-K4): the queue table, dead letters, routing history and broker
records.

Writes are idempotent per unit of work: a streaming micro-batch writes into its
own ``batch_id=<n>`` folder with overwrite, so a batch replayed after a failure
replaces its output instead of duplicating it.  The queue table is partitioned
by ``target_queue`` so a consumer reading one queue prunes the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import snake_to_camel
from ..functions.timefmt import iso_ms
from ..operators.routing import delivery_priority


def _target(path: str, batch_id: int | None) -> str:
    path = path.rstrip("/")
    return path if batch_id is None else f"{path}/batch_id={batch_id}"


def _mode(batch_id: int | None) -> str:
    """A batch's own folder is replaced when the batch is replayed; the table is appended to."""
    return "append" if batch_id is None else "overwrite"


def write_routed(routed: DataFrame, path: str, batch_id: int | None = None) -> None:
    """K1: every routed message into its queue (partition) with its delivery
    priority (10 urgent, 1 otherwise)."""
    out = routed.drop("matched_position")
    if "delivery_priority" not in out.columns:
        out = out.withColumn("delivery_priority", delivery_priority(F.col("target_queue")))
    out.write.mode(_mode(batch_id)).partitionBy("target_queue").parquet(_target(path, batch_id))


def write_dead_letters(letters: DataFrame, path: str, batch_id: int | None = None) -> None:
    """K2: dead-letter envelopes (original queue, message, error, reason, time)."""
    letters.write.mode(_mode(batch_id)).parquet(_target(path, batch_id))


def append_history(history: DataFrame, path: str, batch_id: int | None = None) -> None:
    """K3: one history row per routed message (append-only log; per-batch folder
    with overwrite makes a replayed batch idempotent)."""
    history.write.mode(_mode(batch_id)).parquet(_target(path, batch_id))


def to_kafka_records(messages: DataFrame, key: str | None = "id", now=None) -> DataFrame:
    """K4: broker records: ``value`` = JSON text of the message as the producers write it
    (camelCase names, nulls kept, ``timestamp`` as ISO text: the message's ``ts`` where it
    has one, else ``now``), ``key`` = the message id, or no key for the un-keyed producer."""
    stamp = F.col("ts") if "ts" in messages.columns else F.current_timestamp() if now is None else now
    fields = [F.col(c).alias(snake_to_camel(c)) for c in messages.columns if c not in ("ts", "timestamp")]
    value = F.to_json(F.struct(*fields, iso_ms(stamp).alias("timestamp")), {"ignoreNullFields": "false"})
    if key is None:
        return messages.select(value.alias("value"))
    return messages.select(F.col(key).cast("string").alias("key"), value.alias("value"))
