"""The standard pipeline over the driver tables, shared by the registered
queries, the bench and the tests:

events -> message view -> route (50 seed rules) -> history (+ processed log,
raw text feed, dead letters).  Every stage is a lazy DataFrame; nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BATCH_ACTION_COST_MS, URGENT_ACTION_COST_MS, URGENT_QUEUE
from ..operators.history import processed_log, to_history
from ..operators.processing import action_cost, batch_action, urgent_action
from ..operators.quality import dead_letters, parse_and_validate, split_valid
from ..operators.routing import route, route_naive
from ..session import scratch_path
from ..sources.messages import message_view, read_table
from ..sources.seed import ORDER_RULES, SEED_RULES

NAIVE_ID = "naive-0"
SMART_ID = "bench-0"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_view(spark, sf_dir)


def routed(spark: SparkSession, sf_dir: str, method: str = "auto") -> DataFrame:
    return route(messages(spark, sf_dir), SEED_RULES, method=method)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_history(routed(spark, sf_dir))


def naive_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_history(route_naive(messages(spark, sf_dir), NAIVE_ID))


def all_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smart run and naive baseline in one log (cohort = benchmark_id)."""
    return history(spark, sf_dir).unionByName(naive_history(spark, sf_dir))


def with_cost(h: DataFrame) -> DataFrame:
    """Nominal handling cost of each message by the consumer of its queue."""
    ua = urgent_action(F.col("message_type"), F.col("amount"), F.col("risk_score"))
    ba = batch_action(F.col("message_type"))
    cost = F.when(F.col("target_queue") == URGENT_QUEUE, action_cost(ua, URGENT_ACTION_COST_MS)) \
        .otherwise(action_cost(ba, BATCH_ACTION_COST_MS))
    return h.withColumn("_cost", cost.cast("double"))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed_log(with_cost(history(spark, sf_dir)), "_cost")


def raw_message_feed(msgs: DataFrame, malformed_every: int = 50,
                     no_id_every: int = 53, json_cols=None) -> DataFrame:
    """Raw JSON text of every message (``key`` = id, ``value`` = JSON); every
    ``malformed_every``-th row is cut in half (malformed) and every
    ``no_id_every``-th row is written without its id."""
    n = F.regexp_extract(F.col("id"), r"(\d+)$", 1).cast("long")
    opts = {"ignoreNullFields": "false"}          # JSON.stringify keeps nulls
    cols = list(json_cols or msgs.columns)
    full = F.to_json(F.struct(*[F.col(c) for c in cols]), opts)
    no_id = F.to_json(F.struct(*[F.col(c) for c in cols if c != "id"]), opts)
    text = (F.when(n % malformed_every == 0, F.substring(full, 1, F.floor(F.length(full) / 2).cast("int")))
            .when(n % no_id_every == 0, no_id)
            .otherwise(full))
    return msgs.select(F.col("id").alias("key"), text.alias("value"),
                       F.col("benchmark_id"), F.col("ts"))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw message topic: JSON text derived by Spark from ``events`` as it is now,
    written as a table of its own for every caller (a topic is stored data; parsing
    reads a real column, not an inlined ``to_json`` expression)."""
    cols = ["id", "type", "priority", "amount", "risk_score", "region", "currency",
            "user_id", "source", "benchmark_id", "is_critical", "ts_ms"]
    feed = raw_message_feed(messages(spark, sf_dir).select(*cols, "ts"), json_cols=cols)
    path = scratch_path(spark, "raw-feed")
    feed.write.parquet(path)
    return spark.read.schema(feed.schema).parquet(path)


def validated_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_and_validate(raw_feed(spark, sf_dir))


def rejected_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of the urgent consumer's validation, keyed like history."""
    _, bad = split_valid(validated_feed(spark, sf_dir))
    env = bad.select(F.col("key").alias("message_id"), "benchmark_id", "value", "reason", "ts")
    return dead_letters(env, URGENT_QUEUE, failed_at=F.col("ts"),
                        keep=("benchmark_id", "message_id"))


def orders_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return route(o, ORDER_RULES)
