"""Schemas of messages, rules, routing history, processing log and dead letters."""

from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType,
                               TimestampType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


# A message as the router sees it (typed path).  Field names are snake_case;
# rules may name them in camelCase (``riskScore``), see functions.fields.
MESSAGE = _s(
    ("id", StringType()),
    ("ts", TimestampType()),
    ("type", StringType()),
    ("priority", StringType()),
    ("amount", DoubleType()),
    ("risk_score", DoubleType()),
    ("region", StringType()),
    ("currency", StringType()),
    ("user_id", StringType()),
    ("source", StringType()),
    ("benchmark_id", StringType()),
    ("is_critical", BooleanType()),
)

# value is split by JSON type so that `equals` stays type-strict:
# exactly one of value_str / value_num is set.
RULE = _s(
    ("rule_id", StringType()),
    ("field", StringType()),
    ("operator", StringType()),
    ("value_str", StringType()),
    ("value_num", DoubleType()),
    ("target_queue", StringType()),
    ("priority", IntegerType()),
    ("category", StringType()),
    ("description", StringType()),
)

# Rule change log for R12 (op: create / update / delete; seq orders changes).
RULE_CHANGE = _s(
    ("seq", LongType()),
    ("op", StringType()),
    ("rule_id", StringType()),
    ("field", StringType()),
    ("operator", StringType()),
    ("value_str", StringType()),
    ("value_num", DoubleType()),
    ("target_queue", StringType()),
    ("priority", IntegerType()),
    ("category", StringType()),
    ("description", StringType()),
)

# One row per routing decision (append-only).
HISTORY = _s(
    ("message_id", StringType()),
    ("target_queue", StringType()),
    ("matched_rule", StringType()),
    ("matched_priority", IntegerType()),
    ("latency_ms", DoubleType()),
    ("ts", TimestampType()),
    ("benchmark_id", StringType()),
    ("is_critical", BooleanType()),
    ("message_type", StringType()),
    ("message_priority", StringType()),
    ("message_region", StringType()),
    ("risk_score", DoubleType()),
    ("amount", DoubleType()),
    ("source", StringType()),
    ("user_id", StringType()),
)

# One row per processed message (append-only); joined to HISTORY on read.
PROCESSED = _s(
    ("benchmark_id", StringType()),
    ("message_id", StringType()),
    ("processed_ms", LongType()),
    ("processed_by", StringType()),
    ("processing_time", DoubleType()),
    ("status", StringType()),
)

DEAD_LETTER = _s(
    ("original_queue", StringType()),
    ("message", StringType()),
    ("error", StringType()),
    ("reason", StringType()),
    ("failed_at", TimestampType()),
)
