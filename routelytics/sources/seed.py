"""The shipped rule set (S6 / R11) and a rule set for the ``orders`` table.

Rules are data.  A rule is (priority, field, operator, value, target, category);
``value`` is a Python ``str`` or number and keeps its type, because ``equals`` is
type-strict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import RULE

# ---- fixed values: the 50 seed rules, in priority order ---------------------
# (priority, field, operator, value, targetQueue, category)
SEED_RULES = [
    (1, "type", "equals", "fraud", "urgent", "fraud"),
    (2, "type", "equals", "breach", "urgent", "fraud"),
    (3, "type", "equals", "chargeback", "urgent", "fraud"),
    (4, "type", "equals", "alert", "urgent", "fraud"),
    (5, "type", "equals", "suspicious", "urgent", "fraud"),
    (6, "type", "equals", "blacklisted", "urgent", "fraud"),
    (7, "type", "equals", "aml", "urgent", "fraud"),
    (8, "type", "equals", "sanction", "urgent", "fraud"),
    (9, "amount", "greaterThan", 100000, "urgent", "payment"),
    (10, "amount", "greaterThan", 50000, "urgent", "payment"),
    (11, "amount", "greaterThan", 10000, "urgent", "payment"),
    (12, "amount", "greaterThan", 5000, "urgent", "payment"),
    (13, "amount", "greaterThan", 1000, "urgent", "payment"),
    (14, "amount", "lessThan", 10, "batch", "payment"),
    (15, "amount", "lessThan", 50, "batch", "payment"),
    (16, "amount", "lessThan", 100, "batch", "payment"),
    (17, "amount", "lessThan", 500, "batch", "payment"),
    (18, "amount", "lessThan", 1000, "batch", "payment"),
    (19, "riskScore", "greaterThan", 0.95, "urgent", "risk"),
    (20, "riskScore", "greaterThan", 0.90, "urgent", "risk"),
    (21, "riskScore", "greaterThan", 0.85, "urgent", "risk"),
    (22, "riskScore", "greaterThan", 0.80, "urgent", "risk"),
    (23, "riskScore", "greaterThan", 0.70, "urgent", "risk"),
    (24, "riskScore", "lessThan", 0.10, "batch", "risk"),
    (25, "riskScore", "lessThan", 0.20, "batch", "risk"),
    (26, "riskScore", "lessThan", 0.30, "batch", "risk"),
    (27, "riskScore", "lessThan", 0.40, "batch", "risk"),
    (28, "riskScore", "lessThan", 0.50, "batch", "risk"),
    (29, "priority", "equals", "critical", "urgent", "priority"),
    (30, "priority", "equals", "emergency", "urgent", "priority"),
    (31, "priority", "equals", "high", "urgent", "priority"),
    (32, "priority", "equals", "urgent", "urgent", "priority"),
    (33, "priority", "equals", "immediate", "urgent", "priority"),
    (34, "priority", "equals", "low", "batch", "priority"),
    (35, "priority", "equals", "minimal", "batch", "priority"),
    (36, "priority", "equals", "routine", "batch", "priority"),
    (37, "priority", "equals", "scheduled", "batch", "priority"),
    (38, "priority", "equals", "deferred", "batch", "priority"),
    (39, "type", "equals", "payment", "urgent", "eventType"),
    (40, "type", "equals", "transfer", "urgent", "eventType"),
    (41, "type", "equals", "withdrawal", "urgent", "eventType"),
    (42, "type", "equals", "analytics", "batch", "eventType"),
    (43, "type", "equals", "report", "batch", "eventType"),
    (44, "type", "equals", "sensor", "batch", "eventType"),
    (45, "type", "equals", "log", "batch", "eventType"),
    (46, "type", "equals", "metrics", "batch", "eventType"),
    (47, "region", "equals", "HIGH-RISK", "urgent", "region"),
    (48, "region", "equals", "SANCTIONED", "urgent", "region"),
    (49, "region", "equals", "DOMESTIC", "batch", "region"),
    (50, "region", "equals", "APAC", "batch", "region"),
]

# ---- fixed values: the ten rules of the engine's unit cases -----------------
UNIT_RULES = [
    (1, "type", "equals", "fraud", "urgent", None),
    (2, "amount", "greaterThan", 100000, "urgent", None),
    (3, "amount", "greaterThan", 10000, "urgent", None),
    (4, "riskScore", "greaterThan", 0.8, "urgent", None),
    (5, "riskScore", "greaterThan", 0.5, "urgent", None),
    (6, "priority", "equals", "critical", "urgent", None),
    (7, "type", "equals", "analytics", "batch", None),
    (8, "priority", "equals", "low", "batch", None),
    (9, "amount", "lessThan", 100, "batch", None),
    (10, "type", "contains", "report", "batch", None),
]

# Our own rule set over ``orders``: routing does not depend on the message schema.
ORDER_RULES = [
    (1, "o_orderpriority", "equals", "1-URGENT", "urgent", "priority"),
    (2, "o_totalprice", "greaterThan", 400000, "urgent", "payment"),
    (3, "o_orderpriority", "contains", "HIGH", "urgent", "priority"),
    (4, "o_orderstatus", "equals", "P", "urgent", "status"),
    (5, "o_totalprice", "lessThan", 50000, "batch", "payment"),
    (6, "o_orderpriority", "contains", "LOW", "batch", "priority"),
    (7, "o_totalprice", "greaterThan", 250000, "urgent", "payment"),
    (8, "o_orderstatus", "equals", "F", "batch", "status"),
]


def _describe(field, operator, value, target) -> str:
    return f"{field} {operator} {value} -> {target}"


def rule_rows(rules=SEED_RULES) -> list[tuple]:
    """Rule tuples -> rows of the ``RULE`` schema (value split by type)."""
    rows = []
    for prio, field, op, value, target, category in rules:
        is_num = isinstance(value, (int, float)) and not isinstance(value, bool)
        rows.append((
            f"r{prio:04d}", field, op,
            None if is_num else str(value),
            float(value) if is_num else None,
            target, int(prio), category, _describe(field, op, value, target),
        ))
    return rows


def seed_rules(spark: SparkSession, rules=SEED_RULES) -> DataFrame:
    """The seed rule table as a DataFrame (write it with ``write_rules``)."""
    return spark.createDataFrame(rule_rows(rules), RULE)


def write_rules(rules: DataFrame, path: str) -> None:
    """Replace the rule table at ``path`` (S6: delete-all then insert)."""
    rules.coalesce(1).write.mode("overwrite").parquet(path)
