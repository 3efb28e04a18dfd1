"""Rule predicates (R1-R6), rule loading and rule maintenance (S4, P6, P11,
P12, R12, A18).

A rule table is configuration, not data: it is read once per compile (or per
micro-batch, R13) with a hard size bound and compiled to Column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import OPERATORS
from ..functions.coercion import (js_number, js_string, num_cmp_sql, q_double,
                                  q_ident, q_str, to_js_string_sql, to_number_sql)
from ..functions.fields import resolve_field
from .scan import last_before
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

# Rules are configuration and compiled on the driver; a table of more than this
# many is refused, never truncated.  The bound is the ``max_rules`` parameter.
MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    rule_id: str
    field: str | None
    operator: str | None
    value: Any            # str or float (type kept for strict equals)
    target: str | None
    priority: int
    category: str | None = None


def _value_of(value_str, value_num):
    if value_num is not None:
        return float(value_num)
    return value_str


def collect_rules(rules: DataFrame | Iterable, max_rules: int = MAX_RULES) -> list[Rule]:
    """Rules sorted by (priority, rule_id) — ties broken by id.

    Accepts a rule DataFrame (RULE schema) or tuples (see sources.seed)."""
    if isinstance(rules, DataFrame):
        have = set(rules.columns)
        opt = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
        rows = (rules.select(opt("rule_id", "string").alias("rule_id"), "field", "operator",
                             opt("value_str", "string").alias("value_str"),
                             opt("value_num", "double").alias("value_num"),
                             "target_queue", "priority", opt("category", "string").alias("category"))
                .limit(max_rules + 1).collect())
        if len(rows) > max_rules:
            raise ValueError(f"rule table has more than {max_rules} rules")
        out = [Rule(r.rule_id or f"r{int(r.priority or 0):04d}-{i}", r.field, r.operator,
                    _value_of(r.value_str, r.value_num), r.target_queue, int(r.priority or 0),
                    r.category) for i, r in enumerate(rows)]
    else:
        out = []
        for t in rules:
            if isinstance(t, Rule):
                out.append(t)
                continue
            prio, field, op, value, target = t[:5]
            cat = t[5] if len(t) > 5 else None
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                value = float(value)
            out.append(Rule(f"r{int(prio):04d}", field, op, value, target, int(prio), cat))
    return sorted(out, key=lambda r: (r.priority, r.rule_id))


def predicate_sql(schema, rule: Rule) -> str:
    """One rule as a boolean SQL condition over ``schema``.  NULL means "no
    match" (it is only used as a CASE WHEN / join condition), so conditions are
    kept minimal: the compiled chain must stay small enough for whole-stage
    codegen."""
    name = resolve_field(schema, rule.field)
    op, v = rule.operator, rule.value
    if op not in OPERATORS:
        return "false"                                       # R5
    if name is None:                                         # missing field
        if op == "contains":
            return "true" if js_string(v) in "undefined" else "false"
        return "false"
    c = q_ident(name)
    dtype = schema[name].dataType
    floating = isinstance(dtype, (DoubleType, FloatType))
    if op == "equals":                                       # R1, strict
        if isinstance(v, float):
            if not isinstance(dtype, NumericType) or math.isnan(v):
                return "false"
            return f"{c} = {q_double(v)}"                    # NaN never equals a number
        if isinstance(v, str) and isinstance(dtype, StringType):
            return f"{c} = {q_str(v)}"
        return "false"
    if op == "contains":                                     # R2 (NULL reads 'undefined')
        return f"contains({to_js_string_sql(c, dtype)}, {q_str(js_string(v))})"
    t = js_number(v)
    if math.isnan(t):
        return "false"
    sym = ">" if op == "greaterThan" else "<"
    if isinstance(dtype, NumericType):
        # Spark orders NaN above every number: only '>' needs the guard
        guard = f" AND NOT isnan({c})" if (floating and sym == ">") else ""
        return f"({c} {sym} {q_double(t)}{guard})"
    return num_cmp_sql(f"({to_number_sql(c, dtype)})", sym, t)   # R3 / R4


def predicate(df, rule: Rule) -> Column:
    """One rule as a boolean Column.  ``df`` is the DataFrame or its schema."""
    schema = df if hasattr(df, "names") else df.schema
    return F.expr(predicate_sql(schema, rule))


# ---------------------------------------------------------------------------
# rule table maintenance
# ---------------------------------------------------------------------------
def load_rules(spark, path: str) -> DataFrame:
    """The rule table ordered by priority (rule_id breaks ties)."""
    return spark.read.parquet(path).orderBy("priority", "rule_id")


def filter_rules(rules: DataFrame, queue: str = "all") -> DataFrame:
    """Rules by target (all / urgent / batch)."""
    if queue == "all":
        return rules
    return rules.filter(F.col("target_queue") == queue)


def type_rule_values(df: DataFrame, text_col: str = "value_text") -> DataFrame:
    """Form text that is numeric becomes a number, otherwise stays text.
    ``isNaN(Number(x))`` decides: blank text is the number 0."""
    from ..functions.coercion import string_to_number
    n = string_to_number(text_col)
    is_num = ~F.isnan(n)
    return (df.withColumn("value_num", F.when(is_num, n))
              .withColumn("value_str", F.when(~is_num, F.col(text_col)))
              .drop(text_col))


def validate_rules(rules: DataFrame) -> DataFrame:
    """``error`` is the reason a rule is refused (NULL = accepted);
    ``warning`` flags accepted rules that can never route as written
    (unknown operator, G4; target other than urgent/batch, G5)."""
    falsy_str = lambda c: F.col(c).isNull() | (F.col(c) == "")
    error = (F.when(falsy_str("field"), "missing_field")
             .when(falsy_str("operator"), "missing_operator")
             .when(F.col("value_str").isNull() & F.col("value_num").isNull(), "missing_value")
             .when(falsy_str("target_queue"), "missing_target")
             .when(F.col("priority").isNull() | (F.col("priority") == 0), "missing_priority"))
    warning = (F.when(~F.col("operator").isin(*OPERATORS), "unknown_operator")
               .when(~F.col("target_queue").isin("urgent", "batch"), "unknown_target"))
    return rules.withColumn("error", error).withColumn(
        "warning", F.when(F.col("error").isNull(), warning))


def apply_rule_changes(rules: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold a change log (create / update / delete, in the order of ``seq``)
    into the rule table.  Returns ``(new_rules, errors)``; ``errors`` holds every
    change that was not applied with its reason: the P11 error of a create or update,
    ``unknown_rule`` for an update or delete of an id that does not exist at that
    moment (never created, not yet created, or deleted), ``unknown_op``.

    An update keeps the fields it omits (NULL); the two value columns change together.
    A create of an existing id replaces the rule.  No task sees all changes of a rule:
    see ``changed_rules`` and ``refused_changes``, which give one of the two each.
    """
    return changed_rules(rules, changes), refused_changes(rules, changes)


def _change_log(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """The rules as creates before all changes, and the changes with their own error."""
    cols = [c for c in rules.columns if c != "rule_id"]
    base = rules.select(F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("op"), "rule_id", *cols,
                        F.lit(None).cast("string").alias("error"))
    # an update need not name every field; those it names must be usable
    given = validate_rules(changes.filter("op = 'create'")).drop("warning")
    partial = changes.filter("op = 'update'").withColumn("error", F.when(F.col("field") == "", "missing_field")
                                                         .when(F.col("operator") == "", "missing_operator")
                                                         .when(F.col("target_queue") == "", "missing_target")
                                                         .when(F.col("priority") == 0, "missing_priority"))
    other = changes.filter("op IS NULL OR op NOT IN ('create', 'update')").withColumn(
        "error", F.when(F.coalesce(F.col("op"), F.lit("")) != "delete", "unknown_op"))
    names = ["seq", "op", "rule_id", *cols, "error"]
    log = base.select(names)
    for part in (given, partial, other):
        log = log.unionByName(part.select(names))
    return log


def changed_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """The rule table after the changes, by partial aggregates: a rule exists if its last
    create or delete is a create, and a field has its newest value if that was set since."""
    cols = [c for c in rules.columns if c != "rule_id"]
    values = [c for c in ("value_str", "value_num") if c in cols]
    at = F.struct("seq")  # a missing seq is before all others

    def newest(what, when):
        return F.max_by(F.struct(at.alias("at"), what.alias("v")), F.when(when, at))
    # both value columns come from the last change that sets either
    both = F.coalesce(*[F.col(c).cast("string") for c in values]).isNotNull() if values else F.lit(False)
    last = (_change_log(rules, changes).filter("error IS NULL").groupBy("rule_id")
            .agg(newest(F.col("op"), F.col("op") != "update").alias("_border"),
                 *[newest(F.col(c), both if c in values else F.col(c).isNotNull()).alias(c) for c in cols]))
    return last.filter("_border.v = 'create'").select(*[
        c if c == "rule_id" else F.when(F.col(f"{c}.at") >= F.col("_border.at"), F.col(f"{c}.v")).alias(c)
        for c in rules.columns])


def refused_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Every change that was not applied: seq, op, rule_id, error.  Whether a rule exists
    before a change follows from the last create or delete, found by blocks of the log."""
    log = _change_log(rules, changes).select("seq", "op", "rule_id", "error")
    border = F.when(F.col("op") != "update", F.col("op"))
    d = last_before(log.filter("error IS NULL").withColumn("_border", border), ["rule_id"], ["seq"], "_border", "_was")
    unknown = d.filter("op <> 'create' AND coalesce(_was <> 'create', true)").select(
        "seq", "op", "rule_id", F.lit("unknown_rule").alias("error"))
    return log.filter("error IS NOT NULL").unionByName(unknown)


def rules_by_category(rules: DataFrame) -> DataFrame:
    """Per category total, urgent and batch rule counts, and a total row from
    ROLLUP; ``is_total`` tells it from rules without a category."""
    return (rules.rollup("category")
            .agg(F.grouping("category").cast("boolean").alias("is_total"),
                 F.count("*").alias("rules"),
                 F.count_if(F.col("target_queue") == "urgent").alias("urgent_rules"),
                 F.count_if(F.col("target_queue") == "batch").alias("batch_rules")))


class RuleVersions(list):
    """R13 as of a time: ``(valid from, rules)`` in time order, milliseconds; the first is
    valid from ever.  A version is valid until the next one."""


def rule_versions(rules: DataFrame, changes: DataFrame, at: str = "at_ms", max_versions: int = 200) -> RuleVersions:
    """The versions of a rule table under a change log whose rows carry their time ``at``
    (the changes of one time make one version, in the order of ``seq``).  Changes that are
    refused change nothing.  The log may be long; more than ``max_versions`` times are
    refused, since every version becomes a compiled chain."""
    times = [r[0] for r in changes.filter(F.col(at).isNotNull()).select(at).distinct().orderBy(at).limit(max_versions + 1).collect()]
    if len(times) > max_versions:
        raise ValueError(f"the change log has more than {max_versions} times")
    out = RuleVersions([(None, collect_rules(rules))])
    for t in times:
        now = collect_rules(changed_rules(rules, changes.filter(F.col(at) <= F.lit(t)).drop(at)))
        if now != out[-1][1]:
            out.append((int(t), now))
    return out
