"""Registered queries: one per operator of the inventory, each a lazy
DataFrame over the driver tables, paired with a DuckDB oracle where the
semantics are expressible in SQL.

Every query reads the whole ``events`` (or ``orders``) table; limits appear only
where the limit is the feature (newest-N history, newest depth samples).
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BATCH_QUEUE, URGENT_QUEUE
from ..operators import history as H
from ..operators import metrics as M
from ..operators import processing as PR
from ..operators import queues as Q
from ..operators import quality as QL
from ..operators.routing import delivery_priority, explain_route, route_join_form
from ..sources.messages import list_cohorts, read_queue, scan_history
from ..sources.seed import SEED_RULES, seed_rules
from . import fixture as FX
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CHUNK_TIMEOUT_MS = 600_000       # events are minutes apart; see FIXTURES.md
EXPIRY_NOW_MS = 1_706_745_600_000  # 2024-02-01T00:00:00Z, "now" of the expiry report
EXPIRY_TTL_MS = 3_600_000


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ============================================================ routing
@query("route_queue_counts", O.base() + """
SELECT target_queue, count(*) AS n FROM routed GROUP BY target_queue""")
def route_queue_counts(spark, sf):
    """R7 + R8 + P4 (flagship): messages per queue under the 50 seed rules."""
    return FX.routed(spark, sf).groupBy("target_queue").agg(F.count(F.lit(1)).alias("n"))


_DECISION_SQL = O.base() + """
SELECT id AS message_id, benchmark_id, matched_priority, matched_rule_id, matched_rule, target_queue
FROM routed"""


@query("route_decisions", _DECISION_SQL)
def route_decisions(spark, sf):
    """The decision for every message (compiled CASE WHEN chain)."""
    return FX.routed(spark, sf, "chain").select(
        F.col("id").alias("message_id"), "benchmark_id", "matched_priority",
        "matched_rule_id", "matched_rule", "target_queue")


@query("route_decisions_decomposed", _DECISION_SQL)
def route_decisions_decomposed(spark, sf):
    """R7 large-rule-set form (hash lookups + threshold binary search) on the
    same rules: must equal the chain."""
    return FX.routed(spark, sf, "decomposed").select(
        F.col("id").alias("message_id"), "benchmark_id", "matched_priority",
        "matched_rule_id", "matched_rule", "target_queue")


@query("route_join_form", O.base() + """
SELECT id, matched_priority, matched_rule, target_queue FROM routed""")
def route_join_form_q(spark, sf):
    """Relational first match (broadcast rule table, min position)."""
    m = FX.messages(spark, sf)
    return route_join_form(m, SEED_RULES, key="id").select(
        "id", "matched_priority", "matched_rule", "target_queue")


@query("explain_route", O.base() + """
SELECT r.id AS message_id, t.field AS rule_field, t.operator AS rule_operator,
       t.value_str AS rule_value_str, t.value_num AS rule_value_num, t.target AS rule_target
FROM routed r LEFT JOIN rules t ON r.matched_rule_id = t.rule_id""")
def explain_route_q(spark, sf):
    """Which rule fired for each message."""
    e = explain_route(FX.routed(spark, sf), SEED_RULES)
    return e.select(F.col("id").alias("message_id"), "rule_field", "rule_operator",
                    "rule_value_str", "rule_value_num", "rule_target")


@query("route_orders", O.orders_routed() + """
SELECT o_orderkey, matched_priority, matched_rule, target_queue FROM orouted""")
def route_orders(spark, sf):
    """The same engine on a different schema (orders)."""
    return FX.orders_routed(spark, sf).select("o_orderkey", "matched_priority",
                                              "matched_rule", "target_queue")


@query("route_naive_counts", O.with_(O.msgs_cte(), O.naive_cte()) + """
SELECT benchmark_id, target_queue, matched_rule, count(*) AS n FROM naive
GROUP BY benchmark_id, target_queue, matched_rule""")
def route_naive_counts(spark, sf):
    """The baseline policy — one FIFO queue, no rules."""
    return FX.naive_history(spark, sf).groupBy("benchmark_id", "target_queue", "matched_rule") \
        .agg(F.count(F.lit(1)).alias("n"))


_HITS_SQL = O.base() + """, hits AS (SELECT matched_rule_id, count(*) AS hits FROM routed GROUP BY 1)
SELECT r.rule_id, r.priority, r.field, r.operator, r.target AS target_queue, r.category,
       COALESCE(h.hits, 0) AS hits
FROM rules r LEFT JOIN hits h ON r.rule_id = h.matched_rule_id"""


def _rule_hits(spark, sf) -> DataFrame:
    hits = FX.routed(spark, sf).groupBy("matched_rule_id").agg(F.count(F.lit(1)).alias("hits"))
    rules = seed_rules(spark)
    # the rule table is bounded (checked at compile); hits has <= #rules + 1 rows
    return (rules.join(F.broadcast(hits), rules.rule_id == hits.matched_rule_id, "left")
            .select("rule_id", F.col("priority").cast("int").alias("priority"), "field", "operator",
                    "target_queue", "category", F.coalesce("hits", F.lit(0)).alias("hits")))


@query("rule_hits", _HITS_SQL)
def rule_hits(spark, sf):
    """The seed rule table in priority order with its hit counts."""
    return _rule_hits(spark, sf).orderBy("priority", "rule_id")


@query("rule_hits_urgent", _HITS_SQL.replace("FROM rules r LEFT JOIN hits h ON r.rule_id = h.matched_rule_id",
                                              "FROM rules r LEFT JOIN hits h ON r.rule_id = h.matched_rule_id\nWHERE r.target = 'urgent'"))
def rule_hits_urgent(spark, sf):
    """Rules filtered by target queue (urgent)."""
    from ..operators.rules import filter_rules
    return filter_rules(_rule_hits(spark, sf), "urgent")


@query("rule_hits_by_category", O.base() + """, hits AS (SELECT matched_rule_id, count(*) AS hits FROM routed GROUP BY 1)
SELECT r.category, count(*) AS rules, count(*) FILTER (WHERE r.target = 'urgent') AS urgent_rules,
       count(*) FILTER (WHERE r.target = 'batch') AS batch_rules,
       CAST(sum(COALESCE(h.hits, 0)) AS BIGINT) AS messages
FROM rules r LEFT JOIN hits h ON r.rule_id = h.matched_rule_id
GROUP BY ROLLUP (r.category)""")
def rule_hits_by_category(spark, sf):
    """Rules per category (total, urgent, batch; ROLLUP total row) with the
    number of messages each category decided."""
    hr = _rule_hits(spark, sf)
    return (hr.rollup("category")
            .agg(F.count(F.lit(1)).alias("rules"),
                 F.count_if(F.col("target_queue") == "urgent").alias("urgent_rules"),
                 F.count_if(F.col("target_queue") == "batch").alias("batch_rules"),
                 F.sum("hits").cast("long").alias("messages")))


# ---- rule maintenance over a change log derived from ``events``
_CHANGE_COLS = "event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'create' WHEN 3 THEN 'delete' ELSE 'update' END AS op, " \
    "concat('r', lpad(CAST(user_id % 70 + 1 AS VARCHAR(9)), 4, '0')) AS rule_id, " \
    "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'type' ELSE 'amount' END AS field, " \
    "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'equals' ELSE 'lessThan' END AS operator, " \
    "CASE WHEN event_id % 2 = 0 THEN concat('t', CAST(event_id % 9 AS VARCHAR(9))) END AS value_str, " \
    "CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END AS value_num, " \
    "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'urgent' ELSE 'batch' END AS target_queue, " \
    "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id % 60 AS INT) END AS priority, " \
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('c', CAST(event_id % 6 AS VARCHAR(9))) END AS category"

# one change at a time, by recursion: the state of a rule after its n-th change
_FOLD = O.with_(f"rules AS (SELECT * FROM {O.rules_values()})") + f""", chg AS (SELECT {_CHANGE_COLS} FROM events),
checked AS (
  SELECT *, CASE WHEN op = 'create' THEN
      CASE WHEN field IS NULL OR field = '' THEN 'missing_field' WHEN operator IS NULL OR operator = '' THEN 'missing_operator'
           WHEN value_str IS NULL AND value_num IS NULL THEN 'missing_value' WHEN target_queue IS NULL THEN 'missing_target'
           WHEN priority IS NULL OR priority = 0 THEN 'missing_priority' END
    WHEN op = 'update' THEN CASE WHEN field = '' THEN 'missing_field' WHEN priority = 0 THEN 'missing_priority' END END AS error
  FROM chg),
sound AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS n FROM checked WHERE error IS NULL),
start AS (
  SELECT ids.rule_id, CAST(0 AS BIGINT) AS n, r.rule_id IS NOT NULL AS alive, CAST(NULL AS VARCHAR) AS failed, CAST(-1 AS BIGINT) AS seq,
         CAST(NULL AS VARCHAR) AS op, r.field, r.operator, r.value_str, r.value_num, r.target AS target_queue,
         CAST(r.priority AS INT) AS priority, r.category
  FROM (SELECT rule_id FROM rules UNION SELECT rule_id FROM sound) ids LEFT JOIN rules r USING (rule_id)),
fold AS (
  SELECT * FROM start
  UNION ALL
  SELECT f.rule_id, s.n, CASE s.op WHEN 'create' THEN true WHEN 'delete' THEN false ELSE f.alive END,
         CASE WHEN s.op <> 'create' AND NOT f.alive THEN 'unknown_rule' END, s.seq, s.op,
         CASE WHEN s.op = 'update' THEN coalesce(s.field, f.field) ELSE s.field END,
         CASE WHEN s.op = 'update' THEN coalesce(s.operator, f.operator) ELSE s.operator END,
         CASE WHEN s.op = 'update' AND s.value_str IS NULL AND s.value_num IS NULL THEN f.value_str ELSE s.value_str END,
         CASE WHEN s.op = 'update' AND s.value_str IS NULL AND s.value_num IS NULL THEN f.value_num ELSE s.value_num END,
         CASE WHEN s.op = 'update' THEN coalesce(s.target_queue, f.target_queue) ELSE s.target_queue END,
         CASE WHEN s.op = 'update' THEN coalesce(s.priority, f.priority) ELSE s.priority END,
         CASE WHEN s.op = 'update' THEN coalesce(s.category, f.category) ELSE s.category END
  FROM fold f JOIN sound s ON s.rule_id = f.rule_id AND s.n = f.n + 1),
final AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY n DESC) = 1)
"""
_FOLD = _FOLD.replace("WITH ", "WITH RECURSIVE ", 1)
_RULE_COLS = "rule_id, field, operator, value_str, value_num, target_queue, priority, category"


def _folded(spark, sf, form):
    from ..sources.messages import read_table
    from ..sources.seed import seed_rules
    read_table(spark, sf, "events").createOrReplaceTempView("_rule_change_events")
    changes = spark.sql(f"SELECT {_CHANGE_COLS} FROM _rule_change_events")
    return form(seed_rules(spark).drop("description"), changes)


@query("rule_changes", _FOLD + f"SELECT {_RULE_COLS} FROM final WHERE alive")
def rule_changes(spark, sf):
    """The rule table after a log of creates, updates and deletes."""
    from ..operators.rules import changed_rules
    return _folded(spark, sf, changed_rules).select(*_RULE_COLS.split(", "))


@query("rule_change_errors", _FOLD + """
SELECT seq, op, rule_id, error FROM checked WHERE error IS NOT NULL
UNION ALL SELECT seq, op, rule_id, failed AS error FROM fold WHERE failed IS NOT NULL""")
def rule_change_errors(spark, sf):
    """Every change that was not applied, with its reason."""
    from ..operators.rules import refused_changes
    return _folded(spark, sf, refused_changes)


@query("rules_by_category", _FOLD + """
SELECT category, grouping(category) = 1 AS is_total, count(*) AS rules,
       count(*) FILTER (WHERE target_queue = 'urgent') AS urgent_rules,
       count(*) FILTER (WHERE target_queue = 'batch') AS batch_rules
FROM final WHERE alive GROUP BY ROLLUP (category)""")
def rules_by_category_q(spark, sf):
    """The maintained rules per category, the total told from rules without one."""
    from ..operators.rules import changed_rules, rules_by_category
    return rules_by_category(_folded(spark, sf, changed_rules))


# ============================================================ history
_HIST_COLS = ["message_id", "target_queue", "matched_rule", "matched_priority", "latency_ms",
              "ts_ms", "benchmark_id", "is_critical", "message_type", "message_priority",
              "message_region", "risk_score", "amount", "source", "user_id"]


@query("history_rows", O.base() + f"SELECT {', '.join(_HIST_COLS)} FROM hist")
def history_rows(spark, sf):
    """The history projection with falsy -> NULL."""
    return FX.history(spark, sf).select(*_HIST_COLS)


@query("cohort_scan", O.base() + """
SELECT message_id, target_queue, latency_ms FROM hist WHERE benchmark_id = 'bench-1'""")
def cohort_scan(spark, sf):
    """One cohort of the history (filter pushed into the scan)."""
    return scan_history(FX.history(spark, sf), "bench-1").select("message_id", "target_queue", "latency_ms")


_ALL_HIST = O.with_(O.msgs_cte(), O.routed_cte(), O.hist_cte(), O.naive_cte()) + \
    ", allh AS (SELECT * FROM hist UNION ALL SELECT * FROM naive)\n"


@query("list_cohorts", _ALL_HIST + "SELECT DISTINCT benchmark_id FROM allh")
def list_cohorts_q(spark, sf):
    """Distinct benchmark ids (smart cohorts and the naive run)."""
    return list_cohorts(FX.all_history(spark, sf))


@query("count_by_cohort", _ALL_HIST + "SELECT benchmark_id, count(*) AS n FROM allh GROUP BY 1")
def count_by_cohort(spark, sf):
    """Rows per benchmark id."""
    return M.count_by_cohort(FX.all_history(spark, sf))


@query("queue_urgent", O.base() + """
SELECT message_id, benchmark_id, message_type FROM hist WHERE target_queue = 'urgent.queue'""")
def queue_urgent(spark, sf):
    """S3: one queue's messages."""
    return read_queue(FX.history(spark, sf), URGENT_QUEUE).select("message_id", "benchmark_id", "message_type")


@query("routed_delivery", O.base() + """
SELECT message_id, target_queue, CASE WHEN target_queue = 'urgent.queue' THEN 10 ELSE 1 END AS delivery_priority
FROM hist""")
def routed_delivery(spark, sf):
    """K1: every routed message with its delivery priority."""
    h = FX.history(spark, sf)
    return h.select("message_id", "target_queue",
                    delivery_priority(F.col("target_queue")).alias("delivery_priority"))


_REC_COLS = "id, type, priority, amount, risk_score, region, currency, user_id, source, benchmark_id, is_critical"


def _camel(c: str) -> str:
    head, *rest = c.split("_")
    return head + "".join(x.capitalize() for x in rest)


@query("kafka_records", O.with_(O.msgs_cte()) + f"""
SELECT id AS key, to_json(struct_pack({', '.join(f'{_camel(c)} := {c}' for c in _REC_COLS.split(', '))},
  "timestamp" := strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z')) AS value
FROM msgs""")
def kafka_records(spark, sf):
    """K4: key = id, value = JSON text of the message (camelCase, nulls kept, ISO stamp)."""
    from ..sinks.tables import to_kafka_records
    return to_kafka_records(FX.messages(spark, sf).select(*_REC_COLS.split(", "), "ts"), key="id")


# raw feed in SQL: to_json of the same columns, every 50th cut in half, every 53rd without id
_FEED_COLS = ["id", "type", "priority", "amount", "risk_score", "region", "currency",
              "user_id", "source", "benchmark_id", "is_critical"]


def _feed_sql() -> str:
    full = "CAST(to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in _FEED_COLS) + ", ts_ms := ts_ms)) AS VARCHAR)"
    noid = "CAST(to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in _FEED_COLS if c != "id") + ", ts_ms := ts_ms)) AS VARCHAR)"
    return f""", feed AS (
  SELECT id AS key, benchmark_id, ts,
         CASE WHEN event_id % 50 = 0 THEN substr({full}, 1, CAST(length({full}) // 2 AS INTEGER))
              WHEN event_id % 53 = 0 THEN {noid}
              ELSE {full} END AS value
  FROM msgs),
checked AS (
  SELECT *, CASE WHEN NOT json_valid(value) THEN 'malformed_json'
                 WHEN json_type(jv) <> 'OBJECT' THEN 'processing_error'
                 WHEN COALESCE(json_extract_string(jv, '$.id'), '') = ''
                   OR COALESCE(json_extract_string(jv, '$.type'), '') = '' THEN 'missing_required'
            END AS reason
  FROM (SELECT *, CASE WHEN json_valid(value) THEN value END AS jv FROM feed))
"""


_FEED = O.with_(O.msgs_cte()) + _feed_sql()


@query("parse_reject_reasons", _FEED + """
SELECT COALESCE(reason, 'valid') AS reason, count(*) AS n FROM checked GROUP BY 1""")
def parse_reject_reasons(spark, sf):
    """P1 + P10: parse raw text, classify valid / malformed / missing fields."""
    v = FX.validated_feed(spark, sf)
    return v.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("rejects_by_reason", _FEED + """
SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY 1""")
def rejects_by_reason(spark, sf):
    """Dead letters per cause."""
    return QL.rejects_by_reason(FX.rejected_letters(spark, sf))


@query("dead_letter_envelopes", _FEED + """
SELECT key AS message_id, benchmark_id, 'urgent.queue' AS original_queue, reason,
       CASE reason WHEN 'malformed_json' THEN 'malformed JSON'
                   WHEN 'missing_required' THEN 'missing required fields'
                   WHEN 'processing_error' THEN 'processing error' END AS error,
       epoch_us(ts) // 1000 AS failed_ms
FROM checked WHERE reason IS NOT NULL""")
def dead_letter_envelopes(spark, sf):
    """K2: the dead-letter envelope of every rejected message."""
    d = FX.rejected_letters(spark, sf)
    return d.select("message_id", "benchmark_id", "original_queue", "reason", "error",
                    F.unix_millis("failed_at").alias("failed_ms"))


@query("raw_preview", _FEED + """
SELECT key, length(value) AS raw_length,
       substr(value, 1, 80) || CASE WHEN length(value) > 80 THEN '...' ELSE '' END AS preview
FROM feed""")
def raw_preview(spark, sf):
    """Payload length and the first 80 characters."""
    f = FX.raw_feed(spark, sf)
    return QL.preview_raw(f).select("key", "raw_length", "preview")


# ============================================================ processing
_URG = O.base() + f""", ua AS (SELECT *, {O.URGENT_ACTION_SQL} AS action FROM hist WHERE target_queue = 'urgent.queue')
"""


@query("urgent_actions", _URG + f"""
SELECT action, count(*) AS n, CAST(sum({O.URGENT_COST_SQL}) AS BIGINT) AS cost_ms FROM ua GROUP BY action""")
def urgent_actions(spark, sf):
    """P14 + P17: the urgent consumer's action per message and nominal cost."""
    u = read_queue(FX.history(spark, sf), URGENT_QUEUE)
    a = PR.classify_urgent_action(u, "message_type", "amount", "risk_score")
    return a.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_ms").cast("long").alias("cost_ms"))


@query("batch_actions", O.base() + f""", ba AS (SELECT *, {O.BATCH_ACTION_SQL} AS action FROM hist WHERE target_queue = 'batch.queue')
SELECT action, count(*) AS n, CAST(sum({O.BATCH_COST_SQL}) AS BIGINT) AS cost_ms FROM ba GROUP BY action""")
def batch_actions(spark, sf):
    """P15 + P17: the batch consumer's action per type group."""
    b = read_queue(FX.history(spark, sf), BATCH_QUEUE)
    a = PR.classify_batch_action(b, "message_type")
    return a.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_ms").cast("long").alias("cost_ms"))


def _chunks(spark, sf) -> DataFrame:
    b = read_queue(FX.history(spark, sf), BATCH_QUEUE).select("message_id", "message_type", "ts_ms")
    return PR.assign_chunks(b, "ts_ms", "message_id", timeout_ms=CHUNK_TIMEOUT_MS)


_CHUNK_SQL = O.base() + f""", b AS (
  SELECT message_id, message_type, ts_ms,
         row_number() OVER (ORDER BY ts_ms, message_id) AS pos,
         lag(ts_ms) OVER (ORDER BY ts_ms, message_id) AS prev_ms
  FROM hist WHERE target_queue = 'batch.queue'),
runs AS (
  SELECT *, max(CASE WHEN prev_ms IS NULL OR ts_ms - prev_ms >= {CHUNK_TIMEOUT_MS} THEN pos END)
            OVER (ORDER BY ts_ms, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_start
  FROM b),
chunked AS (
  SELECT *, CAST(run_start AS VARCHAR) || ':' || CAST((pos - run_start) // 10 AS VARCHAR) AS chunk_id
  FROM runs)
"""


@query("batch_chunks", _CHUNK_SQL + """
SELECT count(*) AS chunks, max(n) AS largest, count(*) FILTER (WHERE n = 10) AS full_chunks
FROM (SELECT chunk_id, count(*) AS n FROM chunked GROUP BY chunk_id)""")
def batch_chunks(spark, sf):
    """Count-or-timeout batches of the batch consumer (10 messages / 600 s)."""
    return PR.chunk_stats(_chunks(spark, sf))


@query("batch_chunk_types", _CHUNK_SQL + """
SELECT chunk_id, message_type, count(*) AS n FROM chunked GROUP BY chunk_id, message_type""")
def batch_chunk_types(spark, sf):
    """Per batch, messages per type."""
    return PR.group_batch_by_type(_chunks(spark, sf))


@query("batch_chunk_cost", _CHUNK_SQL + f""", pt AS (
  SELECT chunk_id, message_type, count(*) AS n,
         CASE {O.BATCH_ACTION_SQL} WHEN 'warehouse_aggregate' THEN 200 WHEN 'generate_reports' THEN 150 ELSE 100 END AS cost_ms
  FROM chunked GROUP BY chunk_id, message_type)
SELECT chunk_id, CAST(sum(n) AS BIGINT) AS messages, count(*) AS type_groups, CAST(sum(cost_ms) AS BIGINT) AS cost_ms
FROM pt GROUP BY chunk_id""")
def batch_chunk_cost(spark, sf):
    """P17 (batch): a batch costs the sum over its distinct type groups."""
    c = PR.chunk_cost(_chunks(spark, sf))
    return c.select("chunk_id", F.col("messages").cast("long").alias("messages"),
                    "type_groups", F.col("cost_ms").cast("long").alias("cost_ms"))


@query("batch_chunk_rejects", _CHUNK_SQL + """, f AS (
  SELECT chunk_id, bool_or(COALESCE(message_type, 'unknown') = 'unknown') AS batch_failed, count(*) AS n
  FROM chunked GROUP BY chunk_id)
SELECT batch_failed, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS messages FROM f GROUP BY batch_failed""")
def batch_chunk_rejects(spark, sf):
    """ST7: a batch whose processing fails (here: a message of unknown type)
    rejects every message in it."""
    c = PR.reject_failed_chunks(_chunks(spark, sf),
                                F.coalesce(F.col("message_type"), F.lit("unknown")) == "unknown")
    return (c.groupBy("batch_failed")
            .agg(F.countDistinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("messages")))


# ============================================================ processed marks
_MARK_BASE = O.base(O.processed_cte(), O.marked_cte())


@query("processed_marks", _MARK_BASE + """
SELECT benchmark_id, message_id, COALESCE(status, 'routed') AS status, processed_by, processed_ms, processing_time
FROM marked""")
def processed_marks(spark, sf):
    """All history rows whose key was processed get the processed fields."""
    m = H.mark_processed_many(FX.history(spark, sf), FX.processed(spark, sf))
    return m.select("benchmark_id", "message_id", F.coalesce("status", F.lit("routed")).alias("status"),
                    "processed_by", "processed_ms", "processing_time")


_ALL_MARK = O.with_(O.msgs_cte(), O.routed_cte(), O.hist_cte(), O.naive_cte(), O.processed_cte()) + """,
allh AS (SELECT * FROM hist UNION ALL SELECT * FROM naive),
p1 AS (SELECT message_id, max(processed_ms) AS processed_ms FROM processed GROUP BY message_id)
"""


@query("processed_marks_by_id_many", _ALL_MARK + """
SELECT a.benchmark_id, a.message_id, CASE WHEN p1.processed_ms IS NULL THEN 'routed' ELSE 'processed' END AS status,
       p1.processed_ms
FROM allh a LEFT JOIN p1 USING (message_id)""")
def processed_marks_by_id_many(spark, sf):
    """J3 keyed by message id only, as the source system does: a processed id
    marks the smart and the naive row alike."""
    m = H.mark_processed_many(FX.all_history(spark, sf), FX.processed(spark, sf), key=["message_id"])
    return m.select("benchmark_id", "message_id", F.coalesce("status", F.lit("routed")).alias("status"),
                    "processed_ms")


@query("processed_marks_by_id_one", _ALL_MARK + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ts, target_queue) AS rn FROM allh)
SELECT r.benchmark_id, r.message_id,
       CASE WHEN r.rn = 1 AND p1.processed_ms IS NOT NULL THEN 'processed' ELSE 'routed' END AS status,
       CASE WHEN r.rn = 1 THEN p1.processed_ms END AS processed_ms
FROM ranked r LEFT JOIN p1 USING (message_id)""")
def processed_marks_by_id_one(spark, sf):
    """J2 keyed by message id only: find-one-and-update marks just the first
    row of an id (G9)."""
    m = H.mark_processed(FX.all_history(spark, sf), FX.processed(spark, sf), key=["message_id"])
    return m.select("benchmark_id", "message_id", F.coalesce("status", F.lit("routed")).alias("status"),
                    "processed_ms")


@query("status_count", _MARK_BASE + """
SELECT count(*) FILTER (WHERE status = 'processed') AS total_processed FROM marked""")
def status_count(spark, sf):
    """Rows with status processed."""
    return M.status_count(H.mark_processed_many(FX.history(spark, sf), FX.processed(spark, sf)))


@query("present_history", _MARK_BASE + """
SELECT message_id, benchmark_id, message_type, latency_ms,
       COALESCE(status, 'routed') AS status_label,
       CASE WHEN target_queue = 'urgent.queue' THEN 'urgent' ELSE 'batch' END AS queue_label,
       CASE WHEN amount IS NOT NULL AND amount <> 0
            THEN '$' || regexp_replace(format('{:,.3f}', amount), '[.]?0*$', '') ELSE '—' END AS amount_shown,
       CASE WHEN risk_score IS NOT NULL AND risk_score <> 0 THEN printf('%.2f', risk_score) ELSE '—' END AS risk_text,
       COALESCE(risk_score > 0.8, false) AS risk_flag,
       CASE WHEN is_critical THEN 'YES' ELSE '—' END AS critical_label,
       strftime(ts, '%H:%M:%S') AS time_label
FROM marked""")
def present_history(spark, sf):
    """The history table's display columns."""
    return H.present_history(H.mark_processed_many(FX.history(spark, sf), FX.processed(spark, sf)))


@query("recent_history", O.base() + """
SELECT message_id, benchmark_id, ts_ms, target_queue FROM hist
ORDER BY ts DESC, message_id, benchmark_id LIMIT 50""")
def recent_history(spark, sf):
    """The newest 50 history rows (top-k is the feature)."""
    return H.recent_history(FX.history(spark, sf), 50).select("message_id", "benchmark_id", "ts_ms", "target_queue")


@query("recent_history_urgent", O.base() + """
SELECT message_id, benchmark_id, ts_ms, target_queue FROM
  (SELECT * FROM hist ORDER BY ts DESC, message_id, benchmark_id LIMIT 100)
WHERE target_queue = 'urgent.queue'""")
def recent_history_urgent(spark, sf):
    """P5 after T1: newest 100 rows, then the urgent ones."""
    r = H.recent_history(FX.history(spark, sf), 100)
    return H.filter_history(r, "urgent").select("message_id", "benchmark_id", "ts_ms", "target_queue")


@query("valid_history_counts", _MARK_BASE + """
SELECT count(*) FILTER (WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0) AS clean_latency,
       count(*) FILTER (WHERE ts IS NOT NULL) AS valid_ts,
       count(*) FILTER (WHERE processed_ms IS NOT NULL AND ts IS NOT NULL) AS processed_rows
FROM marked""")
def valid_history_counts(spark, sf):
    """Rows kept by the latency, time-stamp and processed filters."""
    m = H.mark_processed_many(FX.history(spark, sf), FX.processed(spark, sf))
    kept = [f(m).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k)) for k, f in (
        ("clean_latency", H.clean_latency), ("valid_ts", H.valid_timestamps), ("processed_rows", H.processed_only))]
    return reduce(DataFrame.unionByName, kept).agg(*[
        F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("clean_latency", "valid_ts", "processed_rows")])


#: A log of rule changes with their times: (seq, op, rule_id, field, operator, value_str,
#: value_num, target_queue, priority, category, at_ms).
RULE_LOG = [
    (1, "delete", "r0009", None, None, None, None, None, None, None, 1_704_672_000_000),
    (2, "update", "r0013", None, None, None, 2000.0, None, None, None, 1_704_672_000_000),
    (3, "create", "r0051", "type", "equals", "unknown", None, "urgent", 51, "eventType", 1_705_363_200_000),
    (4, "update", "r0049", None, None, None, None, "urgent", None, None, 1_705_363_200_000),
    (5, "update", "r9999", None, None, None, None, "urgent", None, None, 1_705_500_000_000),  # refused: no such rule
    (6, "delete", "r0001", None, None, None, None, None, None, None, 1_706_054_400_000)]
_LOG_SCHEMA = ("seq long, op string, rule_id string, field string, operator string, value_str string, value_num double, "
               "target_queue string, priority int, category string, at_ms long")


def _as_of_sql() -> str:
    v1 = [(p, f, o, 2000 if p == 13 else v, t, c) for p, f, o, v, t, c in SEED_RULES if p != 9]
    v2 = [(p, f, o, v, "urgent" if p == 49 else t, c) for p, f, o, v, t, c in v1] + [(51, "type", "equals", "unknown", "urgent", "eventType")]
    cuts = [0, *sorted({r[-1] for r in RULE_LOG if r[0] != 5}), 1 << 62]
    ctes = [O.msgs_cte()]
    for i, rules in enumerate((SEED_RULES, v1, v2, [r for r in v2 if r[0] != 1])):
        ctes.append(f"m{i} AS (SELECT * FROM msgs WHERE ts_ms >= {cuts[i]} AND ts_ms < {cuts[i + 1]})")
        own = O.routed_cte(f"m{i}", rules, name=f"routed{i}")
        ctes.append(own.replace("rules AS (", f"rules{i} AS (").replace("JOIN rules r", f"JOIN rules{i} r").replace("first_match", f"first_match{i}"))
    cols = "id AS message_id, matched_priority, matched_rule_id, matched_rule, target_queue"
    return O.with_(*ctes) + " UNION ALL ".join(f"SELECT {cols} FROM routed{i}" for i in range(4))


@query("route_as_of", _as_of_sql())
def route_as_of_q(spark, sf):
    """Every message routed by the rules that were valid at its time."""
    from ..operators.routing import route_as_of
    from ..operators.rules import rule_versions
    versions = rule_versions(seed_rules(spark).drop("description"), spark.createDataFrame(RULE_LOG, _LOG_SCHEMA))
    return route_as_of(FX.messages(spark, sf), versions).select(
        F.col("id").alias("message_id"), "matched_priority", "matched_rule_id", "matched_rule", "target_queue")


@query("amount_texts", O.base() + """
SELECT message_id, benchmark_id, printf('%.2f', amount) AS fixed, '$' || regexp_replace(format('{:,.3f}', amount), '[.]?0*$', '') AS shown
FROM hist WHERE amount IS NOT NULL AND amount * 64 <> floor(amount * 64)""")
def amount_texts(spark, sf):
    """Amounts as ``toFixed(2)`` and as the view shows them (exact ties, which
    C rounds to even, are left to the tests)."""
    from ..functions.display import money, to_fixed
    h = FX.history(spark, sf).filter("amount IS NOT NULL AND amount * 64 <> floor(amount * 64)")
    return h.select("message_id", "benchmark_id", to_fixed(F.col("amount")).alias("fixed"), money(F.col("amount")).alias("shown"))


# ============================================================ metrics
@query("latency_summary", O.base() + f"""
SELECT count(*) AS n, avg(latency_ms) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
       {O.pdisc('latency_ms', 0.95)} AS p95_ms, {O.pdisc('latency_ms', 0.99)} AS p99_ms
FROM hist WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0""")
def latency_summary(spark, sf):
    """A1 (+ P7): latency avg, min, max, p95, p99."""
    return M.latency_summary(FX.history(spark, sf))


@query("latency_by_queue", O.base() + f"""
SELECT q.target_queue, COALESCE(s.n, 0) AS n, COALESCE(s.avg_ms, 0.0) AS avg_ms, s.p95_ms, s.p99_ms
FROM (VALUES ('urgent.queue'), ('batch.queue')) q(target_queue) LEFT JOIN (
  SELECT target_queue, count(*) AS n, avg(latency_ms) AS avg_ms,
         {O.pdisc('latency_ms', 0.95)} AS p95_ms, {O.pdisc('latency_ms', 0.99)} AS p99_ms
  FROM hist WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0
  GROUP BY target_queue) s USING (target_queue)""")
def latency_by_queue(spark, sf):
    """A2 (+ A23 measured averages): per-queue latency."""
    return M.latency_by_queue(FX.history(spark, sf))


@query("latency_percentiles", _ALL_HIST + f"""
SELECT benchmark_id, {O.pdisc('latency_ms', 0.55)} AS p55_ms, {O.pdisc('latency_ms', 0.95)} AS p95_ms,
       {O.pdisc('latency_ms', 0.99)} AS p99_ms
FROM allh GROUP BY benchmark_id""")
def latency_percentiles(spark, sf):
    """A3: nearest-rank percentiles per cohort."""
    return M.latency_percentiles(FX.all_history(spark, sf))


@query("latency_targets", O.base() + f"""
SELECT q.target_queue, COALESCE(s.p95, 999.0) AS p95_checked_ms,
       CASE WHEN q.target_queue = 'urgent.queue' THEN 100 ELSE 300 END AS target_ms,
       COALESCE(s.p95, 999.0) < CASE WHEN q.target_queue = 'urgent.queue' THEN 100 ELSE 300 END AS passed
FROM (VALUES ('urgent.queue'), ('batch.queue')) q(target_queue) LEFT JOIN (
  SELECT target_queue, {O.pdisc('latency_ms', 0.95)} AS p95 FROM hist GROUP BY target_queue) s USING (target_queue)""")
def latency_targets(spark, sf):
    """A4: p95 targets (urgent < 100 ms, batch < 300 ms)."""
    return M.latency_targets(FX.history(spark, sf))


_DUR_SQL = "CASE WHEN count(ts_ms) > 1 THEN CAST(max(ts_ms) - min(ts_ms) AS DOUBLE) / CAST(1000 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"


@query("throughput", O.base() + f"""
SELECT count(*) AS n, {_DUR_SQL} AS duration_s, CAST(count(*) AS DOUBLE) / ({_DUR_SQL}) AS throughput FROM hist""")
def throughput(spark, sf):
    """A5: messages per second over the history's time span."""
    return M.throughput(FX.history(spark, sf))


@query("queue_share", O.base() + """
SELECT count(*) AS total,
       count(*) FILTER (WHERE target_queue = 'urgent.queue') AS urgent_count,
       count(*) FILTER (WHERE target_queue = 'batch.queue') AS batch_count,
       CAST(count(*) FILTER (WHERE target_queue = 'urgent.queue') AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS urgent_pct,
       CAST(count(*) FILTER (WHERE target_queue = 'batch.queue') AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS batch_pct
FROM hist""")
def queue_share(spark, sf):
    """Queue counts and shares."""
    return M.queue_share(FX.history(spark, sf))


@query("priority_accuracy", O.base() + """
SELECT critical, correct, critical - correct AS misrouted, acc AS accuracy_pct, acc >= 99.0 AS meets_target FROM (
  SELECT count(*) FILTER (WHERE is_critical) AS critical,
         count(*) FILTER (WHERE is_critical AND target_queue = 'urgent.queue') AS correct,
         CASE WHEN count(*) FILTER (WHERE is_critical) > 0 THEN
           CAST(count(*) FILTER (WHERE is_critical AND target_queue = 'urgent.queue') AS DOUBLE) * CAST(100 AS DOUBLE)
           / CAST(count(*) FILTER (WHERE is_critical) AS DOUBLE) ELSE 0.0 END AS acc
  FROM hist)""")
def priority_accuracy(spark, sf):
    """Critical messages routed to the urgent queue."""
    return M.priority_accuracy(FX.history(spark, sf))


@query("overall_accuracy", O.base() + """
SELECT total, critical_correct, noncritical_correct,
       CAST(critical_correct + noncritical_correct AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(total AS DOUBLE) AS overall_pct FROM (
  SELECT count(*) AS total,
         count(*) FILTER (WHERE is_critical AND target_queue = 'urgent.queue') AS critical_correct,
         count(*) FILTER (WHERE NOT is_critical AND target_queue = 'batch.queue') AS noncritical_correct
  FROM hist)""")
def overall_accuracy(spark, sf):
    """Overall routing accuracy."""
    return M.overall_accuracy(FX.history(spark, sf))


_WAIT = _MARK_BASE + """, w AS (
  SELECT target_queue, CAST(processed_ms - ts_ms AS DOUBLE) AS wait_ms FROM marked
  WHERE processed_ms IS NOT NULL AND ts IS NOT NULL AND processed_ms - ts_ms >= 0)
"""


@query("queue_wait", _WAIT + f"""
SELECT target_queue, count(*) AS n, avg(wait_ms) AS avg_ms, min(wait_ms) AS min_ms, max(wait_ms) AS max_ms,
       {O.pdisc('wait_ms', 0.95)} AS p95_ms
FROM w WHERE target_queue IN ('urgent.queue', 'batch.queue') GROUP BY target_queue""")
def queue_wait(spark, sf):
    """Processed-minus-routed wait per queue."""
    return M.queue_wait(H.mark_processed_many(FX.history(spark, sf), FX.processed(spark, sf)))


@query("priority_effectiveness", _WAIT + """
SELECT u AS urgent_avg_ms, b AS batch_avg_ms,
       CASE WHEN u IS NOT NULL AND b IS NOT NULL THEN (b - u) * CAST(100 AS DOUBLE) / b END AS effectiveness_pct
FROM (SELECT avg(wait_ms) FILTER (WHERE target_queue = 'urgent.queue') AS u,
             avg(wait_ms) FILTER (WHERE target_queue = 'batch.queue') AS b FROM w)""")
def priority_effectiveness(spark, sf):
    """A10: how much sooner urgent messages are processed."""
    return M.priority_effectiveness(H.mark_processed_many(FX.history(spark, sf), FX.processed(spark, sf)))


@query("type_distribution", O.base() + """
SELECT message_type, urgent, batch, urgent + batch AS total, CASE WHEN urgent > batch THEN 'urgent' ELSE 'batch' END AS tag
FROM (SELECT COALESCE(NULLIF(message_type, ''), 'unknown') AS message_type,
             count(*) FILTER (WHERE target_queue = 'urgent.queue') AS urgent,
             count(*) FILTER (WHERE target_queue IS DISTINCT FROM 'urgent.queue') AS batch
      FROM hist GROUP BY 1)""")
def type_distribution(spark, sf):
    """Per message type urgent / batch / total and majority tag."""
    return M.type_distribution(FX.history(spark, sf))


@query("benchmark_summary", O.base() + f""", a AS (
  SELECT CAST(count(*) AS DOUBLE) AS total_messages,
         avg(latency_ms) AS avg_latency_all_ms,
         COALESCE(avg(latency_ms) FILTER (WHERE target_queue = 'urgent.queue'), 0.0) AS avg_latency_urgent_ms,
         COALESCE(avg(latency_ms) FILTER (WHERE target_queue = 'batch.queue'), 0.0) AS avg_latency_batch_ms,
         {O.pdisc('latency_ms', 0.95, "target_queue = 'urgent.queue'")} AS p95_latency_urgent_ms,
         {O.pdisc('latency_ms', 0.95, "target_queue = 'batch.queue'")} AS p95_latency_batch_ms,
         CAST(count(*) AS DOUBLE) / ({_DUR_SQL}) AS throughput_per_s,
         CASE WHEN count(*) FILTER (WHERE is_critical) > 0 THEN
           CAST(count(*) FILTER (WHERE is_critical AND target_queue = 'urgent.queue') AS DOUBLE) * CAST(100 AS DOUBLE)
           / CAST(count(*) FILTER (WHERE is_critical) AS DOUBLE) ELSE 0.0 END AS priority_accuracy_pct,
         CAST(count(*) FILTER (WHERE target_queue = 'urgent.queue') AS DOUBLE) AS urgent_count,
         CAST(count(*) FILTER (WHERE target_queue = 'batch.queue') AS DOUBLE) AS batch_count,
         CAST({len(SEED_RULES)} AS DOUBLE) AS rules_evaluated
  FROM hist)
SELECT metric, value FROM a UNPIVOT (value FOR metric IN (total_messages, avg_latency_all_ms, avg_latency_urgent_ms,
  avg_latency_batch_ms, p95_latency_urgent_ms, p95_latency_batch_ms, throughput_per_s, priority_accuracy_pct,
  urgent_count, batch_count, rules_evaluated))""")
def benchmark_summary(spark, sf):
    """The 11-row summary table."""
    return M.benchmark_summary(FX.history(spark, sf), len(SEED_RULES))


def _cohort_sql(cohort: str) -> str:
    return f"""(SELECT count(*) AS n, avg(latency_ms) AS avg_ms,
       avg(latency_ms) FILTER (WHERE target_queue = 'urgent.queue') AS urgent_avg_ms,
       {O.pdisc('latency_ms', 0.95)} AS p95_ms, {O.pdisc('latency_ms', 0.99)} AS p99_ms,
       CAST(count(*) AS DOUBLE) / ({_DUR_SQL}) AS thr,
       CASE WHEN count(*) FILTER (WHERE is_critical) > 0 THEN
         CAST(count(*) FILTER (WHERE is_critical AND target_queue = 'urgent.queue') AS DOUBLE) * CAST(100 AS DOUBLE)
         / CAST(count(*) FILTER (WHERE is_critical) AS DOUBLE) ELSE 0.0 END AS acc
  FROM allh WHERE benchmark_id = '{cohort}')"""


def _imp(base: str, new: str, rev: bool = False) -> str:
    num = f"({new} - {base})" if rev else f"({base} - {new})"
    return f"CASE WHEN {base} > 0 THEN {num} * CAST(100 AS DOUBLE) / {base} ELSE 0.0 END"


@query("compare_cohorts", _ALL_HIST + f""", s AS {_cohort_sql(FX.SMART_ID)}, v AS {_cohort_sql(FX.NAIVE_ID)},
row AS (SELECT s.n AS smart_messages, v.n AS naive_messages, s.avg_ms AS smart_avg_ms, v.avg_ms AS naive_avg_ms,
   COALESCE(s.urgent_avg_ms, 0.0) AS smart_urgent_avg_ms, s.p95_ms AS smart_p95_ms, v.p95_ms AS naive_p95_ms,
   s.p99_ms AS smart_p99_ms, v.p99_ms AS naive_p99_ms, s.thr AS smart_throughput, v.thr AS naive_throughput,
   s.acc AS smart_accuracy_pct, CAST(0 AS DOUBLE) AS naive_accuracy_pct FROM s, v)
SELECT *, {_imp('naive_avg_ms', 'smart_avg_ms')} AS latency_reduction_pct,
       {_imp('naive_p95_ms', 'smart_p95_ms')} AS p95_improvement_pct,
       {_imp('naive_throughput', 'smart_throughput', True)} AS throughput_change_pct
FROM row""")
def compare_cohorts(spark, sf):
    """A13 + A14 + J5: smart cohort vs naive baseline, side by side."""
    return M.compare_cohorts(FX.all_history(spark, sf), FX.SMART_ID, FX.NAIVE_ID)


_LIVE = O.base() + """, last AS (SELECT * FROM hist ORDER BY ts DESC, message_id, benchmark_id LIMIT 1000),
lm AS (
  SELECT count(*) AS total_messages, COALESCE(avg(latency_ms), 0.0) AS avg_latency_ms,
         count(*) FILTER (WHERE target_queue = 'urgent.queue') AS urgent_count,
         count(*) FILTER (WHERE target_queue = 'batch.queue') AS batch_count,
         CASE WHEN count(*) = 0 THEN 0.0
              WHEN count(*) FILTER (WHERE is_critical) > 0 THEN
                CAST(count(*) FILTER (WHERE is_critical AND target_queue = 'urgent.queue') AS DOUBLE) * CAST(100 AS DOUBLE)
                / CAST(count(*) FILTER (WHERE is_critical) AS DOUBLE)
              ELSE 100.0 END AS accuracy_pct,
         CASE WHEN count(*) = 0 THEN 0.0 ELSE
           CAST(count(*) AS DOUBLE) / greatest(CASE WHEN count(ts_ms) > 1 THEN CAST(max(ts_ms) - min(ts_ms) AS DOUBLE) / CAST(1000 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, CAST(1 AS DOUBLE)) END AS throughput
  FROM last)
"""


@query("live_metrics", _LIVE + "SELECT *, accuracy_pct >= 95.0 AS accuracy_ok FROM lm")
def live_metrics(spark, sf):
    """A15 (+ T2): endpoint metrics over the newest 1000 rows."""
    return M.live_metrics(FX.history(spark, sf))


@query("queue_split", _LIVE + """
SELECT CAST(round(CAST(urgent_count AS DOUBLE) / (CASE WHEN urgent_count + batch_count = 0 THEN 1 ELSE urgent_count + batch_count END) * CAST(100 AS DOUBLE)) AS BIGINT) AS urgent_share,
       CAST(round(CAST(batch_count AS DOUBLE) / (CASE WHEN urgent_count + batch_count = 0 THEN 1 ELSE urgent_count + batch_count END) * CAST(100 AS DOUBLE)) AS BIGINT) AS batch_share
FROM lm""")
def queue_split(spark, sf):
    """Rounded urgent / batch shares of the live metrics."""
    return M.queue_split(M.live_metrics(FX.history(spark, sf)))


_FEED_ALL = O.with_(O.msgs_cte(), O.routed_cte(), O.hist_cte(), O.processed_cte()) + _feed_sql() + \
    """, dlq AS (SELECT key AS message_id, benchmark_id, reason FROM checked WHERE reason IS NOT NULL)
"""


@query("queue_stats", _FEED_ALL + """
SELECT count(*) FILTER (WHERE target_queue = 'urgent.queue') AS urgent_count,
       count(*) FILTER (WHERE target_queue = 'batch.queue') AS batch_count,
       (SELECT count(*) FROM dlq) AS dlq_count,
       (SELECT count(*) FROM processed WHERE status = 'processed') AS total_processed
FROM hist h
WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.benchmark_id = h.benchmark_id AND p.message_id = h.message_id)
  AND NOT EXISTS (SELECT 1 FROM dlq d WHERE d.benchmark_id = h.benchmark_id AND d.message_id = h.message_id)""")
def queue_stats(spark, sf):
    """Pending depth per queue, dead letters, total processed."""
    dl = FX.rejected_letters(spark, sf)
    return Q.queue_stats(FX.history(spark, sf), FX.processed(spark, sf), dl, rejected=dl)


@query("processed_counters", _FEED_ALL + """
SELECT COALESCE(p.consumer, r.consumer) AS consumer, COALESCE(p.processed, 0) AS processed,
       COALESCE(r.rejected, 0) AS rejected
FROM (SELECT processed_by AS consumer, count(*) AS processed FROM processed GROUP BY 1) p
FULL OUTER JOIN (SELECT 'urgent-consumer' AS consumer, count(*) AS rejected FROM dlq) r USING (consumer)""")
def processed_counters(spark, sf):
    """Processed and rejected per consumer."""
    return Q.processed_counters(FX.processed(spark, sf), FX.rejected_letters(spark, sf))


@query("send_progress", _ALL_HIST + """, s AS (
  SELECT benchmark_id, ts_ms,
         row_number() OVER (PARTITION BY benchmark_id ORDER BY ts_ms, message_id) AS sent,
         count(*) OVER (PARTITION BY benchmark_id) AS total,
         min(ts_ms) OVER (PARTITION BY benchmark_id) AS t0
  FROM allh)
SELECT benchmark_id, sent, CAST(ts_ms - t0 AS DOUBLE) / CAST(1000 AS DOUBLE) AS elapsed_s,
       floor(CAST(sent AS DOUBLE) / (CAST(ts_ms - t0 AS DOUBLE) / CAST(1000 AS DOUBLE))) AS rate
FROM s WHERE sent % 1000 = 0 OR sent = total""")
def send_progress(spark, sf):
    """Cumulative sent count and rate at every 1000th message."""
    return M.send_progress(FX.all_history(spark, sf))


@query("publish_latency_summary", O.with_(O.msgs_cte(), O.naive_cte()) + f"""
SELECT count(*) AS n, avg(latency_ms) AS avg_ms, {O.pdisc('latency_ms', 0.95)} AS p95_ms,
       floor(CAST(count(*) AS DOUBLE) / (CAST(max(ts_ms) - min(ts_ms) AS DOUBLE) / CAST(1000 AS DOUBLE))) AS throughput,
       CAST(0 AS DOUBLE) AS accuracy_pct
FROM naive""")
def publish_latency_summary(spark, sf):
    """The naive run's own summary."""
    return M.publish_latency_summary(FX.naive_history(spark, sf))


# ============================================================ queues
@query("expired_messages", O.base(O.processed_cte()) + f"""
SELECT h.target_queue AS original_queue, h.benchmark_id, h.message_id, 'expired' AS reason,
       h.ts_ms + {EXPIRY_TTL_MS} AS failed_ms
FROM hist h WHERE h.ts_ms < {EXPIRY_NOW_MS - EXPIRY_TTL_MS}
  AND NOT EXISTS (SELECT 1 FROM processed p WHERE p.benchmark_id = h.benchmark_id AND p.message_id = h.message_id)""")
def expired_messages(spark, sf):
    """ST4 (batch form): unprocessed an hour after routing, as of 2024-02-01."""
    e = Q.expire_to_dead_letter(FX.history(spark, sf), FX.processed(spark, sf),
                                EXPIRY_NOW_MS, EXPIRY_TTL_MS)
    return e.select("original_queue", "benchmark_id", "message_id", "reason",
                    F.unix_millis("failed_at").alias("failed_ms"))


# a rejected message leaves the queue it was routed to when it is rejected, and stands in
# the dead letters from then on; its row in the processed log does not count
_DEPTH = _FEED_ALL + """, gone AS (
  SELECT key AS message_id, benchmark_id, epoch_us(ts) // 1000 AS ms FROM checked WHERE reason IS NOT NULL),
left_queue AS (
  SELECT benchmark_id, message_id, min(ms) AS ms FROM gone GROUP BY 1, 2),
ev AS (
  SELECT target_queue, ts_ms AS ems, 1 AS delta FROM hist
  UNION ALL
  SELECT h.target_queue, p.processed_ms, -1
  FROM processed p JOIN hist h USING (benchmark_id, message_id)
  WHERE NOT EXISTS (SELECT 1 FROM left_queue g WHERE g.message_id = p.message_id AND g.benchmark_id = p.benchmark_id)
  UNION ALL
  SELECT h.target_queue, g.ms, -1 FROM left_queue g JOIN hist h USING (benchmark_id, message_id)
  UNION ALL
  SELECT 'dead.letter.queue', ms, 1 FROM gone),
per AS (SELECT target_queue, (ems // 2000) * 2000 AS window_start_ms, CAST(sum(delta) AS BIGINT) AS net
        FROM ev GROUP BY 1, 2),
series AS (SELECT target_queue, window_start_ms, net,
                  CAST(sum(net) OVER (PARTITION BY target_queue ORDER BY window_start_ms) AS BIGINT) AS depth
           FROM per)
"""


def _depth_series(spark, sf) -> DataFrame:
    return Q.queue_depth_series(FX.history(spark, sf), FX.processed(spark, sf),
                                rejected=FX.rejected_letters(spark, sf))


@query("queue_depth_series", _DEPTH + "SELECT * FROM series")
def queue_depth_series(spark, sf):
    """ST5 (batch form): depth per queue, dead letters too, at the end of every 2 s window."""
    s = _depth_series(spark, sf)
    return s.select("target_queue", F.unix_millis("window_start").alias("window_start_ms"),
                    F.col("net").cast("long").alias("net"), F.col("depth").cast("long").alias("depth"))


@query("last_depth_samples", _DEPTH + """
SELECT window_start_ms,
       coalesce(last_value(u IGNORE NULLS) OVER (ORDER BY window_start_ms), 0) AS urgent_depth,
       coalesce(last_value(b IGNORE NULLS) OVER (ORDER BY window_start_ms), 0) AS batch_depth,
       coalesce(last_value(d IGNORE NULLS) OVER (ORDER BY window_start_ms), 0) AS dlq_depth
FROM (SELECT window_start_ms, max(depth) FILTER (WHERE target_queue = 'urgent.queue') AS u,
             max(depth) FILTER (WHERE target_queue = 'batch.queue') AS b,
             max(depth) FILTER (WHERE target_queue = 'dead.letter.queue') AS d
      FROM series GROUP BY window_start_ms)
ORDER BY window_start_ms DESC LIMIT 30""")
def last_depth_samples(spark, sf):
    """The newest 30 depth samples."""
    return Q.last_depth_samples(_depth_series(spark, sf)).select(
        F.unix_millis("window_start").alias("window_start_ms"),
        F.col("urgent_depth").cast("long").alias("urgent_depth"),
        F.col("batch_depth").cast("long").alias("batch_depth"),
        F.col("dlq_depth").cast("long").alias("dlq_depth"))


@query("priority_drain", O.base() + """
SELECT message_id, target_queue, CASE WHEN target_queue = 'urgent.queue' THEN 10 ELSE 1 END AS delivery_priority, ts_ms
FROM hist""")
def priority_drain(spark, sf):
    """Delivery order of a priority broker (urgent first, FIFO)."""
    return Q.priority_drain(FX.history(spark, sf)).select(
        "message_id", "target_queue", "delivery_priority", "ts_ms")


def all_queries() -> dict:
    from . import dirty, streaming_queries  # noqa: F401  (register theirs)
    return dict(QUERIES)


def all_oracles() -> dict:
    from . import dirty, streaming_queries  # noqa: F401
    return dict(ORACLE)


# ============================================================ raw JSON routing
_JSON_MSGS = """msgs_json AS (
  SELECT m.* REPLACE (COALESCE(m.amount, CAST(0 AS DOUBLE)) AS amount)
  FROM msgs m JOIN checked c ON c.key = m.id WHERE c.reason IS NULL)"""


@query("route_json_counts", O.with_(O.msgs_cte()) + _feed_sql() + ", " + _JSON_MSGS + ",\n"
       + O.routed_cte("msgs_json", name="jrouted") + """
SELECT target_queue, matched_priority, count(*) AS n FROM jrouted GROUP BY target_queue, matched_priority""")
def route_json_counts(spark, sf):
    """R1-R8 on the raw JSON feed (VARIANT path): valid messages routed with
    the full dynamic-value semantics — a JSON null amount reads as 0, so the
    'amount lessThan 10' rule takes it (the typed path treats NULL as missing)."""
    from ..operators.quality import split_valid
    from ..operators.routing import route_json
    good, _ = split_valid(FX.validated_feed(spark, sf))
    return (route_json(good, SEED_RULES).groupBy("target_queue", "matched_priority")
            .agg(F.count(F.lit(1)).alias("n")))
