"""DuckDB SQL used as the independent oracle for the registered queries.

The oracle re-states the semantics in plain SQL over the same Parquet tables:
the message view, then routing in its *relational* form (messages joined with
a VALUES rule table, ``min(priority)`` of the matching rules) — a different
formulation from the compiled ``CASE WHEN`` chain the library runs.
"""

from __future__ import annotations

from ..constants import (ALL_REGIONS, CURRENCIES, SOURCES)
from ..sources.messages import AMOUNT_SCALE, PRIORITY_POOL, TYPE_POOLS
from ..sources.seed import ORDER_RULES, SEED_RULES


def _lst(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _pad(prefix: str, col: str, width: int) -> str:
    s = f"CAST({col} AS VARCHAR)"
    return f"('{prefix}' || lpad({s}, CAST(greatest({width}, length({s})) AS INTEGER), '0'))"


def msgs_cte() -> str:
    g = "(event_id % 4)"
    e4 = "(event_id // 4)"
    types = " ".join(
        f"WHEN {i} THEN list_extract({_lst(p)}, CAST({e4} % {len(p)} + 1 AS INTEGER))"
        for i, p in enumerate(TYPE_POOLS))
    scale = " ".join(f"WHEN {i} THEN CAST({s} AS DOUBLE)" for i, s in enumerate(AMOUNT_SCALE))
    ts_ms = "(epoch_us(CAST(ts AS TIMESTAMP)) // 1000)"
    return f"""msgs AS (
  SELECT {_pad('msg-', 'event_id', 6)} AS id,
         CAST(ts AS TIMESTAMP) AS ts,
         CASE {g} {types} END AS type,
         list_extract({_lst(PRIORITY_POOL)}, CAST(user_id % {len(PRIORITY_POOL)} + 1 AS INTEGER)) AS priority,
         CASE WHEN event_id % 7 = 2 THEN NULL ELSE value * (CASE {g} {scale} END) END AS amount,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(100 AS DOUBLE) AS risk_score,
         list_extract({_lst(ALL_REGIONS)}, CAST(user_id % {len(ALL_REGIONS)} + 1 AS INTEGER)) AS region,
         list_extract({_lst(CURRENCIES)}, CAST(user_id % {len(CURRENCIES)} + 1 AS INTEGER)) AS currency,
         {_pad('user-', 'user_id', 4)} AS user_id,
         list_extract({_lst(SOURCES)}, CAST(event_id % {len(SOURCES)} + 1 AS INTEGER)) AS source,
         'bench-' || CAST({e4} % 2 AS VARCHAR) AS benchmark_id,
         {g} <> 3 AS is_critical,
         CAST((event_id * 37) % 400 AS DOUBLE) AS latency_ms,
         {ts_ms} AS ts_ms,
         CASE WHEN event_id % 5 <> 0 THEN {ts_ms} + (event_id * 13) % 9000 END AS processed_ms,
         event_id
  FROM events)"""


def rules_values(rules=SEED_RULES) -> str:
    rows = []
    for prio, field, op, value, target, cat in rules:
        if isinstance(value, (int, float)):
            vs, vn = "NULL", f"CAST({float(value)!r} AS DOUBLE)"
        else:
            vs, vn = "'" + value.replace("'", "''") + "'", "NULL"
        rows.append(f"('r{prio:04d}', '{field}', '{op}', {vs}, {vn}, '{target}', {prio}, "
                    f"{'NULL' if cat is None else repr(cat)})")
    return ("(VALUES " + ",\n   ".join(rows) +
            ") AS t(rule_id, field, operator, value_str, value_num, target, priority, category)")


# field name -> expression, split by type (string fields / number fields)
MSG_STR = {"type": "m.type", "priority": "m.priority", "region": "m.region",
           "currency": "m.currency", "source": "m.source", "id": "m.id",
           "userId": "m.user_id", "benchmarkId": "m.benchmark_id"}
MSG_NUM = {"amount": "m.amount", "riskScore": "m.risk_score"}
ORD_STR = {"o_orderpriority": "m.o_orderpriority", "o_orderstatus": "m.o_orderstatus"}
ORD_NUM = {"o_totalprice": "m.o_totalprice"}


def _case(mapping: dict) -> str:
    return "CASE r.field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


def match_pred(str_map: dict, num_map: dict) -> str:
    s, n = _case(str_map), _case(num_map)
    return f"""(
      (r.operator = 'equals' AND ((r.value_str IS NOT NULL AND {s} = r.value_str)
                                  OR (r.value_num IS NOT NULL AND {n} = r.value_num)))
   OR (r.operator = 'contains' AND contains(COALESCE({s}, 'undefined'), r.value_str))
   OR (r.operator = 'greaterThan' AND NOT isnan({n}) AND {n} > r.value_num)
   OR (r.operator = 'lessThan' AND NOT isnan({n}) AND {n} < r.value_num))"""


def routed_cte(src: str = "msgs", rules=SEED_RULES, str_map=MSG_STR, num_map=MSG_NUM,
               key: str = "id", name: str = "routed") -> str:
    return f"""rules AS (SELECT * FROM {rules_values(rules)}),
first_match AS (
  SELECT m.{key} AS _k, min(r.priority) AS matched_priority
  FROM {src} m JOIN rules r ON {match_pred(str_map, num_map)}
  GROUP BY m.{key}),
{name} AS (
  SELECT m.*, f.matched_priority, r.rule_id AS matched_rule_id,
         COALESCE(r.target, 'batch') AS matched_rule,
         CASE WHEN COALESCE(r.target, 'batch') = 'urgent' THEN 'urgent.queue' ELSE 'batch.queue' END AS target_queue
  FROM {src} m LEFT JOIN first_match f ON m.{key} = f._k
               LEFT JOIN rules r ON r.priority = f.matched_priority)"""


def hist_cte(src: str = "routed", name: str = "hist") -> str:
    nz = lambda c: f"CASE WHEN {c} = 0 OR isnan({c}) THEN NULL ELSE {c} END"
    ne = lambda c: f"NULLIF({c}, '')"
    return f"""{name} AS (
  SELECT id AS message_id, target_queue, matched_rule, matched_priority, latency_ms, ts,
         {ne('benchmark_id')} AS benchmark_id, COALESCE(is_critical, false) AS is_critical,
         {ne('type')} AS message_type, {ne('priority')} AS message_priority,
         {ne('region')} AS message_region, {nz('risk_score')} AS risk_score,
         {nz('amount')} AS amount, {ne('source')} AS source, {ne('user_id')} AS user_id,
         ts_ms, processed_ms
  FROM {src})"""


def naive_cte(name: str = "naive") -> str:
    return f"""{name} AS (
  SELECT id AS message_id, 'naive.queue' AS target_queue, 'none' AS matched_rule,
         CAST(NULL AS INTEGER) AS matched_priority, latency_ms, ts,
         'naive-0' AS benchmark_id, is_critical, type AS message_type,
         priority AS message_priority, region AS message_region,
         CASE WHEN risk_score = 0 THEN NULL ELSE risk_score END AS risk_score,
         CASE WHEN amount = 0 OR isnan(amount) THEN NULL ELSE amount END AS amount,
         source, user_id, ts_ms, processed_ms
  FROM msgs)"""


URGENT_ACTION_SQL = """CASE WHEN message_type = 'fraud' THEN 'fraud_alert'
     WHEN message_type = 'payment' AND amount > 10000 THEN 'manual_approval'
     WHEN risk_score > 0.8 THEN 'block_transaction'
     ELSE 'fast_track' END"""
URGENT_COST_SQL = """CASE action WHEN 'fraud_alert' THEN 100 WHEN 'manual_approval' THEN 80
     WHEN 'block_transaction' THEN 60 WHEN 'fast_track' THEN 50 END"""
BATCH_ACTION_SQL = """CASE WHEN message_type = 'analytics' THEN 'warehouse_aggregate'
     WHEN message_type = 'report' THEN 'generate_reports'
     WHEN message_type = 'sensor' THEN 'time_series_store'
     ELSE 'generic_batch' END"""
BATCH_COST_SQL = """CASE action WHEN 'warehouse_aggregate' THEN 200 WHEN 'generate_reports' THEN 150
     WHEN 'time_series_store' THEN 100 WHEN 'generic_batch' THEN 100 END"""


def processed_cte(src: str = "hist", name: str = "processed") -> str:
    return f"""{name} AS (
  SELECT benchmark_id, message_id, processed_ms,
         CASE WHEN target_queue = 'urgent.queue' THEN 'urgent-consumer' ELSE 'batch-consumer' END AS processed_by,
         CAST(CASE WHEN target_queue = 'urgent.queue'
              THEN (CASE {URGENT_ACTION_SQL} WHEN 'fraud_alert' THEN 100 WHEN 'manual_approval' THEN 80
                    WHEN 'block_transaction' THEN 60 ELSE 50 END)
              ELSE (CASE {BATCH_ACTION_SQL} WHEN 'warehouse_aggregate' THEN 200 WHEN 'generate_reports' THEN 150
                    ELSE 100 END) END AS DOUBLE) AS processing_time,
         'processed' AS status
  FROM {src} WHERE processed_ms IS NOT NULL)"""


def marked_cte(name: str = "marked") -> str:
    return f"""{name} AS (
  SELECT h.message_id, h.target_queue, h.matched_rule, h.matched_priority, h.latency_ms, h.ts,
         h.benchmark_id, h.is_critical, h.message_type, h.message_priority, h.message_region,
         h.risk_score, h.amount, h.source, h.user_id, h.ts_ms,
         p.processed_ms, p.processed_by, p.processing_time, p.status
  FROM hist h LEFT JOIN processed p USING (benchmark_id, message_id))"""


def pdisc(col: str, p: float, cond: str = "TRUE") -> str:
    """Nearest rank: sorted[ceil(p*n) - 1] (1-based: ceil(p*n), at least 1)."""
    c = f"({col} IS NOT NULL AND NOT isnan({col}) AND {col} >= 0) AND ({cond})"
    return (f"CAST(list_extract(list_sort(list({col}) FILTER (WHERE {c})), "
            f"CAST(greatest(1, ceil(CAST({p} AS DOUBLE) * count({col}) FILTER (WHERE {c}))) AS BIGINT)) AS DOUBLE)")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def base(*extra: str) -> str:
    """msgs -> routed -> hist (+ extra CTEs)."""
    return with_(msgs_cte(), routed_cte(), hist_cte(), *extra)


ORDERS_SRC = """orders_m AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)"""


def orders_routed() -> str:
    return with_(ORDERS_SRC, routed_cte("orders_m", ORDER_RULES, ORD_STR, ORD_NUM,
                                        key="o_orderkey", name="orouted"))
