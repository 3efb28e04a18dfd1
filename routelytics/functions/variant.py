"""Rule predicates over raw JSON (VARIANT): the full dynamic-value table.

The typed path treats SQL NULL as a missing field.  JSON keeps the difference:
a missing field is SQL NULL here, a JSON ``null`` is a VARIANT null.  As in the
source system: ``Number(null)`` is 0 (so ``lessThan 10`` matches),
``String(null)`` is 'null', ``String(missing)`` is 'undefined', and ``equals``
is strict on the JSON type.

Each distinct field is extracted once into its own column, with its JSON type,
numeric and text forms as needed, before the rule chain reads them.
"""

from __future__ import annotations

from .coercion import NAN_SQL, number_to_js_string_sql, q_ident, q_str, string_to_number_sql
from .fields import camel_to_snake

NUMERIC_TYPES = "'^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)'"


def json_path(field: str) -> str:
    return "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"


def field_sql(v: str, field: str) -> str:
    """The field as VARIANT; the exact key first, then its snake_case form."""
    paths = [field] + ([camel_to_snake(field)] if camel_to_snake(field) != field else [])
    gets = [f"try_variant_get({v}, {q_str(json_path(p))}, 'variant')" for p in paths]
    return gets[0] if len(gets) == 1 else f"coalesce({', '.join(gets)})"


def type_sql(x: str) -> str:
    """JSON type name of an extracted field: MISSING, NULL, STRING, NUMBER,
    BOOLEAN, OBJECT or ARRAY."""
    t = f"schema_of_variant({x})"
    return (f"CASE WHEN {x} IS NULL THEN 'MISSING' WHEN is_variant_null({x}) THEN 'NULL' "
            f"WHEN {t} = 'STRING' THEN 'STRING' WHEN {t} = 'BOOLEAN' THEN 'BOOLEAN' "
            f"WHEN {t} RLIKE {NUMERIC_TYPES} THEN 'NUMBER' "
            f"WHEN {t} LIKE 'OBJECT%' THEN 'OBJECT' ELSE 'ARRAY' END")


def number_sql(x: str, t: str) -> str:
    """Number(field) given the field (``x``) and its type column (``t``)."""
    s = f"try_variant_get({x}, '$', 'string')"
    return (f"CASE {t} WHEN 'MISSING' THEN {NAN_SQL} WHEN 'NULL' THEN 0.0D "
            f"WHEN 'BOOLEAN' THEN CASE WHEN {s} = 'true' THEN 1.0D ELSE 0.0D END "
            f"WHEN 'NUMBER' THEN try_variant_get({x}, '$', 'double') "
            f"WHEN 'STRING' THEN {string_to_number_sql(s)} ELSE {NAN_SQL} END")


def text_sql(x: str, t: str) -> str:
    """String(field)."""
    s = f"try_variant_get({x}, '$', 'string')"
    num = f"try_variant_get({x}, '$', 'double')"
    return (f"CASE {t} WHEN 'MISSING' THEN 'undefined' WHEN 'NULL' THEN 'null' "
            f"WHEN 'NUMBER' THEN {number_to_js_string_sql(num)} "
            f"WHEN 'OBJECT' THEN '[object Object]' ELSE {s} END")


def field_columns(i: int) -> dict:
    base = f"_jf{i}"
    return {"v": base, "t": f"{base}_t", "n": f"{base}_n", "s": f"{base}_s"}


def predicate_variant_sql(cols: dict, op: str | None, value) -> str:
    """One rule over the extracted columns of its field (``cols`` from
    ``field_columns``)."""
    import math

    from .coercion import js_number, js_string, num_cmp_sql, q_double
    t, n, s, x = (q_ident(cols[k]) for k in ("t", "n", "s", "v"))
    if op == "equals":
        if isinstance(value, float):
            if math.isnan(value):
                return "false"
            return f"({t} = 'NUMBER' AND try_variant_get({x}, '$', 'double') = {q_double(value)})"
        if isinstance(value, str):
            return f"({t} = 'STRING' AND try_variant_get({x}, '$', 'string') = {q_str(value)})"
        return "false"
    if op == "contains":
        return f"contains({s}, {q_str(js_string(value))})"
    if op in ("greaterThan", "lessThan"):
        return num_cmp_sql(n, ">" if op == "greaterThan" else "<", js_number(value))
    return "false"
