"""Dynamic-value helpers: JavaScript-style Number(x), String(x) and truthiness
as Spark SQL expressions (all JVM-side, codegen-friendly).

The helpers build SQL text (``*_sql``), so a compiled rule chain is handed to
the JVM as one expression string instead of thousands of py4j Column calls;
``Column`` wrappers are provided for DataFrame code.

Spark differences neutralised here: ``NaN > x`` is true in Spark, so every
numeric comparison is guarded with ``isnan``; ``try_cast('' as double)`` is NULL
(JS gives 0); ``try_cast('1d')`` is 1.0 (JS gives NaN); hex text is NULL in Spark
(JS reads it).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

DECIMAL_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
HEX_RE = r"^0[xX][0-9a-fA-F]+$"
_NAN = float("nan")


# --------------------------------------------------------------------------
# SQL literal helpers
# --------------------------------------------------------------------------
def q_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def q_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def q_double(v: float) -> str:
    if math.isnan(v):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    r = repr(float(v))
    if "e" in r or "E" in r:
        return f"CAST('{r}' AS DOUBLE)"
    return f"{r}D"


NAN_SQL = q_double(_NAN)


# --------------------------------------------------------------------------
# driver-side (rule values are literals)
# --------------------------------------------------------------------------
def js_number(value) -> float:
    """Number(value) for a rule literal (str / int / float / bool / None)."""
    if value is None:
        return 0.0
    if isinstance(value, bool):
        return 1.0 if value else 0.0
    if isinstance(value, (int, float)):
        return float(value)
    s = str(value).strip()
    if s == "":
        return 0.0
    if re.match(DECIMAL_RE, s):
        return float(s)
    if re.match(HEX_RE, s):
        return float(int(s, 16))
    if s in ("Infinity", "+Infinity"):
        return math.inf
    if s == "-Infinity":
        return -math.inf
    return _NAN


def js_string(value) -> str:
    """String(value) for a rule literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        x = float(value)
        if math.isnan(x):
            return "NaN"
        if math.isinf(x):
            return "Infinity" if x > 0 else "-Infinity"
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        r = repr(x)
        if "e" in r:
            mant, exp = r.split("e")
            exp_i = int(exp)
            if 1e-7 <= abs(x) < 1e21:
                return format(x, "f").rstrip("0").rstrip(".")
            return f"{mant}e{'+' if exp_i > 0 else '-'}{abs(exp_i)}"
        return r
    return str(value)


# --------------------------------------------------------------------------
# SQL text builders (``c`` is a SQL expression, e.g. a quoted column)
# --------------------------------------------------------------------------
def string_to_number_sql(c: str) -> str:
    """Number(text): trimmed; empty -> 0; decimal; hex; +-Infinity; else NaN.
    SQL NULL (missing) -> NaN."""
    t = f"trim({c})"
    return (f"CASE WHEN {c} IS NULL THEN {NAN_SQL} "
            f"WHEN {t} = '' THEN 0.0D "
            f"WHEN {t} RLIKE {q_str(DECIMAL_RE)} THEN try_cast({t} AS DOUBLE) "
            f"WHEN {t} RLIKE {q_str(HEX_RE)} THEN try_cast(conv(substring({t}, 3), 16, 10) AS DOUBLE) "
            f"WHEN {t} IN ('Infinity', '+Infinity') THEN {q_double(math.inf)} "
            f"WHEN {t} = '-Infinity' THEN {q_double(-math.inf)} "
            f"ELSE {NAN_SQL} END")


def to_number_sql(c: str, dtype: DataType) -> str:
    """Number(x) for a typed column; SQL NULL is treated as missing -> NaN."""
    if isinstance(dtype, BooleanType):
        return f"CASE WHEN {c} IS NULL THEN {NAN_SQL} ELSE CAST({c} AS DOUBLE) END"
    if isinstance(dtype, NumericType):
        return f"coalesce(CAST({c} AS DOUBLE), {NAN_SQL})"
    if isinstance(dtype, StringType):
        return string_to_number_sql(c)
    return NAN_SQL


def number_to_js_string_sql(x: str) -> str:
    """String(number) as JavaScript prints it: integers without '.0', plain
    decimals between 1e-7 and 1e21, exponent form 'de+N' otherwise."""
    strip = lambda e: f"regexp_replace(regexp_replace({e}, '0+$', ''), '\\\\.$', '')"
    big = strip(f"CAST(CAST({x} AS DECIMAL(38,16)) AS STRING)")
    small = strip(f"CAST(CAST({x} AS DECIMAL(38,37)) AS STRING)")
    java = f"CAST({x} AS STRING)"
    mant = f"regexp_replace(split({java}, 'E')[0], '\\\\.0$', '')"
    exp = f"try_cast(split({java}, 'E')[1] AS INT)"
    expo = f"concat({mant}, 'e', CASE WHEN {exp} > 0 THEN '+' ELSE '' END, CAST({exp} AS STRING))"
    return (f"CASE WHEN {x} IS NULL THEN CAST(NULL AS STRING) "
            f"WHEN isnan({x}) THEN 'NaN' "
            f"WHEN {x} = {q_double(math.inf)} THEN 'Infinity' "
            f"WHEN {x} = {q_double(-math.inf)} THEN '-Infinity' "
            f"WHEN {x} = 0 THEN '0' "
            f"WHEN {x} = floor({x}) AND abs({x}) < {q_double(1e21)} THEN CAST(CAST({x} AS DECIMAL(38,0)) AS STRING) "
            f"WHEN abs({x}) >= 1 AND abs({x}) < {q_double(1e21)} THEN {big} "
            f"WHEN abs({x}) >= {q_double(1e-7)} AND abs({x}) < 1 THEN {small} "
            f"ELSE {expo} END")


def to_js_string_sql(c: str, dtype: DataType) -> str:
    """String(x) for a typed column; NULL (missing) -> 'undefined'."""
    if isinstance(dtype, StringType):
        s = c
    elif isinstance(dtype, BooleanType):
        s = f"CASE WHEN {c} THEN 'true' WHEN NOT {c} THEN 'false' END"
    elif isinstance(dtype, NumericType):
        s = number_to_js_string_sql(f"CAST({c} AS DOUBLE)")
    else:
        s = f"CAST({c} AS STRING)"
    return f"coalesce({s}, 'undefined')"


def num_cmp_sql(x: str, op: str, v: float) -> str:
    """JS ``x > v`` / ``x < v`` on a double expression: NaN and NULL never match."""
    if math.isnan(v):
        return "false"
    return f"coalesce(NOT isnan({x}) AND {x} {op} {q_double(v)}, false)"


# --------------------------------------------------------------------------
# Column wrappers
# --------------------------------------------------------------------------
def string_to_number(name: str) -> Column:
    return F.expr(string_to_number_sql(q_ident(name)))


def to_number(name: str, dtype: DataType) -> Column:
    return F.expr(to_number_sql(q_ident(name), dtype))


def to_js_string(name: str, dtype: DataType) -> Column:
    return F.expr(to_js_string_sql(q_ident(name), dtype))


def number_to_js_string(name: str) -> Column:
    return F.expr(number_to_js_string_sql(q_ident(name)))


def falsy_to_null(c: Column, dtype: DataType) -> Column:
    """``x || null``: 0, NaN, '' and false become NULL."""
    if isinstance(dtype, StringType):
        return F.when(c != "", c)
    if isinstance(dtype, BooleanType):
        return F.when(c, c)
    if isinstance(dtype, NumericType):
        return F.when((c != 0) & ~F.isnan(c.cast("double")), c)
    return c
