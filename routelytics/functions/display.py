"""Presentation helpers (F9, F10, F15): numbers and times as the reports and
views print them.  Metrics stay unrounded in the queries; these only format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_fixed(x: Column, digits: int = 2) -> Column:
    """``toFixed(d)`` for d from 0 to 5: rounds the exact binary value, ties to the larger
    number ('1.00' for 1.005, which is a little less); a negative number is the text of
    its opposite with a sign.

    A double's fraction is an integer over a power of two: over 2^62, or 2^70 if it is
    below 2^-10 (a smaller one with more bits is far below half a last digit).  That
    integer times 10^d is compared with the power in exact decimal arithmetic."""
    if not 0 <= digits <= 5:
        raise ValueError("0 to 5 digits")
    ten = 10 ** digits

    def text(x: Column) -> Column:
        a = F.abs(x)
        f = a - F.floor(a)
        small = f < F.lit(2.0 ** -10)
        m = F.when(small, F.floor(f * F.lit(2.0 ** 70))).otherwise(F.floor(f * F.lit(2.0 ** 62))).cast("decimal(20,0)")
        unit = F.when(small, F.lit(str(2 ** 70)).cast("decimal(22,0)")).otherwise(F.lit(str(2 ** 62)).cast("decimal(22,0)"))
        n = F.call_function("div", m * F.lit(2 * ten).cast("decimal(7,0)") + unit, unit * F.lit(2).cast("decimal(1,0)"))

        def joined(n: Column) -> Column:
            whole = (F.floor(a) + F.when(n == ten, 1).otherwise(0)).cast("long").cast("string")
            return F.concat(whole, F.lit("."), F.lpad((n % ten).cast("string"), digits, "0")) if digits else whole
        fixed = F.transform(F.array(n), joined)[0]
        # from 2^53 on a double is an integer
        fixed = F.when(a < F.lit(2.0 ** 53), fixed).when(a >= F.lit(2.0 ** 53), F.format_string(f"%.{digits}f", a))
        return F.when(F.isnan(x), "NaN").when(x < 0, F.concat(F.lit("-"), fixed)).otherwise(fixed)
    return F.transform(F.array(x.cast("double")), text)[0]  # x is computed once


def locale_number(x: Column) -> Column:
    """``toLocaleString()`` (en-US): thousands separators, at most three
    fraction digits, no trailing zeros."""
    def text(t: Column) -> Column:
        sign, digits = F.regexp_extract(t, "^-?", 0), F.regexp_replace(t, "^-", "")
        whole = F.format_number(F.substring_index(digits, ".", 1).try_cast("decimal(38,0)"), 0)
        rest = F.regexp_replace(F.concat(F.lit("."), F.substring_index(digits, ".", -1)), r"\.?0*$", "")
        return F.when(t == "NaN", t).otherwise(F.concat(sign, whole, rest))
    return F.transform(F.array(to_fixed(x, 3)), text)[0]


def money(x: Column) -> Column:
    """An amount as the history view shows it: a dollar sign before the grouped number."""
    return F.concat(F.lit("$"), locale_number(x))


def clock_time(ts: Column) -> Column:
    """``toLocaleTimeString`` as HH:mm:ss, in UTC whatever the session zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "HH:mm:ss")
