"""Rule field names -> DataFrame columns (R6: dynamic field access).

A rule names any message field.  Resolution is done once per rule compile:
exact name, then camelCase -> snake_case; names are case-sensitive.  A field that
does not exist is *missing* for every row.
"""

from __future__ import annotations

import re



def camel_to_snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def snake_to_camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def resolve_field(df, field: str | None) -> str | None:
    """``df`` is a DataFrame or a StructType (pass the schema when resolving
    many fields: each ``df.columns`` is a round trip to the JVM)."""
    if not field:
        return None
    cols = df.names if hasattr(df, "names") else df.columns
    if field in cols:
        return field
    if field == "timestamp" and "ts" in cols:
        return "ts"
    # the camelCase name of a snake_case column; a wrong case names no field
    for c in cols:
        if snake_to_camel(c) == field:
            return c
    return None
