"""Time helpers: ISO-8601 text, parsing with NULL on error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_ms(ts: Column) -> Column:
    """``toISOString()``: UTC, whatever the session's time zone."""
    return F.date_format(F.timestamp_add("MILLISECOND", F.unix_millis(ts), F.lit("1970-01-01").cast("timestamp_ntz")), ISO_MS)


def parse_ts(text: Column) -> Column:
    """Parse ISO text; invalid -> NULL."""
    return F.coalesce(F.try_to_timestamp(text),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))
