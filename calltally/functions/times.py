"""Time expressions on wall-clock timestamps (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def wall_clock(text: Column) -> Column:
    """ISO-8601 text as wall-clock time; an offset or Z is dropped without converting.

    Falls back to the first 19 characters; a text without a full date is null.
    """
    trimmed = F.trim(text)
    parsed = F.coalesce(
        trimmed.try_cast("timestamp_ntz"),
        F.substring(trimmed, 1, 19).try_cast("timestamp_ntz"),
    )
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)?$"), parsed)


def before(anchor: Column, seconds: Column) -> Column:
    return anchor - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1000.0)
