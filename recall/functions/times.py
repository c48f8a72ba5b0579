"""Time expressions that accept timestamps with and without zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000.0


def instant(value: datetime | str | Column | None) -> Column:
    """A literal point in time, or the start of the current query when not given."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        return literal(value).cast("timestamp")
    return F.lit(value).cast("timestamp")


def literal(value: datetime) -> Column:
    """A point in time as a literal: one without zone is a wall-clock time, whatever the machine's zone is."""
    return F.lit(value) if value.tzinfo else F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(c: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(c.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(MICROS_PER_HOUR)
