"""Zone-free time helpers (all event times are TIMESTAMP_NTZ)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(value: str | datetime | Column) -> Column:
    """A TIMESTAMP_NTZ column from a text, a naive datetime or a column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def to_millisecond(ts: Column) -> Column:
    """Cut to milliseconds. ``date_trunc`` would go through the session zone."""
    return F.substring(ts.cast("string"), 1, 23).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(1e6)


def start_of(ts: Column, unit: str) -> Column:
    """The start of the day, hour or second, through the zone-free text form."""
    kept, rest = {"day": (10, " 00:00:00"), "hour": (13, ":00:00"), "second": (19, "")}[unit]
    return F.concat(F.substring(ts.cast("string"), 1, kept), F.lit(rest)).cast("timestamp_ntz")


def hour_file(ts: Column) -> Column:
    """``YYMMDDHH.log`` of a time."""
    s = ts.cast("string")
    parts = [F.substring(s, start, 2) for start in (3, 6, 9, 12)]
    return F.concat(*parts, F.lit(".log"))


def iso_text(ts: Column) -> Column:
    """ISO 8601 text; a fraction is shown with all six digits or not at all."""
    s = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.length(s) > 19, F.rpad(s, 26, "0")).otherwise(s)


def utc_to_moscow(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("Europe/Moscow"), ts)
