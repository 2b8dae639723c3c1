"""Event filters as one Catalyst predicate."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.times import ntz

# The columns a text search looks into.
EVENT_SEARCH = ("context", "sql", "sdbl")
ANALYSIS_SEARCH = ("context", "sql", "exception")
# Fixed value: durations from here on are outliers for the statistics, in ms.
DURATION_SANITY_MS = 10_000_000


@dataclass(frozen=True)
class EventFilter:
    """Optional conditions, all of which must hold. Empty text is no condition."""

    event_name: str | None = None
    severity: str | None = None
    category: str | None = None
    directory_name: str | None = None
    user: str | None = None
    duration_min: float | None = None
    duration_max: float | None = None
    min_duration_ms: float | None = None
    max_duration_ms: float | None = None
    level_min: int | None = None
    level_max: int | None = None
    mssql_error: int | None = None
    time_from: str | datetime | None = None
    time_to: str | datetime | None = None
    search: str | None = None
    search_columns: tuple[str, ...] = EVENT_SEARCH
    search_mode: str = "literal"

    def within(self, start: datetime, end: datetime) -> EventFilter:
        """Fill missing time bounds from a session's interval, cut to ms."""

        def cut(t: datetime) -> datetime:
            return t.replace(microsecond=t.microsecond // 1000 * 1000)

        return replace(
            self,
            time_from=cut(start) if self.time_from is None else self.time_from,
            time_to=cut(end) if self.time_to is None else self.time_to,
        )

    def predicate(self) -> Column:
        return all_of(self.conditions())

    def conditions(self) -> list[Column]:
        equal = {
            "event_name": self.event_name,
            "severity": self.severity,
            "category": self.category,
            "directory_name": self.directory_name,
            "usr": self.user,
        }
        found = [F.col(name) == F.lit(value) for name, value in equal.items() if value]
        lows = [("duration_ms", self.duration_min), ("duration_ms", self.min_duration_ms), ("level", self.level_min)]
        highs = [("duration_ms", self.duration_max), ("duration_ms", self.max_duration_ms), ("level", self.level_max)]
        found += [F.col(name) >= F.lit(value) for name, value in lows if value is not None]
        found += [F.col(name) <= F.lit(value) for name, value in highs if value is not None]
        if self.mssql_error is not None:
            found.append(F.col("mssql_error_code") == F.lit(self.mssql_error))
        if self.time_from:
            found.append(F.col("timestamp") >= ntz(self.time_from))
        if self.time_to:
            found.append(F.col("timestamp") <= ntz(self.time_to))
        if self.search:
            found.append(text_search(self.search, self.search_columns, self.search_mode))
        return found


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def text_search(text: str, columns: tuple[str, ...], mode: str = "literal") -> Column:
    """Whether any column holds the text: literally, or with % and _ wildcards."""
    if mode not in ("literal", "like"):
        raise ValueError("mode must be 'literal' or 'like'")
    hits = [F.col(c).contains(text) if mode == "literal" else F.col(c).like(f"%{text}%") for c in columns]
    return reduce(lambda a, b: a | b, hits)


def has_db_error() -> Column:
    return F.coalesce(F.col("mssql_error_code") > 0, F.lit(False))


def is_slow(threshold_ms: float = 1000) -> Column:
    return F.col("duration_ms") > threshold_ms


def sane_duration() -> Column:
    return (F.col("duration_ms") > 0) & (F.col("duration_ms") < DURATION_SANITY_MS)


def is_filled(name: str) -> Column:
    return F.col(name) != ""


def check_interval(start: datetime, end: datetime) -> None:
    if end <= start:
        raise ValueError("the end of an interval must lie after its start")
