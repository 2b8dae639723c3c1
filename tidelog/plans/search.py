"""Event lists: search pages, counts, one event in detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import with_previews
from tidelog.functions.times import to_millisecond
from tidelog.operators.filters import EventFilter
from tidelog.operators.paging import check_page, page_totals, take_slice
from tidelog.schema import DETAIL_COLUMNS, LIST_COLUMNS

# Characters shown of a long text in lists, and where it is cut.
LIST_PREVIEW = 1000
LIST_CUT = ("context", "sql", "exception", "planSQLText", "sdbl")

# Columns of the short list in the analysis view, in order.
ANALYSIS_LIST = (
    "timestamp",
    "event_name",
    "level",
    "duration_ms",
    "directory_name",
    "source_file",
    "usr",
    "context",
    "sql",
    "exception",
    "severity",
    "mssql_error_code",
)


def shown(name: str) -> Column:
    return F.coalesce(name, F.lit(0.0)).alias(name) if name == "duration_ms" else F.col(name)


def search_events(
    events: DataFrame,
    where: EventFilter,
    page: int = 1,
    page_size: int = 50,
    sort_by: str | None = "timestamp",
    sort_order: str | None = "desc",
) -> DataFrame:
    """One page of the full event list, renamed for display, texts cut."""
    offset, limit = check_page(page, page_size)
    kept = with_previews(events.where(where.predicate()), LIST_CUT, LIST_PREVIEW)
    rows = take_slice(kept, offset, limit, sort_by, sort_order)
    return rows.select(*[shown(name).alias(out) for name, out in LIST_COLUMNS.items()])


def count_events(events: DataFrame, where: EventFilter, page_size: int = 50) -> DataFrame:
    return page_totals(events.where(where.predicate()), page_size)


def analysis_events(events: DataFrame, where: EventFilter, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of the short event list, newest first."""
    offset, limit = check_page(page, page_size)
    kept = with_previews(events.where(where.predicate()), ("context", "sql", "exception"), LIST_PREVIEW)
    return take_slice(kept, offset, limit).select(*[shown(name) for name in ANALYSIS_LIST])


def event_detail(events: DataFrame, index: int) -> DataFrame:
    """The event at a position in time order, with its whole texts."""
    row = take_slice(events, index, 1, "timestamp", "asc")
    return row.select(
        F.lit(index).cast("bigint").alias("index"),
        *[F.col(name).alias(out) for name, out in DETAIL_COLUMNS.items()],
    )


def within_sessions(
    events: DataFrame,
    sessions: DataFrame,
    time_from: Column | None = None,
    time_to: Column | None = None,
) -> DataFrame:
    """Events inside their session's interval (or the given bounds), cut to ms.

    For many sessions at once; a single session's bounds go into the filter as
    literals with ``EventFilter.within`` and reach the scan.
    """
    none = F.lit(None).cast("timestamp_ntz")
    bounds = sessions.select(
        "session_id",
        F.coalesce(time_from if time_from is not None else none, to_millisecond(F.col("start_date"))).alias("_from"),
        F.coalesce(time_to if time_to is not None else none, to_millisecond(F.col("end_date"))).alias("_to"),
    )
    return (
        events.join(bounds, "session_id")
        .where((F.col("timestamp") >= F.col("_from")) & (F.col("timestamp") <= F.col("_to")))
        .drop("_from", "_to")
    )
