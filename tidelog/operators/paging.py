"""Sorting, pages, and direct access to deep positions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.numbers import ceil_div
from tidelog.functions.times import ntz, start_of
from tidelog.schema import EVENT_KEY

# Sortable columns; anything else sorts by time.
SORTABLE = ("timestamp", "duration_ms", "event_name", "level")
MAX_PAGE_SIZE = 1000
# Rows a top-k may keep in one task. Pages beyond it are located by counting.
SHALLOW_ROWS = 10_000
# Widths, in ms, by which a deep page sorted by duration is narrowed down.
DURATION_STEPS = (1_000_000, 1_000, 1)


def event_order(sort_by: str | None = "timestamp", sort_order: str | None = "desc") -> list[Column]:
    """A total order: the chosen column, then time (same direction), then the key."""
    first = sort_by if sort_by in SORTABLE else "timestamp"
    ascending = (sort_order or "").lower() == "asc"
    leading = [first] if first == "timestamp" else [first, "timestamp"]
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in leading]
    return order + [F.col(c).asc() for c in EVENT_KEY if c != "timestamp"]


def check_page(page: int, page_size: int) -> tuple[int, int]:
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError("page starts at 1 and page_size is 1..1000")
    return (page - 1) * page_size, page_size


def take_slice(
    events: DataFrame,
    offset: int,
    limit: int,
    sort_by: str | None = "timestamp",
    sort_order: str | None = "desc",
    shallow_rows: int = SHALLOW_ROWS,
) -> DataFrame:
    """Rows ``offset .. offset+limit`` of the sorted events.

    Up to ``shallow_rows`` this is a lazy top-k. A deeper slice is found by
    jobs that run in this call, one per round of ``narrowed``; it has the same
    rows. To go on from a known row, ``after_row`` needs no job.
    """
    if offset + limit > shallow_rows:
        events, offset = narrowed(events, offset, limit, sort_by, sort_order, shallow_rows)
    return events.orderBy(*event_order(sort_by, sort_order)).offset(offset).limit(limit)


def narrowed(
    events: DataFrame, offset: int, limit: int, sort_by: str | None, sort_order: str | None, shallow_rows: int
) -> tuple[DataFrame, int]:
    """Cut the events down to a key range that holds the wanted slice.

    Rows are counted by ever finer values of the sort columns (partial
    aggregates over narrow columns); each round keeps only the values the slice
    touches, until a plain top-k is small enough. The driver sees at most one
    row per touched value, and every touched value holds a row of the slice.
    """
    first = sort_by if sort_by in SORTABLE else "timestamp"
    descending = (sort_order or "").lower() != "asc"
    ts = F.col("timestamp")
    by_time = [(start_of(ts, size), descending) for size in ("day", "hour", "second")]
    steps = {
        "timestamp": [],
        "duration_ms": [
            *((F.floor(F.col("duration_ms") / step), descending) for step in DURATION_STEPS),
            (F.col("duration_ms"), descending),
        ],
        "event_name": [(F.col("event_name"), descending)],
        "level": [(F.col("level"), descending)],
    }[first]
    steps = steps + by_time + [
        (ts, descending),
        (F.col("directory_name"), False),
        (F.col("source_file"), False),
        (F.floor(F.col("line_number") / 10_000), False),
        (F.col("line_number"), False),
    ]
    for depth in range(1, len(steps) + 1):
        if offset + limit <= shallow_rows:
            break
        used = steps[:depth]
        names = [f"v{i}" for i in range(depth)]
        counts = events.groupBy(*[c.alias(n) for (c, _), n in zip(used, names)]).agg(
            F.count(F.lit(1)).alias("n")
        )
        order = [F.col(n).desc() if desc else F.col(n).asc() for (_, desc), n in zip(used, names)]
        running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        touched = (
            counts.withColumn("upto", F.sum("n").over(running))
            .where((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + limit))
            .orderBy(*order)
            .collect()
        )
        if not touched:  # the slice lies beyond the last row
            return events.limit(0), 0
        low, high = touched[0], touched[-1]
        past_low, at_low = _compared(used, [low[n] for n in names])
        past_high, _ = _compared(used, [high[n] for n in names])
        events = events.where((past_low | at_low) & ~past_high)
        if first == "timestamp":
            # The same range on the stored column, which the scan can push down.
            bounds = sorted([low[names[-1]], high[names[-1]]]) if depth <= 4 else []
            if bounds:
                width = [timedelta(days=1), timedelta(hours=1), timedelta(seconds=1), timedelta(0)][depth - 1]
                events = events.where((ts >= ntz(bounds[0])) & (ts <= ntz(bounds[1] + width)))
        if first == "duration_ms" and depth <= len(DURATION_STEPS):
            step = DURATION_STEPS[depth - 1]
            ends = sorted([low[names[depth - 1]], high[names[depth - 1]]])
            ms = F.col("duration_ms")
            events = events.where((ms >= F.lit(float(ends[0] * step))) & (ms < F.lit(float((ends[1] + 1) * step))))
        offset -= low["upto"] - low["n"]
    return events, offset


def _compared(steps: list[tuple[Column, bool]], bound: list) -> tuple[Column, Column]:
    """Whether a row sorts after ``bound``, and whether it equals it."""
    beyond, equal = F.lit(False), F.lit(True)
    for (column, descending), value in zip(steps, bound):
        edge = ntz(value) if isinstance(value, datetime) else F.lit(value)
        further = column < edge if descending else column > edge
        beyond = beyond | (equal & further)
        equal = equal & (column == edge)
    return beyond, equal


def after_row(events: DataFrame, last: dict, page_size: int, sort_by="timestamp", sort_order="desc") -> DataFrame:
    """The page after a given last row: a key-range filter, no offset at all."""
    first = sort_by if sort_by in SORTABLE else "timestamp"
    ascending = (sort_order or "").lower() == "asc"
    leading = [first] if first == "timestamp" else [first, "timestamp"]
    steps = [(F.col(c), not ascending) for c in leading]
    steps += [(F.col(c), False) for c in EVENT_KEY if c != "timestamp"]
    beyond, _ = _compared(steps, [last[c] for c in [*leading, *EVENT_KEY[1:]]])
    # A plain bound on the leading column lets the scan skip row groups.
    lead = ntz(last[first]) if isinstance(last[first], datetime) else F.lit(last[first])
    near = F.col(first) >= lead if ascending else F.col(first) <= lead
    return events.where(near & beyond).orderBy(*event_order(sort_by, sort_order)).limit(page_size)


def page_totals(events: DataFrame, page_size: int) -> DataFrame:
    """Row count and page count of a filtered set."""
    return events.agg(F.count(F.lit(1)).alias("total")).select(
        "total", ceil_div(F.col("total"), page_size).alias("total_pages")
    )
