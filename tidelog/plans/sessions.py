"""Load sessions: listing, progress, overlap, files, storage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import micros_between, ntz, utc_to_moscow
from tidelog.operators.filters import check_interval
from tidelog.operators.intervals import first_overlap
from tidelog.plans.ingest import progress_percent, session_totals
from tidelog.schema import SESSION_SCHEMA

DEFAULT_LIMIT = 100


def elapsed_us(as_of):
    """Microseconds from start to completion, or to ``as_of`` while running."""
    return micros_between(F.col("started_at"), F.coalesce("completed_at", ntz(as_of)))


def filtered_sessions(sessions: DataFrame, status: str | None = None, created_from=None, created_to=None) -> DataFrame:
    """Optional filters; ``all`` and dates that cannot be read are no filter."""
    out = sessions
    if status and status != "all":
        out = out.where(F.col("status") == status)
    for bound, compare in ((created_from, "__ge__"), (created_to, "__le__")):
        if bound is not None and _is_time(bound):
            out = out.where(getattr(F.col("created_at"), compare)(ntz(bound)))
    return out


def _is_time(value) -> bool:
    if isinstance(value, datetime):
        return True
    try:
        datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return False
    return True


def session_list(
    sessions: DataFrame,
    as_of: datetime | str,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    sort_by: str = "created_at",
    status: str | None = None,
    created_from=None,
    created_to=None,
) -> DataFrame:
    """A page of sessions, newest first, with elapsed seconds."""
    if sort_by not in ("created_at", "start_date"):
        raise ValueError("sessions sort by created_at or start_date")
    rows = filtered_sessions(sessions, status, created_from, created_to)
    page = rows.orderBy(F.col(sort_by).desc(), "session_id").offset(offset).limit(limit)
    zero = F.lit(0).cast("bigint")
    return page.select(
        "session_id",
        "status",
        "start_date",
        "end_date",
        "directory_name",
        F.coalesce("comment", F.lit("")).alias("comment"),
        F.coalesce("progress_percent", F.lit(0.0)).alias("progress_percent"),
        F.coalesce("total_events", zero).alias("total_events"),
        F.coalesce("total_files", zero).alias("total_files"),
        F.coalesce("processed_files", zero).alias("processed_files"),
        "created_at",
        "started_at",
        "completed_at",
        (elapsed_us(as_of) / F.lit(1e6)).alias("elapsed_seconds"),
        "error_message",
    )


def session_progress(sessions: DataFrame, as_of: datetime | str) -> DataFrame:
    """Progress, elapsed seconds and, while running, the seconds to go."""
    zero = F.lit(0).cast("bigint")
    done, total = F.coalesce("processed_files", zero), F.coalesce("total_files", zero)
    percent = progress_percent(done, total)
    elapsed = elapsed_us(as_of) / F.lit(1e6)
    running = (F.col("status") == "running") & (percent > 0)
    return sessions.select(
        "session_id",
        "status",
        percent.alias("progress_percent"),
        total.alias("total_files"),
        done.alias("processed_files"),
        F.coalesce("total_events", zero).alias("total_events"),
        "error_message",
        "started_at",
        "completed_at",
        elapsed.alias("elapsed_seconds"),
        F.when(running, F.round(elapsed / percent * 100 - elapsed, 3)).alias("eta_seconds"),
        utc_to_moscow(F.col("started_at")).alias("started_at_msk"),
    )


def running_overlaps(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each requested load, the first running session it overlaps."""
    running = sessions.where(F.col("status") == "running").select(
        F.col("session_id").alias("id"), "start_date", "end_date"
    )
    return first_overlap(requests, running)


def session_files(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """Every session with its file rows (one row with NULLs if it has none)."""
    return sessions.select("session_id", "status", "total_files").join(stats, "session_id", "left")


def without_session(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows that stay when sessions and all that belongs to them are deleted."""
    return table.join(deleted.select("session_id"), "session_id", "left_anti")


def with_footprint(sessions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sessions with stored size; NULL where nothing is stored."""
    return sessions.join(sizes, "session_id", "left")


def file_counts(events: DataFrame) -> DataFrame:
    """Stored events per session and file, the load stats of a stored table."""
    return events.groupBy("session_id", "directory_name", "source_file").agg(
        F.count(F.lit(1)).alias("events"),
        F.max("line_number").alias("last_line_number"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def loaded_session(
    stats: DataFrame, session_id: str, start, end, started_at, completed_at, comment: str = ""
) -> DataFrame:
    """The session row of a finished load, from its file stats."""
    check_interval(start, end)
    row = session_totals(stats).withColumns(
        {
            "session_id": F.lit(session_id),
            "start_date": ntz(start),
            "end_date": ntz(end),
            "directory_name": F.lit(None),
            "status": F.lit("completed"),
            "error_message": F.lit(None),
            "started_at": ntz(started_at),
            "completed_at": ntz(completed_at),
            "created_at": ntz(started_at),
            "comment": F.lit(comment),
            "updated_at": ntz(completed_at),
        }
    )
    return row.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SESSION_SCHEMA])


def sessions_from_events(events: DataFrame) -> DataFrame:
    """Session rows computed from stored events: one per ``session_id``.

    ``completed_at`` takes one second per event, so that the rows depend on
    nothing but the events.
    """
    per_file = events.groupBy("session_id", "directory_name", "source_file").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")
    )
    return per_file.groupBy("session_id").agg(
        F.min("min_ts").alias("start_date"),
        F.max("max_ts").alias("end_date"),
        F.lit(None).cast("string").alias("directory_name"),
        F.lit("completed").alias("status"),
        F.lit(100.0).alias("progress_percent"),
        F.lit(None).cast("string").alias("error_message"),
        F.count(F.lit(1)).alias("total_files"),
        F.count(F.lit(1)).alias("processed_files"),
        F.sum("cnt").alias("total_events"),
        F.max("max_ts").alias("started_at"),
        F.expr("max(max_ts) + make_dt_interval(0, 0, 0, sum(cnt))").alias("completed_at"),
        F.max("max_ts").alias("created_at"),
        F.lit("").alias("comment"),
        F.max("max_ts").alias("updated_at"),
    )
