"""A load from its session row at the start to its end or failure."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans.ingest import ingest
from tidelog.sources.files import Layout
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore


def recorded(
    sessions: SessionStore, session_id: str, load: Callable[[], DataFrame], start: datetime, end: datetime, comment: str = ""
) -> DataFrame:
    """Runs ``load``, which returns load stats, and records it; an error is recorded and raised again."""
    sessions.start(session_id, start, end, datetime.now(), comment=comment)
    try:
        stats = load()
        sessions.complete(session_id, stats, datetime.now())
    except Exception as error:
        sessions.fail(session_id, str(error)[:1000], datetime.now())
        raise
    return stats


def load_session(
    spark: SparkSession,
    events: EventStore,
    sessions: SessionStore,
    layout: Layout,
    session_id: str,
    loaded_at: datetime | str,
    start: datetime,
    end: datetime,
    comment: str = "",
    **options,
) -> DataFrame:
    """``ingest`` as a recorded session: its row, file rows and status are kept in ``sessions``."""
    load = lambda: ingest(spark, events, layout, session_id, loaded_at, start, end, **options)
    return recorded(sessions, session_id, load, start, end, comment)
