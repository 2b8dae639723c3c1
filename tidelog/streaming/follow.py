"""Incremental load of newly closed hour files."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.plans.ingest import parse_lines
from tidelog.session import drop_path
from tidelog.sources.files import Layout, as_lines, line_columns
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore


def stream_lines(spark: SparkSession, layout: Layout, max_files: int | None = None) -> DataFrame:
    reader = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", layout.glob())
        .option("lineSep", "\n")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(layout.root).select(*line_columns())


def follow(
    spark: SparkSession,
    layout: Layout,
    store: EventStore,
    name: str,
    checkpoint: str,
    loaded_at: datetime | str,
    stats_path: str | None = None,
    max_files: int | None = None,
    sessions: SessionStore | None = None,
    **options,
) -> StreamingQuery:
    """Load the files that are new since the last run, then stop.

    A file belongs to one micro-batch, so records are assembled inside the
    batch as in a one-off load. An hour in several parts could fall into two
    batches, so a layout with parts is refused. Batch ``n`` is written as session
    ``<name>_<n>`` and replaces that session, so a repeated batch changes
    nothing. With ``sessions`` each batch also has a session row and file rows
    there. Feed closed hours only: a file is not read again when it grows.
    """

    if layout.parts:
        raise ValueError("only whole hour files can be followed")

    def load(batch: DataFrame, batch_id: int) -> None:
        session_id = f"{name}_{batch_id}"
        result = parse_lines(
            batch.sparkSession, as_lines(batch, layout), layout, session_id, loaded_at, **options
        )
        if sessions:
            begin_session(sessions, session_id, result)
        store.replace_session(session_id, result.events)
        if stats_path:
            batch_stats(result, session_id, batch_id).write.mode("overwrite").parquet(
                f"{stats_path}/batch_id={batch_id}"
            )
        if sessions:
            sessions.complete(session_id, file_rows(batch_stats(result, session_id, batch_id), layout), datetime.now())
        for folder in result.staged:
            drop_path(batch.sparkSession, folder)

    return (
        stream_lines(spark, layout, max_files)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def begin_session(sessions: SessionStore, session_id: str, load) -> None:
    """The row of a batch that is being stored; its interval is that of its events."""
    first, last = load.events.agg(F.min("timestamp"), F.max("timestamp")).first()
    now = datetime.now()
    sessions.start(session_id, first or now, (last or now) + timedelta(microseconds=1), now)


def file_rows(stats: DataFrame, layout: Layout) -> DataFrame:
    path, status = F.col("file_path"), F.when(F.col("events") > 0, "completed").otherwise("empty")
    return stats.withColumns(
        {"directory_name": layout.directory_name(path), "source_file": layout.source_file(path), "status": status}
    )


def batch_stats(load, session_id: str, batch_id: int) -> DataFrame:
    """Per file of a batch: lines, events, rejects."""
    made = load.parsed.groupBy("file_id").agg(
        F.count_if(F.col("reason").isNull()).alias("events"),
        F.count_if(F.col("reason").isNotNull() & (F.col("record_piece") == 0)).alias("errors"),
    )
    read = load.assembled.splits.groupBy("file_id").agg(
        F.max("file_path").alias("file_path"), F.sum("n_lines").alias("lines")
    )
    zero = F.lit(0).cast("bigint")
    return read.join(made, "file_id", "left").select(
        F.lit(session_id).alias("session_id"),
        "file_path",
        "lines",
        F.coalesce("events", zero).alias("events"),
        F.coalesce("errors", zero).alias("errors"),
    )
