"""Load journal files: lines -> records -> events, rejects and load stats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.numbers import round_ratio
from tidelog.operators.alternative import STAMP, field_records
from tidelog.operators.assemble import Assembled, assemble
from tidelog.operators.parse import events_of, file_facts, parse_records, rejects_of
from tidelog.session import drop_path, path_exists, scratch_path
from tidelog.operators.filters import check_interval
from tidelog.sources.files import Layout, hour_stems, list_files, read_lines
from tidelog.sources.ranges import Opener, file_ranges, open_file, read_ranges, stored_files
from tidelog.sources.store import EventStore

STATS_SCHEMA = (
    "file_path string, directory_name string, source_file string, file_size bigint, "
    "lines bigint, events bigint, errors bigint, status string, message string"
)


@dataclass(frozen=True)
class Load:
    """What parsing a set of journal files gives.

    ``parsed`` has one row per record with a ``reason`` (NULL for an event);
    ``events`` and ``rejects`` are its two halves.
    """

    parsed: DataFrame
    events: DataFrame
    rejects: DataFrame
    assembled: Assembled
    staged: tuple[str, ...]


def parse_lines(
    spark: SparkSession,
    lines: DataFrame,
    layout: Layout,
    session_id: str,
    loaded_at: datetime | str,
    start: datetime | None = None,
    end: datetime | None = None,
    rules: str = "rules",
    encoding: str = "auto",
    codepage: str = "auto",
    include_exception: bool = False,
    votes: DataFrame | None = None,
    chosen: Callable[[Assembled], DataFrame] | None = None,
    form: str = "header",
) -> Load:
    """Parse lines of journal files.

    ``form`` is the record layout: ``header`` (a header line, then properties)
    or ``fields`` (a time stamp, then ``field;value`` lines, always UTF-8).

    ``votes`` are encoding votes of an earlier run (see ``split_table``);
    ``chosen`` picks and numbers the records to parse out of the assembled ones.

    The parsed rows are written to the shared folder once: events, rejects and
    stats are all taken from them, and filters on the reject reason read a
    stored column instead of repeating the pattern matching.
    """
    if form not in ("header", "fields"):
        raise ValueError("form must be 'header' or 'fields'")
    how = {"header": STAMP, "encoding": "utf-8"} if form == "fields" else {"encoding": encoding}
    assembled = assemble(spark, lines, codepage=codepage, facts=file_facts(layout), votes=votes, **how)
    records = chosen(assembled) if chosen else assembled.records
    parsed = field_records(records, start, end) if form == "fields" else parse_records(records, start, end, include_exception)
    path = scratch_path(spark, "parsed")
    parsed.write.option("compression", "zstd").parquet(path)
    parsed = spark.read.parquet(path)
    events = events_of(parsed, session_id, loaded_at, rules)
    return Load(parsed, events, rejects_of(parsed), assembled, (*assembled.staged, path))


def file_stems(start=None, end=None) -> list[str] | None:
    """Name starts of the hour files of an interval, or None (all) when it is open."""
    return hour_stems(start, end) if start is not None and end is not None else None


def parse_files(
    spark: SparkSession, layout: Layout, session_id: str, loaded_at, start=None, end=None, isolate: bool = False, opener: Opener = open_file, **options
) -> Load:
    """Parse the files of an interval. With ``isolate`` a file that cannot be read is left out, and the others are loaded."""
    stems = file_stems(start, end)
    lines = read_ranges(file_ranges(stored_files(spark, layout, stems)), opener) if isolate else read_lines(spark, layout, stems)
    return parse_lines(spark, lines, layout, session_id, loaded_at, start, end, **options)


def load_stats(files: DataFrame, splits: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per file: directory, size, lines, events, errors, a status and a message.

    ``files`` is the listing. A listed file of which no line was read was
    deleted before the scan reached it. A file that could not be read whole has
    the status and message of its failure and counts nothing.
    """
    read = splits.groupBy("file_id").agg(F.sum("n_lines").alias("lines"), F.min("problem").alias("problem"))
    made = parsed.groupBy("file_id").agg(
        F.count_if(F.col("reason").isNull()).alias("events"),
        F.count_if(F.col("reason").isNotNull() & (F.col("record_piece") == 0)).alias("errors"),
    )
    zero = F.lit(0).cast("bigint")
    counted = (
        files.join(read, "file_id", "left")
        .join(made, "file_id", "left")
        .select(
            "file_path",
            "directory_name",
            "source_file",
            "file_size",
            F.when(F.col("problem").isNull(), F.col("lines")).otherwise(zero).alias("lines"),
            F.coalesce("events", zero).alias("events"),
            F.coalesce("errors", zero).alias("errors"),
            "problem",
            (F.col("lines").isNull() & (F.col("file_size") > 0)).alias("unread"),
        )
    )
    failure = F.substring_index("problem", ": ", 1)
    status = (
        F.when(F.col("problem").isNotNull(), failure).when(F.col("unread"), "deleted").when(F.col("events") > 0, "completed").otherwise("empty")
    )
    message = F.substr("problem", F.length(failure) + 3)
    return counted.withColumns({"status": status, "message": message, "lines": F.coalesce("lines", zero)}).drop("unread", "problem")


def session_totals(stats: DataFrame) -> DataFrame:
    """Totals of a load: files, processed files, events, progress percent."""
    done = F.count_if(F.col("status").isin("completed", "empty"))
    return stats.agg(
        F.count(F.lit(1)).alias("total_files"),
        done.alias("processed_files"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
    ).withColumn("progress_percent", progress_percent(F.col("processed_files"), F.col("total_files")))


def progress_percent(processed, total):
    return round_ratio(processed * 100, F.greatest(total, F.lit(1)), 2)


def ingest(
    spark: SparkSession,
    store: EventStore,
    layout: Layout,
    session_id: str,
    loaded_at: datetime | str,
    start: datetime | None = None,
    end: datetime | None = None,
    **options,
) -> DataFrame:
    """Parse files into the event table under a session; returns the load stats.

    The interval is checked first. A root that does not exist (an unmounted
    share, a mistyped name) has no rows and leaves a stored session as it is. A
    file that cannot be read is a row of the stats with its failure
    (``isolate=False``: an error that ends the load).
    The staged folders are removed once the events and the stats are stored.
    """
    if start is not None and end is not None:
        check_interval(start, end)
    if not path_exists(spark, layout.root):
        return spark.createDataFrame([], STATS_SCHEMA)
    load = parse_files(spark, layout, session_id, loaded_at, start, end, **{"isolate": True, **options})
    store.replace_session(session_id, load.events)
    files = list_files(spark, layout, file_stems(start, end))
    path = scratch_path(spark, "load-stats")
    load_stats(files, load.assembled.splits, load.parsed).write.parquet(path)
    for folder in load.staged:
        drop_path(spark, folder)
    return spark.read.parquet(path)
