"""The event table: Parquet, partitioned by session and event date, in versions that become visible by a commit."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import date, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import EVENT_COLUMNS, EVENT_SCHEMA, PARTITION_COLUMNS
from tidelog.session import create_text, drop_path, matching_paths, read_text

# Fixed value: events are kept this many days.
RETENTION_DAYS = 90

# Within a partition: the sort key of the event table. Row-group minima and
# maxima of the time then let a scan skip most of a partition.
SORT_KEY = ["session_id", "event_date", "timestamp", "event_name", "directory_name"]


def laid_out(events: DataFrame, narrow: bool = False) -> DataFrame:
    """Rows arranged for the partitioned write.

    Range partitioning by session and time gives each task a contiguous piece,
    so a session of any size is spread over many tasks and each task writes few
    files. ``narrow`` skips that shuffle when the input already comes in pieces
    of one hour, as parsed files do.
    """
    if not narrow:
        events = events.repartitionByRange("session_id", "timestamp")
    return events.sortWithinPartitions(*SORT_KEY)


class EventStore:
    """Events under one folder, with whole-session replace, delete and expiry.

    Nothing but the folder is needed: no catalog has to know the partitions.
    Rows are written to a new version folder and become visible with a commit:
    a file that names the live partitions (session and date) of every version.
    A reader takes them from the last commit once, so it sees the store before
    a change or after it, never both. Partitions that are not live any more
    stay for readers that began earlier, until ``clean`` drops them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def events(self, session_id: str | None = None) -> DataFrame:
        """All events, or one session's (an unknown one has no rows), as of the last commit."""
        live = self._commit()[1]
        if session_id is not None:
            live = {folder for folder in live if _session_of(folder) == session_id}
        if not live:
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        reader = self.spark.read.schema(EVENT_SCHEMA).option("basePath", self.path)
        rows = reader.parquet(*[f"{self.path}/{folder}" for folder in sorted(live)]).select(*EVENT_COLUMNS)
        return rows if session_id is None else rows.where(F.col("session_id") == session_id)

    def write(self, events: DataFrame, narrow: bool = False) -> None:
        """Write events, replacing every (session, date) partition they touch."""
        added = self._write(events, narrow)
        touched = {_partition_of(folder) for folder in added}
        self._change(lambda live: {folder for folder in live if _partition_of(folder) not in touched} | added)

    def replace_session(self, session_id: str, events: DataFrame, narrow: bool = True) -> None:
        """Write a session, replacing all it had. Repeating it changes nothing.

        The old rows stay until the new ones are written and the commit names
        these instead, so a failed write keeps the old rows, and ``events`` may
        be read from this store.
        """
        added = self._write(events.withColumn("session_id", F.lit(session_id)), narrow)
        self._change(lambda live: {folder for folder in live if _session_of(folder) != session_id} | added)

    def delete_session(self, session_id: str) -> bool:
        """Take a session out; other sessions are not touched. Whether there was one."""
        return bool(self._change(lambda live: {folder for folder in live if _session_of(folder) != session_id}))

    def expire(self, as_of: date, days: int = RETENTION_DAYS) -> list[str]:
        """Take out the dates older than ``as_of - days``; returns them."""
        oldest = (as_of - timedelta(days=days)).isoformat()
        gone = self._change(lambda live: {folder for folder in live if partition_value(folder) >= oldest})
        return sorted({partition_value(folder) for folder in gone})

    def clean(self) -> int:
        """Drop partitions and commits that the last commit does not need; returns the number of partitions.

        For a time when no reader or writer that began before the last commit is at work.
        """
        last, live = self._commit()
        gone = [f for f in matching_paths(self.spark, f"{glob_literal(self.path)}/version=*/session_id=*/event_date=*") if "/".join(f.rsplit("/", 3)[1:]) not in live]
        for folder in gone:
            drop_path(self.spark, folder)
        for path in self._commits()[:-1]:
            drop_path(self.spark, path)
        return len(gone)

    def footprint(self) -> DataFrame:
        """Stored size per session in MB, of the live partitions."""
        live = self.spark.createDataFrame([(folder,) for folder in self._commit()[1]], "folder string")
        files = _listed(self.spark, self.path, "*.parquet")
        folder = F.regexp_extract("path", r"/(version=[^/]+/session_id=[^/]+/event_date=[^/]+)/[^/]+$", 1)
        return _sized(files.join(live, folder == F.col("folder"), "left_semi"), _folder_session())

    def _write(self, events: DataFrame, narrow: bool) -> set[str]:
        """The rows in a version folder of their own; returns its partitions."""
        version = f"version={uuid.uuid4().hex}"
        writer = laid_out(events.select(*EVENT_COLUMNS), narrow).write.option("compression", "zstd")
        writer.partitionBy(*PARTITION_COLUMNS).parquet(f"{self.path}/{version}")
        found = matching_paths(self.spark, f"{glob_literal(self.path)}/{version}/session_id=*/event_date=*")
        return {"/".join(folder.rsplit("/", 3)[1:]) for folder in found}

    def _commits(self) -> list[str]:
        return sorted(matching_paths(self.spark, f"{glob_literal(self.path)}/_commits/*.json"))

    def _commit(self) -> tuple[int, set[str]]:
        """The number of the last commit (-1: none) and its live partitions."""
        commits = self._commits()
        if not commits:
            return -1, set()
        return int(commits[-1].rsplit("/", 1)[1].removesuffix(".json")), set(json.loads(read_text(self.spark, commits[-1])))

    def _change(self, after: Callable[[set[str]], set[str]]) -> set[str]:
        """Commits the live partitions ``after`` a change of those there are; returns the ones that went.

        If another writer commits first, the change is made to its commit.
        """
        while True:
            last, live = self._commit()
            new = after(live)
            if new == live:
                return set()
            if create_text(self.spark, f"{self.path}/_commits/{last + 1:012d}.json", json.dumps(sorted(new))):
                return live - new


def _session_of(folder: str) -> str:
    """The session of ``version=.../session_id=.../event_date=...``."""
    return partition_value(folder.rsplit("/", 1)[0])


def _partition_of(folder: str) -> tuple[str, str]:
    return _session_of(folder), partition_value(folder)


def glob_literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def partition_value(folder: str) -> str:
    return unquote(folder.rsplit("/", 1)[1].split("=", 1)[1])


def retained(events: DataFrame, as_of: date, days: int = RETENTION_DAYS) -> DataFrame:
    """The events that an expiry run at ``as_of`` keeps (a partition filter)."""
    return events.where(F.col("event_date") >= F.lit(as_of - timedelta(days=days)))


def _listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, length`` of the files under a folder, from the file listing alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def _folder_session() -> Column:
    return F.url_decode(F.replace(F.regexp_extract("path", r"/session_id=([^/]+)/", 1), F.lit("+"), F.lit("%2B")))


def _sized(files: DataFrame, session: Column) -> DataFrame:
    sizes = files.groupBy(session.alias("session_id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    return sizes.withColumn("size_mb", F.round(F.col("n_bytes") / F.lit(1048576.0), 2))


def footprint(spark: SparkSession, path: str, glob: str = "*.parquet", session: Column | None = None) -> DataFrame:
    """Size of the files under a folder per session (by default the one in a file's path), in MB too."""
    return _sized(_listed(spark, path, glob), _folder_session() if session is None else session)
