"""The session table: one row per load, and the file rows of each load, in Parquet."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.times import ntz
from tidelog.operators.filters import check_interval
from tidelog.plans.ingest import session_totals
from tidelog.schema import SESSION_SCHEMA
from tidelog.session import create_text, drop_path, matching_paths, path_exists, read_text
from tidelog.sources.store import EventStore, glob_literal, partition_value

_TEXTS, _NUMBERS = ("session_id", "file_path", "directory_name", "source_file"), ("file_size", "lines", "events", "errors")
FILE_SCHEMA = T.StructType(
    [*(T.StructField(n, T.StringType()) for n in _TEXTS), *(T.StructField(n, T.LongType()) for n in _NUMBERS), T.StructField("status", T.StringType()), T.StructField("message", T.StringType())]
)


class SessionStore:
    """Sessions and their files under one folder, a partition per session.

    A row is replaced by a dynamic overwrite of its partition, which Spark
    exchanges when the write has ended well, so readers see the old or the new
    row. Deleting a session takes its files, and its events if the event store
    is given. A note of what is to go is written first: from then on the session
    is not shown, and a store that is opened later ends a deletion that broke off.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.recover()

    def sessions(self) -> DataFrame:
        return self._read("sessions", SESSION_SCHEMA)

    def files(self) -> DataFrame:
        return self._read("files", FILE_SCHEMA)

    def put(self, rows: DataFrame) -> None:
        """Write session rows; a session that is there is replaced."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SESSION_SCHEMA]
        self._write(rows.select(*columns), "sessions")

    def put_files(self, rows: DataFrame) -> None:
        """Write the file rows of one or more sessions, replacing those they had."""
        columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in FILE_SCHEMA]
        self._write(rows.select(*columns), "files")

    def start(self, session_id: str, start, end, started_at, directory_name: str | None = None, comment: str = "") -> None:
        """A load begins: status ``running``, no progress yet."""
        check_interval(start, end)
        zero = F.lit(0)
        self.put(
            self._one(
                session_id=F.lit(session_id), start_date=ntz(start), end_date=ntz(end), directory_name=F.lit(directory_name),
                status=F.lit("running"), progress_percent=zero, total_files=zero, processed_files=zero, total_events=zero,
                started_at=ntz(started_at), created_at=ntz(started_at), comment=F.lit(comment), updated_at=ntz(started_at),
            )
        )

    def complete(self, session_id: str, stats: DataFrame, completed_at) -> None:
        """A load has ended well: its file rows and totals, status ``completed``."""
        self.put_files(stats.withColumn("session_id", F.lit(session_id)))
        totals = {name: F.lit(value) for name, value in session_totals(stats).first().asDict().items()}
        done = {"status": F.lit("completed"), "completed_at": ntz(completed_at), "updated_at": ntz(completed_at)}
        self.put(self._session(session_id).withColumns(totals | done))

    def fail(self, session_id: str, message: str, failed_at) -> None:
        """A load has broken off: status ``failed`` with the reason."""
        done = {"status": F.lit("failed"), "error_message": F.lit(message), "completed_at": ntz(failed_at), "updated_at": ntz(failed_at)}
        self.put(self._session(session_id).withColumns(done))

    def delete(self, session_id: str, events: EventStore | None = None) -> bool:
        """Drop a session with its files and events; whether there was one."""
        note = {"session_id": session_id, "events": events.path if events else None}
        name = hashlib.sha256(json.dumps(note).encode()).hexdigest()
        create_text(self.spark, f"{self.path}/deleting/{name}.json", json.dumps(note))
        return self._take_out(note, f"{self.path}/deleting/{name}.json")

    def recover(self) -> list[str]:
        """Ends the deletions that broke off; returns their sessions."""
        notes = [(json.loads(read_text(self.spark, path)), path) for path in self._notes()]
        for note, path in notes:
            self._take_out(note, path)
        return [note["session_id"] for note, _ in notes]

    def _notes(self) -> list[str]:
        return matching_paths(self.spark, f"{glob_literal(self.path)}/deleting/*.json")

    def _take_out(self, note: dict, path: str) -> bool:
        """All that a note names goes, the note itself last. Each step can be repeated."""
        session_id = note["session_id"]
        gone = [EventStore(self.spark, note["events"]).delete_session(session_id)] if note["events"] else []
        gone += [drop_path(self.spark, folder) for table in ("files", "sessions") for folder in self._folders(table, session_id)]
        drop_path(self.spark, path)
        return any(gone)

    def _one(self, **columns: Column) -> DataFrame:
        filled = [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SESSION_SCHEMA]
        return self.spark.range(1).select(*filled)

    def _session(self, session_id: str) -> DataFrame:
        """The row of a session, free of the file it was read from."""
        rows = self.sessions().where(F.col("session_id") == session_id).collect()
        if not rows:
            raise KeyError(session_id)
        return self.spark.createDataFrame(rows, SESSION_SCHEMA)

    def _folders(self, table: str, session_id: str) -> list[str]:
        folders = matching_paths(self.spark, f"{glob_literal(self.path)}/{table}/session_id=*")
        return [folder for folder in folders if partition_value(folder) == session_id]

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/{table}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}").select(*schema.fieldNames())
        # Deletions at work: a few at most.
        going = [json.loads(read_text(self.spark, path))["session_id"] for path in self._notes()]
        return rows.where(~F.col("session_id").isin(going)) if going else rows

    def _write(self, rows: DataFrame, table: str) -> None:
        writer = rows.repartition("session_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("session_id").parquet(f"{self.path}/{table}")

