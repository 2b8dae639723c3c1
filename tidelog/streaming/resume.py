"""Loading files that still grow: each run goes on where the last one stopped, inside a file too."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import ntz
from tidelog.operators.assemble import VOTES, Assembled
from tidelog.plans.ingest import STATS_SCHEMA, load_stats, parse_lines
from tidelog.session import BROADCAST_ROWS, drop_path, matching_paths, path_exists
from tidelog.sources.files import Layout, base_hour
from tidelog.sources.ranges import Opener, file_ranges, open_file, read_ranges, stored_files
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore
from tidelog.streaming.follow import begin_session

LEDGER_SCHEMA = (
    "file_path string, file_id bigint, offset bigint, seen bigint, next_line bigint, closed boolean, "
    + ", ".join(f"{before} bigint" for before in VOTES.values())
)


class Ledger:
    """How far each file has been loaded, a table per run.

    ``offset`` is the byte where the open record begins, the last one that may
    still grow; ``next_line`` is its ordinal; ``seen`` is the size of the file
    at that run; the votes are those for the encoding before ``offset``. A run
    counts once its table is written whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def runs(self) -> list[int]:
        return sorted(int(p.rsplit("/", 2)[1].split("=")[1]) for p in matching_paths(self.spark, f"{self.path}/run=*/_SUCCESS"))

    def rows(self) -> DataFrame:
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.path}/run={runs[-1]}")

    def write(self, run: int, rows: DataFrame) -> None:
        """Ends a run. The tables of runs before the last one are dropped."""
        rows.write.mode("overwrite").parquet(f"{self.path}/run={run}")
        for old in self.runs()[:-2]:
            drop_path(self.spark, f"{self.path}/run={old}")


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def resume(
    spark: SparkSession,
    layout: Layout,
    store: EventStore,
    ledger: Ledger,
    name: str,
    loaded_at: datetime | str,
    closed_before: datetime | str | None = None,
    sessions: SessionStore | None = None,
    opener: Opener = open_file,
    **options,
) -> DataFrame:
    """Loads what the files have gained since the last run; returns load stats of what it read of them.

    Only bytes from the open record of a file on are read. All records but the
    last one of a file are loaded, with the ordinals they have in the whole
    file; the last one is left for the run in which another follows it or the
    hour of the file ends before ``closed_before``, which closes the file.
    Run ``n`` is stored as session ``<name>_<n>`` and then entered in the
    ledger; a run that finds nothing new leaves no trace. A run that breaks off in between is done again under the same
    number and replaces what it has stored, so that no event is lost or there
    twice. A file that cannot be read, or that has become shorter than what
    was loaded of it, gets a row with its failure and keeps its place.
    """
    if layout.parts:
        raise ValueError("only whole hour files can be followed")
    if not path_exists(spark, layout.root):
        return spark.createDataFrame([], STATS_SCHEMA)
    run = max(ledger.runs(), default=-1) + 1
    session_id = f"{name}_{run}"
    old = ledger.rows().drop("file_path")
    limit = F.lit(None).cast("timestamp_ntz") if closed_before is None else ntz(closed_before)
    hour = base_hour(layout.source_file(F.col("file_path")))
    ended = F.concat(hour, F.lit(":59:59.999999")).try_cast("timestamp_ntz") < limit
    zero = lambda column: F.coalesce(column, F.lit(0)).cast("bigint")
    files = stored_files(spark, layout).join(old, "file_id", "left").where(~F.coalesce("closed", F.lit(False)))
    files = files.select(
        "path", "file_path", "file_id", "part", "file_size", zero(F.col("offset")).alias("offset"), F.col("seen"),
        F.coalesce("next_line", F.lit(1)).cast("bigint").alias("next_line"), *[zero(F.col(c)).alias(c) for c in VOTES.values()],
        F.coalesce(ended, F.lit(False)).alias("closes"),
    )
    # One row per file that is open, kept as it is found now: the files may grow while the run goes on.
    state_path = f"{ledger.path}/state-{run}"
    files.write.mode("overwrite").parquet(state_path)
    files = spark.read.parquet(state_path)
    fresh = files.where(F.col("seen").isNull() | (F.col("file_size") != F.col("seen")) | F.col("closes"))
    n = files.count()
    if not fresh.limit(1).count():
        drop_path(spark, state_path)
        return spark.createDataFrame([], STATS_SCHEMA)

    def chosen(found: Assembled) -> DataFrame:
        """The records that are whole, numbered as in the whole file."""
        totals = found.splits.groupBy("file_id").agg(F.sum("n_headers").alias("n_headers"))
        about = _small(fresh.select("file_id", "next_line", "closes").join(totals, "file_id"), n)
        whole = found.records.join(about, "file_id").where(F.col("closes") | (F.col("event_seq") < F.col("n_headers")))
        return whole.withColumn("event_seq", F.col("event_seq") + F.col("next_line") - 1).drop("next_line", "closes", "n_headers")

    votes = fresh.select("file_id", *VOTES.values())
    lines = read_ranges(file_ranges(fresh.where(F.col("file_size") >= F.col("offset"))), opener)
    load = parse_lines(spark, lines, layout, session_id, loaded_at, votes=votes, chosen=chosen, **options)
    stats_path = f"{ledger.path}/stats-{run}"
    _stats(layout, fresh, load).write.mode("overwrite").parquet(stats_path)
    stats = spark.read.parquet(stats_path)
    if sessions:
        begin_session(sessions, session_id, load)
    store.replace_session(session_id, load.events)
    if sessions:
        sessions.complete(session_id, stats, datetime.now())
    ledger.write(run, _advanced(ledger.rows(), files, load.assembled, n))
    for folder in (*load.staged, state_path):
        drop_path(spark, folder)
    return stats


def _stats(layout: Layout, files: DataFrame, load) -> DataFrame:
    """Load stats of the bytes read in this run; a file that has shrunk is an error."""
    path = F.col("file_path")
    listed = files.select("file_id", "file_path", "file_size", layout.directory_name(path).alias("directory_name"), layout.source_file(path).alias("source_file"))
    shrunk = files.where(F.col("file_size") < F.col("offset")).select("file_path", F.lit(True).alias("shrunk"))
    found = load_stats(listed, load.assembled.splits, load.parsed).join(shrunk, "file_path", "left")
    return found.withColumns(
        {
            "status": F.when(F.col("shrunk"), "error").when((F.col("status") == "deleted") & F.col("message").isNull(), "empty").otherwise(F.col("status")),
            "message": F.when(F.col("shrunk"), "the file is shorter than what was loaded of it").otherwise(F.col("message")),
        }
    ).drop("shrunk")


def _advanced(rows: DataFrame, files: DataFrame, found: Assembled, n: int) -> DataFrame:
    """The ledger after a run. A file without a header in what was read, or with a failure, keeps its place."""
    per_file = found.splits.groupBy("file_id").agg(
        F.sum("n_headers").alias("n_headers"), F.max("last_at").alias("last_at"), F.min("problem").alias("problem")
    )
    known = files.join(per_file, "file_id", "left")
    # Votes of the lines before the open record: those of its pieces are cast when it is read again.
    offsets = found.splits.select("file_id", "part", "block_start", "offset").withColumnRenamed("offset", "before")
    pieces = found.pieces.select("file_id", "part", "block_start", "piece", *VOTES).join(offsets, ["file_id", "part", "block_start"])
    pieces = pieces.join(_small(known.select("file_id", "n_headers"), n), "file_id").where(F.col("before") + F.col("piece") < F.col("n_headers"))
    cast = pieces.groupBy("file_id").agg(*[F.sum(column).alias(column) for column in VOTES])
    shrunk = F.col("file_size") < F.col("offset")
    failed = F.col("problem").isNotNull() | shrunk
    moves = ~failed & F.col("last_at").isNotNull()
    closed = F.col("closes") & ~failed
    step = F.when(closed, zero_if_null("n_headers")).otherwise(F.greatest(zero_if_null("n_headers") - 1, F.lit(0)))
    after = known.join(cast, "file_id", "left").select(
        "file_path", "file_id",
        F.when(closed, F.col("file_size")).when(moves, F.col("last_at")).otherwise(F.col("offset")).alias("offset"),
        # A failed file is looked into again in the next run, whatever its size.
        F.when(failed, F.lit(-1)).otherwise(F.col("file_size")).alias("seen"),
        F.when(failed, F.col("next_line")).otherwise(F.col("next_line") + step).alias("next_line"),
        *[F.when(moves, F.col(before) + zero_if_null(column)).otherwise(F.col(before)).alias(before) for column, before in VOTES.items()],
        closed.alias("closed"),
    )
    gone = rows.join(files.select("file_id"), "file_id", "left_anti")
    return after.unionByName(gone.select(*after.columns))


def zero_if_null(column: str):
    return F.coalesce(column, F.lit(0))
