"""The ``events`` table seen as journal events.

A fixed mapping (stated in FIXTURES.md) turns each row of the generic event
table into one journal event, so that every query has a SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codes import classified
from tidelog.functions.times import hour_file, ntz, start_of
from tidelog.operators.numbering import number_within
from tidelog.schema import EVENT_COLUMNS, PROPERTY_COLUMNS
from tidelog.session import scratch_path
from tidelog.sources.store import EventStore

LOADED_AT = "2024-02-01 00:00:00"

_stored: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def journal_from_events(events: DataFrame) -> DataFrame:
    """Journal events in the event schema, computed from the ``events`` table."""
    e = events.select("event_id", F.col("ts").alias("timestamp"), "user_id", "event_type", "value")
    day = F.replace(F.substring(F.col("timestamp").cast("string"), 1, 10), F.lit("-"), F.lit(""))
    kind, number, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    is_error = kind == "error"
    error_kind = number % 4
    text = {
        "usr": F.when(user % 25 == 0, "").otherwise(F.concat(F.lit("user"), user)),
        "tableName": F.when(number % 3 == 0, F.concat(F.lit("T"), number % 20)).otherwise(""),
        "sql": F.when(
            kind == "click",
            F.concat(F.lit("SELECT * FROM T"), number % 20, F.lit("\nWHERE a = 'x, y'")),
        ).otherwise(""),
        "sdbl": F.when(kind == "view", F.concat(F.lit("SELECT Ref FROM Doc"), number % 10)).otherwise(""),
        "context": F.when(
            number % 4 == 0, F.concat(F.lit("Form.Call : Module.Run\nLine : "), number % 100)
        )
        .when(
            is_error,
            F.when(error_kind == 1, "HRESULT=80004005, native=1205")
            .when(error_kind == 2, "Error: 2627")
            .otherwise("SQLState=40001"),
        )
        .otherwise(""),
        "exception": F.when(is_error, "DataBaseException").otherwise(""),
        "locks": F.when(
            kind == "purchase", F.concat(F.lit("Info"), number % 8, F.lit(" Exclusive"))
        ).otherwise(""),
    }
    mapped = e.withColumns(
        {
            **{name: F.lit("") for name in PROPERTY_COLUMNS.values()},
            **text,
            "directory_name": F.concat(F.lit("ib"), user % 5),
            "source_file": hour_file(F.col("timestamp")),
            "loaded_at": ntz(LOADED_AT),
            "event_name": F.when(kind == "click", "DBMSSQL")
            .when(kind == "view", "SDBL")
            .when(kind == "purchase", "TLOCK")
            .when(is_error, "EXCP")
            .otherwise("CALL"),
            "level": (number % 6).cast("int"),
            "duration_us": F.round(F.col("value") * 20000).cast("bigint"),
            "mssql_error_code": F.when(
                is_error,
                F.when(error_kind == 1, 1205).when(error_kind == 2, 2627).when(error_kind == 3, 40001),
            ).cast("bigint"),
            "rows_num": F.lit(None).cast("bigint"),
            "rows_affected_num": F.lit(None).cast("bigint"),
            "session_id": F.coalesce(F.concat(F.lit("s_"), day), F.lit("")),
            "event_date": F.to_date("timestamp"),
        }
    ).withColumn("duration_ms", F.col("duration_us") / F.lit(1000.0))
    numbered = number_within(
        classified(mapped),
        ["directory_name", "source_file"],
        start_of(F.col("timestamp"), "second"),
        ["timestamp", "event_id"],
        "line_number",
    )
    return numbered.select(*EVENT_COLUMNS)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stored_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as a stored event table, written once per application.

    Loading once and asking many questions is how the table is meant to be
    used; the queries then get partition pruning and pushed-down filters. The
    frame is kept with its file index, as the folder does not change any more.
    """
    return _stored_journal(spark, sf_dir)[1]


def stored_journal_path(spark: SparkSession, sf_dir: str) -> str:
    return _stored_journal(spark, sf_dir)[0]


def _stored_journal(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        store = EventStore(spark, scratch_path(spark, "journal"))
        store.write(journal_from_events(read_events(spark, sf_dir)))
        _stored[key] = (store.path, store.events())
    return _stored[key]
