"""Records to typed events: header fields, properties, codes, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.codes import classified, error_code
from tidelog.functions.numbers import whole_number
from tidelog.functions.text import property_arrays, property_values, trim_all
from tidelog.functions.times import ntz
from tidelog.schema import (
    EVENT_COLUMNS,
    LONG_TEXT_COLUMNS,
    MAX_ERROR_CODE,
    MAX_LEVEL,
    PROPERTY_COLUMNS,
    PROPERTY_FALLBACKS,
    TEXT_LIMIT,
)
from tidelog.sources.files import Layout, base_hour

REJECT_COLUMNS = ["file_path", "directory_name", "source_file", "line_number", "record_piece", "reason", "record"]


def file_facts(layout: Layout) -> dict[str, Column]:
    """What a file's path says about all its records."""
    path = F.col("file_path")
    source_file = layout.source_file(path)
    return {
        "directory_name": layout.directory_name(path),
        "source_file": source_file,
        "hour": base_hour(source_file),
    }


def header_fields(records: DataFrame) -> DataFrame:
    """Split the header off: event time, duration, name, level, property text."""
    # The header has exactly three commas before the properties.
    stamped = records.withColumn("parts", F.split(F.col("record"), ",", 4)).withColumn(
        "clock", F.ltrim(F.get("parts", F.lit(0)), F.lit("\uFEFF"))
    )
    # mm:ss.fraction-duration; the fraction is padded or cut to microseconds.
    fraction = F.rpad(F.substring(F.substring_index("clock", "-", 1), 7, 6), 6, "0")
    text = F.concat("hour", F.lit(":"), F.substring("clock", 1, 5), F.lit("."), fraction)
    return stamped.select(
        "file_id",
        "file_path",
        "directory_name",
        "source_file",
        F.col("event_seq").alias("line_number"),
        "n_lines",
        "oversized",
        "record_piece",
        "hour",
        text.try_cast("timestamp_ntz").alias("timestamp"),
        F.substring_index("clock", "-", -1).try_cast("bigint").alias("duration_us"),
        F.ltrim(F.get("parts", F.lit(1)), F.lit(" \t\r\n\f\u000b")).alias("event_name"),
        trim_all(F.get("parts", F.lit(2))).try_cast("bigint").alias("level"),
        F.get("parts", F.lit(3)).alias("props"),
        "record",
    )


def properties(df: DataFrame) -> DataFrame:
    """One column per known property, ``''`` when absent.

    The values are looked up in one array expression and then taken apart:
    a lookup expression per column would make the generated method too long
    for the JVM to compile.
    """
    keys, values = property_arrays(F.col("props"))
    wanted = [*PROPERTY_COLUMNS, *PROPERTY_FALLBACKS.values()]
    listed = df.withColumn("found", property_values(keys, values, wanted))

    def value(key: str) -> Column:
        found = F.get("found", F.lit(wanted.index(key)))
        if key in PROPERTY_FALLBACKS:
            found = F.coalesce(found, F.get("found", F.lit(wanted.index(PROPERTY_FALLBACKS[key]))))
        return F.coalesce(found, F.lit(""))

    columns = {name: value(key) for key, name in PROPERTY_COLUMNS.items()}
    return listed.withColumns(columns).drop("found")


def reject_reason() -> Column:
    """Why a record cannot become an event; NULL for a good one."""
    return (
        F.when(F.col("oversized"), "oversized_record")
        .when(F.col("hour").isNull(), "bad_file_name")
        .when(F.col("timestamp").isNull(), "bad_time")
        .when(F.col("duration_us").isNull(), "bad_duration")
        .when(F.col("level").isNull() | (F.col("level") > MAX_LEVEL), "level_out_of_range")
        .when(F.col("mssql_error_code") > MAX_ERROR_CODE, "error_code_out_of_range")
    )


def parse_records(
    records: DataFrame,
    start=None,
    end=None,
    include_exception: bool = False,
) -> DataFrame:
    """Parsed records with a ``reason`` column (NULL = event, else reject).

    Events outside ``[start, end]`` are left out; ordinals and line counts were
    fixed before, so the filter does not change them.
    """
    df = header_fields(records)
    if start is not None:
        df = df.where(F.col("oversized") | F.col("timestamp").isNull() | (F.col("timestamp") >= ntz(start)))
    if end is not None:
        df = df.where(F.col("oversized") | F.col("timestamp").isNull() | (F.col("timestamp") <= ntz(end)))
    df = properties(df)
    # The code is searched in the whole texts, before they are cut for storage.
    searched = ["sdbl", "context", "sql"] + (["exception"] if include_exception else [])
    df = df.withColumn("mssql_error_code", error_code(*[F.col(c) for c in searched]))
    df = df.withColumns({c: F.substring(c, 1, TEXT_LIMIT) for c in LONG_TEXT_COLUMNS})
    df = df.withColumn("reason", reject_reason())
    # Only rejects keep their text.
    df = df.withColumn("record", F.when(F.col("reason").isNotNull(), F.col("record")))
    return df.drop("props", "hour", "oversized")


def events_of(parsed: DataFrame, session_id: Column | str, loaded_at, rules: str = "rules") -> DataFrame:
    """The event rows in the order of the event schema."""
    session = F.lit(session_id) if isinstance(session_id, str) else session_id
    good = parsed.where(F.col("reason").isNull()).withColumns(
        {
            "level": F.col("level").cast("int"),
            "duration_ms": F.col("duration_us") / F.lit(1000.0),
            "loaded_at": ntz(loaded_at),
            "rows_num": whole_number(F.col("rows")),
            "rows_affected_num": whole_number(F.col("rowsAffected")),
            "session_id": session,
            "event_date": F.to_date("timestamp"),
        }
    )
    return classified(good, rules).select(*EVENT_COLUMNS)


def rejects_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(*REJECT_COLUMNS)
