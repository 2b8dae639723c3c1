"""The second record layout: a full time stamp, then ``field;value`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codes import category, severity
from tidelog.functions.numbers import whole_number
from tidelog.functions.text import listed_values, trim_all
from tidelog.functions.times import ntz
from tidelog.operators.assemble import assemble
from tidelog.schema import LONG_TEXT_COLUMNS, MAX_ERROR_CODE, MAX_LEVEL, PROPERTY_COLUMNS, TEXT_LIMIT
from tidelog.session import scratch_path

# Fixed value: a record starts with a line that begins with this time.
STAMP = r"^\s*(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)"

# Field in the file -> output column, in output order.
TEXT_FIELDS = {
    "directory_name": "directory_name",
    "source_file": "source_file",
    "event_name": "event_name",
    "p_processName": "process_name",
    "t_computerName": "computer_name",
    "t_connectID": "connect_id",
    "usr": "user_name",
    "dbpid": "db_pid",
    "osThread": "os_thread",
    "sessionID": "session_id_1c",
    "trans": "transaction",
    "func": "function",
    "tableName": "table_name",
    "context": "context",
    "sql": "sql_query",
    "sdbl": "sdbl",
    "planSQLText": "plan_sql_text",
    "exception": "exception",
    "sql_error_code": "sql_error_code",
    "locks": "locks",
    "waitConnections": "wait_connections",
    "deadlockConnectionIntersections": "deadlock_intersections",
    "description": "description",
    "data": "data",
}
WHOLE_FIELDS = {
    "line_number": "line_number",
    "level": "level",
    "rows": "rows",
    "rowsAffected": "rows_affected",
}
REAL_FIELDS = {"duration_ms": "duration_ms"}


def field_lists(record: Column) -> Column:
    """An array of one struct: ``keys`` and ``values`` of the field lines, last line first.

    A function's argument is computed anew wherever its body names it, so the
    lines, and each value ahead of its quotes, are bound to a variable first.
    """
    rest = F.regexp_replace(record, STAMP, "")
    lines = F.reverse(F.filter(F.split(rest, "\n"), lambda line: line.contains(";")))

    def lists(lines: Column) -> Column:
        names = F.transform(lines, lambda line: F.trim(trim_all(F.substring_index(line, ";", 1)), F.lit('"')))
        values = F.transform(lines, lambda line: trim_all(F.substr(line, F.instr(line, ";") + 1)))
        return F.struct(names.alias("keys"), F.transform(values, unwrapped).alias("values"))

    return F.transform(F.array(lines), lists)


def unwrapped(value: Column) -> Column:
    """Without one pair of enclosing double quotes."""
    both = value.startswith('"') & value.endswith('"')
    return F.when(both, F.substr(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))).otherwise(value)


# Where the text fields go in an event row; what is not named here goes by its own name.
EVENT_TEXTS = [name for name in TEXT_FIELDS if name not in ("directory_name", "source_file", "event_name", "sql_error_code")]


def _stamped(records: DataFrame, text: Column, start, end) -> DataFrame:
    """``records`` with the time of each, cut to whole seconds; those of another time are left out."""
    stamp = F.regexp_replace(F.regexp_extract(text, STAMP, 1), r"\s+", " ")
    df = records.withColumn("timestamp", F.substring_index(stamp, ".", 1).try_cast("timestamp_ntz"))
    if start is not None:
        df = df.where(F.col("timestamp").isNull() | (F.col("timestamp") >= ntz(start)))
    if end is not None:
        df = df.where(F.col("timestamp").isNull() | (F.col("timestamp") <= ntz(end)))
    return df


def field_records(records: DataFrame, start=None, end=None) -> DataFrame:
    """Records of this layout parsed into the rows that ``parse_records`` gives for the other one.

    ``reason`` names what makes a record a reject: its time, a number that
    cannot be read or is out of range, or its length. Directory, file and
    ordinal are those the record names; a reject, and a record that names none,
    has those of the file it is in. An error code that is no number is none.
    """
    text = F.replace(F.col("record"), F.lit("\uFFFD"), F.lit(""))
    df = _stamped(records, text, start, end)
    wanted = [*TEXT_FIELDS, *WHOLE_FIELDS, *REAL_FIELDS]
    df = df.withColumn("found", listed_values(field_lists(text), wanted))

    def field(name: str) -> Column:
        return F.coalesce(F.get("found", F.lit(wanted.index(name))), F.lit(""))

    def number(name: str, kind: str) -> Column:
        value = field(name)
        cast = whole_number(trim_all(value)) if kind == "bigint" else trim_all(value).try_cast(kind)
        return F.when(value == "", F.lit(0).cast(kind)).otherwise(cast)

    numbers = {out: number(name, kind) for fields, kind in ((WHOLE_FIELDS, "bigint"), (REAL_FIELDS, "double")) for name, out in fields.items()}
    df = df.withColumns({f"_{out}": column for out, column in numbers.items()})
    code = whole_number(trim_all(field("sql_error_code")))
    reason = F.when(F.col("oversized"), "oversized_record").when(F.col("timestamp").isNull(), "bad_time")
    for out in numbers:
        reason = reason.when(F.col(f"_{out}").isNull(), f"bad_{'duration' if out == 'duration_ms' else out}")
    reason = reason.when(F.col("_level") > MAX_LEVEL, "level_out_of_range").when(code > MAX_ERROR_CODE, "error_code_out_of_range")
    df = df.withColumn("reason", reason)
    good = F.col("reason").isNull()
    texts = {out: F.lit("") for out in PROPERTY_COLUMNS.values()}
    texts |= {name: field(name) for name in EVENT_TEXTS} | {name: trim_all(field(name)) for name in ("rows", "rowsAffected")}
    texts |= {name: F.substring(texts[name], 1, TEXT_LIMIT) for name in LONG_TEXT_COLUMNS}
    named = lambda name: F.when(good & (field(name) != ""), field(name)).otherwise(F.col(name)).alias(name)
    return df.select(
        "file_id", "file_path", named("directory_name"), named("source_file"),
        F.when(good & (field("line_number") != ""), F.col("_line_number")).otherwise(F.col("event_seq")).alias("line_number"),
        "n_lines", "record_piece", "timestamp", F.round(F.col("_duration_ms") * 1000).cast("bigint").alias("duration_us"),
        field("event_name").alias("event_name"), F.col("_level").alias("level"), *[column.alias(name) for name, column in texts.items()],
        F.when(code != 0, code).alias("mssql_error_code"), "reason", F.when(~good, F.col("record")).alias("record"),
    )


def parse_alternative(spark: SparkSession, lines: DataFrame, start=None, end=None) -> DataFrame:
    """Typed rows of the layout, with ``ok`` false for a record to reject.

    Times are cut to whole seconds. One number that cannot be read rejects the
    whole record. Broken UTF-8 bytes are left out.
    """
    records = assemble(spark, lines, header=STAMP, encoding="utf-8").records
    text = F.replace(F.col("record"), F.lit("\uFFFD"), F.lit(""))
    df = _stamped(records, text, start, end)
    wanted = [*TEXT_FIELDS, *WHOLE_FIELDS, *REAL_FIELDS]
    df = df.withColumn("found", listed_values(field_lists(text), wanted))

    def field(name: str) -> Column:
        return F.coalesce(F.get("found", F.lit(wanted.index(name))), F.lit(""))

    def number(name: str, kind: str) -> Column:
        value = field(name)
        cast = whole_number(trim_all(value)) if kind == "bigint" else trim_all(value).try_cast(kind)
        return F.when(value == "", F.lit(0).cast(kind)).otherwise(cast)

    typed = df.select(
        "file_path",
        "event_seq",
        "timestamp",
        *[field(name).alias(out) for name, out in TEXT_FIELDS.items()],
        *[number(name, "bigint").alias(out) for name, out in WHOLE_FIELDS.items()],
        *[number(name, "double").alias(out) for name, out in REAL_FIELDS.items()],
    )
    needed = ["timestamp", *WHOLE_FIELDS.values(), *REAL_FIELDS.values()]
    complete = F.lit(True)
    for name in needed:
        complete = complete & F.col(name).isNotNull()
    has_error = (F.col("exception") != "") | (F.col("sql_error_code") != "")
    rows = typed.withColumns(
        {
            "severity": severity(F.col("level"), has_error, F.col("duration_ms")),
            "category": category(F.col("event_name"), F.col("locks"), has_error, F.col("duration_ms")),
            "ok": complete,
        }
    )
    # Written once: a filter on ``ok`` then reads a column and parses nothing again.
    path = scratch_path(spark, "alternative")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
