"""Value lists for filter menus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.codes import describe_error
from tidelog.operators.filters import has_db_error, is_filled

ERROR_FACET_SIZE = 50


def distinct_values(events: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """The sorted distinct values of a column, without the empty one."""
    rows = events if keep_empty else events.where(is_filled(column))
    return rows.select(column).distinct().orderBy(column)


def count_by(events: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    counted = events.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))
    ordered = counted.orderBy(F.col("cnt").desc(), F.col(column))
    return ordered if top is None else ordered.limit(top)


def error_facet(events: DataFrame) -> DataFrame:
    """Database error codes with count, description and label."""
    code, count = F.col("mssql_error_code"), F.col("cnt")
    return count_by(events.where(has_db_error()), "mssql_error_code", ERROR_FACET_SIZE).select(
        code.alias("code"),
        count.alias("count"),
        describe_error(code, "Unknown error").alias("description"),
        F.concat(
            code.cast("string"), F.lit(" — "), describe_error(code, "Unknown"), F.lit(" ("), count.cast("string"), F.lit(")")
        ).alias("label"),
    )
