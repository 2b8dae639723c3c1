"""The session report, for one session or for all of them at once."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.numbers import round_ratio
from tidelog.functions.times import micros_between
from tidelog.operators.filters import has_db_error, is_filled, sane_duration
from tidelog.operators.quantiles import exact_quantiles
from tidelog.plans.facets import count_by

# Fixed values of the report.
TOP_TYPES = 20
TOP_CODES = 20
TOP_USERS = 10
MEDIAN = Fraction(1, 2)
P95 = Fraction(19, 20)


def report_summary(events: DataFrame, by_session: bool = False, approx: bool = False) -> DataFrame:
    """Events, users, directories, database errors, time range and rates.

    Rows are first folded per (user, directory), so that the distinct counts
    run over that small set and no group is tied to one task.
    """
    group = ["session_id"] if by_session else []
    if approx:
        whole = events.groupBy(*group).agg(
            F.count(F.lit(1)).alias("total_events"),
            F.approx_count_distinct("usr").alias("unique_users"),
            F.approx_count_distinct("directory_name").alias("unique_directories"),
            F.count_if(has_db_error()).alias("mssql_errors_count"),
            F.min("timestamp").alias("range_start"),
            F.max("timestamp").alias("range_end"),
        )
    else:
        folded = events.groupBy(*group, "usr", "directory_name").agg(
            F.count(F.lit(1)).alias("cnt"),
            F.count_if(has_db_error()).alias("errors"),
            F.min("timestamp").alias("min_ts"),
            F.max("timestamp").alias("max_ts"),
        )
        whole = folded.groupBy(*group).agg(
            F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_events"),
            F.count_distinct("usr").alias("unique_users"),
            F.count_distinct("directory_name").alias("unique_directories"),
            F.coalesce(F.sum("errors"), F.lit(0)).alias("mssql_errors_count"),
            F.min("min_ts").alias("range_start"),
            F.max("max_ts").alias("range_end"),
        )
    span = micros_between(F.col("range_start"), F.col("range_end"))
    total = F.col("total_events")
    return whole.select(
        "*",
        (span / F.lit(1e6)).alias("duration_seconds"),
        round_ratio(total * 1_000_000, span, 2).alias("events_per_second"),
        round_ratio(total * 60_000_000, span, 1).alias("events_per_minute"),
    )


def duration_stats(events: DataFrame, by_session: bool = False, approx: bool = False) -> DataFrame:
    """Least, mean, longest, median and p95 duration of sane durations, in ms."""
    group = ["session_id"] if by_session else []
    rows = events.where(sane_duration()).select(*group, "duration_us")
    simple = [
        F.min("duration_us").alias("min_us"),
        F.sum("duration_us").alias("sum_us"),
        F.max("duration_us").alias("max_us"),
        F.count(F.lit(1)).alias("n"),
    ]
    if approx:
        ranks = F.percentile_approx("duration_us", [0.5, 0.95], 10_000)
        stats = rows.groupBy(*group).agg(*simple, ranks.alias("q")).withColumns(
            {"median_us": F.col("q")[0].cast("double"), "p95_us": F.col("q")[1].cast("double")}
        )
    else:
        wanted = {"median_us": MEDIAN, "p95_us": P95}
        quantiles = exact_quantiles(rows, "duration_us", wanted, group)
        totals = rows.groupBy(*group).agg(*simple)
        if group:
            stats = totals.join(quantiles, group)
        else:  # one row each; without any duration there are no quantiles
            one = F.lit(1)
            stats = totals.withColumn("_one", one).join(quantiles.withColumn("_one", one), "_one", "left")
    ms = F.lit(1000.0)
    return stats.select(
        *group,
        (F.col("min_us") / ms).alias("min"),
        round_ratio(F.col("sum_us"), F.col("n") * 1000, 6).alias("avg"),
        (F.col("max_us") / ms).alias("max"),
        F.round(F.col("median_us") / ms, 6).alias("median"),
        F.round(F.col("p95_us") / ms, 6).alias("p95"),
    )


def report_types(events: DataFrame) -> DataFrame:
    return count_by(events.where(is_filled("event_name")), "event_name", TOP_TYPES)


def error_codes(events: DataFrame) -> DataFrame:
    return count_by(events.where(has_db_error()), "mssql_error_code", TOP_CODES)


def top_users(events: DataFrame) -> DataFrame:
    return count_by(events.where(is_filled("usr")), "usr", TOP_USERS)


def session_tops(events: DataFrame) -> DataFrame:
    """Top types, users and error codes of every session, ranked, in one pass.

    The three counts are taken together: each row is spread to its three
    (kind, value) pairs, counted with partial aggregation, and ranked.
    """
    pairs = F.array(
        F.struct(F.lit("event_type").alias("kind"), F.col("event_name").alias("value")),
        F.struct(F.lit("user").alias("kind"), F.col("usr").alias("value")),
        F.struct(
            F.lit("error_code").alias("kind"),
            F.when(has_db_error(), F.col("mssql_error_code").cast("string")).otherwise("").alias("value"),
        ),
    )
    folded = events.groupBy("session_id", "event_name", "usr", "mssql_error_code").agg(
        F.count(F.lit(1)).alias("n")
    )
    counted = (
        folded.select("session_id", "n", F.explode(pairs).alias("p"))
        .where(F.col("p.value") != "")
        .groupBy("session_id", "p.kind", "p.value")
        .agg(F.sum("n").alias("cnt"))
    )
    # Codes rank by number on ties, as in the single-session list.
    order = Window.partitionBy("session_id", "kind").orderBy(
        F.col("cnt").desc(),
        F.when(F.col("kind") == "error_code", F.col("value").try_cast("bigint")),
        F.col("value"),
    )
    limit = (
        F.when(F.col("kind") == "event_type", TOP_TYPES).when(F.col("kind") == "user", TOP_USERS).otherwise(TOP_CODES)
    )
    return (
        counted.withColumn("place", F.row_number().over(order).cast("bigint"))
        .where(F.col("place") <= max(TOP_TYPES, TOP_USERS, TOP_CODES))
        .where(F.col("place") <= limit)
    )


def report(events: DataFrame) -> dict[str, DataFrame]:
    """All parts of one session's report as lazy frames."""
    return {
        "summary": report_summary(events),
        "event_types": report_types(events),
        "duration_stats": duration_stats(events),
        "mssql_error_codes": error_codes(events),
        "top_users": top_users(events),
    }
