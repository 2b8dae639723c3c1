"""The analysis view: one filtered event set, seen in several ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.codes import describe_error
from tidelog.functions.numbers import round_ratio
from tidelog.functions.text import with_previews
from tidelog.operators.fetch import address, at_addresses, has_addresses
from tidelog.operators.filters import EventFilter, has_db_error, is_filled, is_slow
from tidelog.operators.paging import event_order
from tidelog.operators.quantiles import exact_quantiles
from tidelog.plans.facets import count_by, distinct_values
from tidelog.plans.report import P95
from tidelog.plans.search import shown
from tidelog.schema import EVENT_KEY

# Fixed values of the view.
TOP_TYPES = 20
TOP_ROWS = 20
TIMELINE_BUCKETS = 300
TEXT_PREVIEW = 500
# Statements fetched by address at most, for the ties at the end of a list.
FETCHED = 1000
ERROR_ROW = (
    "timestamp",
    "event_name",
    "duration_ms",
    "mssql_error_code",
    "directory_name",
    "source_file",
    "usr",
    "context",
    "sql",
    "exception",
    "severity",
)
SLOW_ROW = tuple(name for name in ERROR_ROW if name != "mssql_error_code")
CUT = ("context", "sql", "exception")


def base_counts(events: DataFrame) -> DataFrame:
    """Rows, time bounds per (type, severity, directory): a few thousand rows.

    Summary, types, severities and directories are all sums over it, so one
    scan of four narrow columns serves the four of them.
    """
    return events.groupBy("event_name", "severity", "directory_name").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
    )


def summary(events: DataFrame, approx: bool = False) -> DataFrame:
    if approx:
        return events.agg(
            F.count(F.lit(1)).alias("total"),
            F.min("timestamp").alias("min_ts"),
            F.max("timestamp").alias("max_ts"),
            F.approx_count_distinct("directory_name").alias("dir_count"),
        )
    # Grouping first leaves one row per directory for the distinct count.
    per_directory = events.groupBy("directory_name").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")
    )
    return per_directory.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"),
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
        F.count("directory_name").alias("dir_count"),
    )


def filter_ratio(events: DataFrame, sessions: DataFrame, where: EventFilter) -> DataFrame:
    """Per session: kept rows, time range, and the share the filter removed.

    A session without any kept row stays in the result with its own interval.
    """
    kept = (
        events.where(where.predicate())
        .groupBy("session_id", "directory_name")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))
        .groupBy("session_id")
        .agg(
            F.sum("cnt").alias("cnt"),
            F.min("min_ts").alias("min_ts"),
            F.max("max_ts").alias("max_ts"),
            F.count("directory_name").alias("dir_count"),
        )
    )
    zero = F.lit(0).cast("bigint")
    total, count = F.coalesce("total_events", zero), F.coalesce("cnt", zero)
    removed = F.greatest(total - count, zero)
    return sessions.join(kept, "session_id", "left").select(
        "session_id",
        count.alias("total_events"),
        removed.alias("total_filtered"),
        F.coalesce(round_ratio(removed * 100, total, 1), F.lit(0.0)).alias("filter_percent"),
        F.coalesce("min_ts", "start_date").alias("range_start"),
        F.coalesce("max_ts", "end_date").alias("range_end"),
        F.coalesce("dir_count", zero).alias("dir_count"),
    )


def latest_errors(events: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    rows = with_previews(events.where(has_db_error()), CUT, TEXT_PREVIEW)
    latest = rows.orderBy(*event_order("timestamp", "desc")).limit(n)
    return latest.select(*[shown(name) for name in ERROR_ROW])


def slowest(events: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    order = [F.col("duration_ms").desc(), *[F.col(name).asc() for name in EVENT_KEY]]
    rows = with_previews(events.where(is_slow()), CUT, TEXT_PREVIEW).orderBy(*order).limit(n)
    return rows.select(*[shown(name) for name in SLOW_ROW])


def timeline(events: DataFrame, width: str = "1 second", buckets: int = TIMELINE_BUCKETS) -> DataFrame:
    """Events and mean duration per time bucket, earliest buckets first."""
    per_bucket = events.groupBy(F.window("timestamp", width).alias("w")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("duration_us").alias("sum_us")
    )
    return (
        per_bucket.select(
            F.col("w.start").alias("bucket"),
            "cnt",
            round_ratio(F.col("sum_us"), F.col("cnt") * 1000, 2).alias("avg_duration_ms"),
        )
        .orderBy("bucket")
        .limit(buckets)
    )


def analysis(events: DataFrame, where: EventFilter) -> dict[str, DataFrame]:
    """All parts of the view as lazy frames over one filtered set.

    The small ``base`` counts are kept for the four parts that sum them up;
    unpersist ``base`` when the view is done.
    """
    kept = events.where(where.predicate())
    base = base_counts(kept).persist()
    totals = base.groupBy("directory_name").agg(
        F.sum("cnt").alias("cnt"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts")
    )

    def by(column: str) -> DataFrame:
        return base.groupBy(column).agg(F.sum("cnt").alias("cnt")).orderBy(F.col("cnt").desc(), column)

    return {
        "base": base,
        "summary": totals.agg(
            F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"),
            F.min("min_ts").alias("min_ts"),
            F.max("max_ts").alias("max_ts"),
            F.count("directory_name").alias("dir_count"),
        ),
        "event_types": by("event_name").limit(TOP_TYPES),
        "severity_distribution": by("severity"),
        "directories": base.select("directory_name").distinct().orderBy("directory_name"),
        "mssql_errors": latest_errors(kept),
        "top_slow": slowest(kept),
        "timeline": timeline(kept),
    }


def event_types(events: DataFrame) -> DataFrame:
    return count_by(events, "event_name", TOP_TYPES)


def severity_distribution(events: DataFrame) -> DataFrame:
    return count_by(events, "severity")


def directories(events: DataFrame) -> DataFrame:
    return distinct_values(events, "directory_name", keep_empty=True)


# Metrics that are declared for the analysis result.


def duration_totals(events: DataFrame) -> DataFrame:
    """Events, summed, mean and longest duration, and the covered minutes."""
    span = F.timestamp_diff("MICROSECOND", F.min("timestamp"), F.max("timestamp"))
    whole = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.sum("duration_us").alias("sum_us"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.min("timestamp").alias("period_start"),
        F.max("timestamp").alias("period_end"),
        span.alias("span_us"),
    )
    return whole.select(
        "total_events",
        (F.col("sum_us") / F.lit(1000.0)).alias("total_duration_ms"),
        round_ratio(F.col("sum_us"), F.col("total_events") * 1000, 6).alias("average_duration_ms"),
        "max_duration_ms",
        "period_start",
        "period_end",
        round_ratio(F.col("span_us"), F.lit(60_000_000), 6).alias("duration_minutes"),
    )


def slow_queries(events: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """Statements by longest run: runs, longest, mean and total time.

    Statements are grouped by a digest, so their texts (up to 100 000
    characters) are neither shuffled nor kept in hash tables; only those with a
    longest run among the ``n`` longest are then fetched, ties included: from
    the address of one row of each where the events are stored.
    """
    stored = _slow_stored(events, n) if has_addresses(events) else None
    if stored is not None:
        return stored
    rows = events.where(is_filled("sql")).withColumn("digest", F.unhex(F.md5("sql")))
    groups = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.sum("duration_us").alias("sum_us"),
    )
    # At most n values.
    longest = groups.orderBy(F.col("max_duration_ms").desc()).limit(n).select("max_duration_ms").distinct()
    listed = groups.join(F.broadcast(longest), "max_duration_ms", "left_semi")
    texts = (
        rows.join(F.broadcast(longest), F.col("duration_ms") == longest["max_duration_ms"], "left_semi")
        .select("digest", "sql")
        .dropDuplicates(["digest"])
    )
    return _slow_list(listed.join(texts, "digest"), n)


def _slow_stored(events: DataFrame, n: int) -> DataFrame | None:
    """The list from one narrow aggregate and the files of its rows; None if too many statements tie at its end."""
    rows = events.where(is_filled("sql")).select(F.unhex(F.md5("sql")).alias("digest"), "duration_ms", "duration_us", address().alias("at"))
    groups = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.sum("duration_us").alias("sum_us"),
        F.min("at").alias("at"),
    )
    # Ties of the longest run are ordered by text, so all of them are fetched.
    found = groups.orderBy(F.col("max_duration_ms").desc(), "digest").limit(FETCHED + 1).collect()
    tied = [r for r in found if r["max_duration_ms"] >= found[min(n, len(found)) - 1]["max_duration_ms"]]
    if len(tied) > FETCHED:
        return None
    listed = events.sparkSession.createDataFrame(tied, groups.schema)
    texts = at_addresses(events, [r["at"] for r in tied]).select(F.unhex(F.md5("sql")).alias("digest"), "sql")
    return _slow_list(listed.join(texts.dropDuplicates(["digest"]), "digest"), n)


def _slow_list(found: DataFrame, n: int) -> DataFrame:
    return (
        found.select(
            "sql",
            "cnt",
            "max_duration_ms",
            round_ratio(F.col("sum_us"), F.col("cnt") * 1000, 6).alias("avg_duration_ms"),
            (F.col("sum_us") / F.lit(1000.0)).alias("total_duration_ms"),
        )
        .orderBy(F.col("max_duration_ms").desc(), "sql")
        .limit(n)
    )


def top_errors(events: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """Error codes by count, each with the text of its earliest event.

    Codes are counted first; the earliest event of each listed code is a top-1
    over its key, and only the texts of those rows are read.
    """
    errors = events.where(has_db_error()).withColumn("code", F.col("mssql_error_code"))
    counts = errors.groupBy("code").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "code").limit(n)
    # At most n rows, here and below.
    listed = F.broadcast(counts)
    first = Window.partitionBy("code").orderBy(*EVENT_KEY)
    earliest = (
        errors.select("code", *EVENT_KEY)
        .join(listed, "code")
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") == 1)
        .drop("place")
    )
    texts = errors.select("code", *EVENT_KEY, "exception", "context").join(F.broadcast(earliest), ["code", *EVENT_KEY])
    return (
        texts.select(
            "code",
            describe_error(F.col("code"), "Unknown error").alias("error_type"),
            "cnt",
            F.col("exception").alias("sample"),
            F.col("context").alias("sample_context"),
        )
        .orderBy(F.col("cnt").desc(), "code")
        .limit(n)
    )


def problem_values(events: DataFrame, column: str, n: int = TOP_ROWS) -> DataFrame:
    """Tables or users by total time: events, errors, total and p95 duration."""
    rows = events.where(is_filled(column)).select(column, "duration_us", "mssql_error_code", "duration_ms")
    totals = (
        rows.groupBy(column)
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.count_if(has_db_error()).alias("errors"),
            F.count_if(is_slow()).alias("slow"),
            F.sum("duration_us").alias("total_us"),
        )
        .orderBy(F.col("total_us").desc(), column)
        .limit(n)
    )
    # Only the listed values are ranked; at most n of them, so the side is tiny.
    listed = F.broadcast(totals.select(column))
    p95 = exact_quantiles(rows.join(listed, column, "left_semi"), "duration_us", {"p95_us": P95}, [column])
    return (
        totals.join(p95, column)
        .select(
            column,
            "cnt",
            "errors",
            "slow",
            (F.col("total_us") / F.lit(1000.0)).alias("total_duration_ms"),
            F.round(F.col("p95_us") / F.lit(1000.0), 6).alias("p95_duration_ms"),
        )
        .orderBy(F.col("total_duration_ms").desc(), column)
    )
