"""The registered queries: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from datetime import date, datetime

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import single_byte_bytes
from tidelog.operators.alternative import TEXT_FIELDS, parse_alternative
from tidelog.operators.filters import ANALYSIS_SEARCH, EventFilter
from tidelog.operators.paging import after_row, event_order, take_slice
from tidelog.plans import analysis, facets, report, search, sessions
from tidelog.plans.ingest import Load, ingest, load_stats, parse_files, session_totals
from tidelog.schema import EVENT_COLUMNS, EXPORT_HEADERS
from tidelog.session import qualified, scratch_path
from tidelog.sources.export import export_rows, write_csv
from tidelog.sources.files import Layout, list_files, read_lines
from tidelog.sources.journal_view import LOADED_AT, stored_journal
from tidelog.sources.ranges import open_file, stored_files
from tidelog.sources.render import alternative_text, clock_text, record_text, write_files
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore, footprint, retained
from tidelog.streaming.follow import follow
from tidelog.streaming.resume import Ledger, resume

AS_OF = "2024-02-01 00:00:00"
PAGE_FILTER = EventFilter(
    duration_min=100,
    duration_max=9000,
    time_from="2024-01-03 00:00:00.000",
    time_to="2024-01-28 12:30:00.500",
    search="SELECT",
)
NARROW_FILTER = EventFilter(severity="critical", category="error", directory_name="ib1", mssql_error=1205)
ANALYSIS_FILTER = EventFilter(
    severity="critical", min_duration_ms=10, search="DataBase", search_columns=ANALYSIS_SEARCH
)
RATIO_FILTER = EventFilter(event_name="DBMSSQL", min_duration_ms=50)
LOAD_START, LOAD_END = datetime(2024, 1, 10, 6, 30), datetime(2024, 1, 20, 18, 45)


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_journal(spark, sf_dir)


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions_from_events(journal(spark, sf_dir))


def on_journal(build):
    return lambda spark, sf_dir: build(journal(spark, sf_dir))


# --- pages -----------------------------------------------------------------


def page_after(spark, sf_dir):
    """The second page of 50, reached from the last row of the first."""
    rows = journal(spark, sf_dir).where(PAGE_FILTER.predicate())
    first_page = rows.orderBy(*event_order("duration_ms", "desc")).limit(50)
    keys = ["duration_ms", "timestamp", "directory_name", "source_file", "line_number", "session_id"]
    last = first_page.select(*keys).collect()[-1].asDict()
    page = after_row(rows, last, 50, "duration_ms", "desc")
    return page.select("timestamp", "duration_ms", "directory_name", "source_file", "line_number", "usr")


def deep_slice(sort_by, sort_order):
    def run(spark, sf_dir):
        rows = take_slice(journal(spark, sf_dir), 6000, 40, sort_by, sort_order, shallow_rows=100)
        return rows.select("timestamp", "event_name", "level", "duration_ms", "directory_name", "source_file", "line_number")

    return run


# --- sessions --------------------------------------------------------------


def running_sessions(spark, sf_dir):
    """Sessions as they looked half-way: files of the first twelve hours done."""
    counts = sessions.file_counts(journal(spark, sf_dir))
    half_day = F.col("last_ts") < F.concat(
        F.substring(F.col("first_ts").cast("string"), 1, 10), F.lit(" 12:00:00")
    ).cast("timestamp_ntz")
    seen = counts.groupBy("session_id").agg(
        F.count_if(half_day).alias("processed_files"),
        F.sum(F.when(half_day, F.col("events"))).alias("total_events"),
        F.min("first_ts").alias("started_at"),
    )
    whole = session_rows(spark, sf_dir).drop("processed_files", "total_events", "started_at", "status", "completed_at")
    return whole.join(seen, "session_id").withColumns(
        {"status": F.lit("running"), "completed_at": F.lit(None).cast("timestamp_ntz")}
    )


def session_overlap(spark, sf_dir):
    """Each day's load asked for again twelve hours later, against the running ones."""
    rows = running_sessions(spark, sf_dir)
    later = F.expr("make_dt_interval(0, 12, 0, 0)")
    requests = rows.select(
        F.col("session_id").alias("request_id"),
        (F.col("start_date") + later).alias("start_date"),
        (F.col("end_date") + later).alias("end_date"),
    )
    return sessions.running_overlaps(requests, rows)


def session_files(spark, sf_dir):
    rows, counts = session_rows(spark, sf_dir), sessions.file_counts(journal(spark, sf_dir))
    return sessions.session_files(rows, counts)


_stored_sessions: dict[tuple[str, str], str] = {}


def session_store(spark: SparkSession, sf_dir: str) -> SessionStore:
    """The sessions of the journal and their files, stored once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored_sessions:
        store = SessionStore(spark, scratch_path(spark, "sessions"))
        store.put(session_rows(spark, sf_dir))
        store.put_files(sessions.file_counts(journal(spark, sf_dir)))
        _stored_sessions[key] = store.path
    return SessionStore(spark, _stored_sessions[key])


def stored_session_files(spark, sf_dir):
    store = session_store(spark, sf_dir)
    files = store.files().select("session_id", "directory_name", "source_file", "events")
    return sessions.session_files(store.sessions(), files)


def stored_cascade(spark, sf_dir):
    """``cascade`` over the whole journal."""
    return cascade(spark, journal(spark, sf_dir))


def cascade(spark, rows):
    """Files and events of the sessions of ``rows`` that stay when four are deleted."""
    events, store = EventStore(spark, scratch_path(spark, "cascade-events")), SessionStore(spark, scratch_path(spark, "cascade"))
    events.write(rows)
    store.put(sessions.sessions_from_events(rows))
    store.put_files(sessions.file_counts(rows))
    for day in range(1, 5):
        store.delete(f"s_2024010{day}", events)
    cnt = F.count(F.lit(1))
    left = events.events().groupBy("session_id").agg(cnt.alias("events"))
    files = store.files().groupBy("session_id").agg(cnt.alias("files"))
    return store.sessions().select("session_id", "total_files").join(files, "session_id", "full").join(left, "session_id", "full")


def delete_sessions(spark, sf_dir):
    """Events that stay when the sessions of the first week are deleted."""
    rows = session_rows(spark, sf_dir)
    gone = rows.where(F.col("start_date") < F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"))
    kept = sessions.without_session(journal(spark, sf_dir), gone)
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("cnt"))


def source_sizes(spark, sf_dir):
    """Every session with the size of the log files it was read from."""
    day = F.concat(F.lit("s_20"), F.substring(F.element_at(F.split("path", "/"), -1), 1, 6))
    sizes = footprint(spark, rendered(spark, sf_dir, "hours").root, "*.log", day)
    rows = session_rows(spark, sf_dir).select("session_id", "total_events", "start_date", "end_date")
    return sessions.with_footprint(rows, sizes)


# --- export ----------------------------------------------------------------


def export_file(spark, sf_dir):
    """The CSV file read back: quotes, separators and line breaks survive."""
    path = scratch_path(spark, "export")
    write_csv(journal(spark, sf_dir), path)
    back = spark.read.option("sep", ";").option("header", "true").option("multiLine", "true").option("escape", '"')
    read = back.option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return read.toDF(*EXPORT_HEADERS)


# --- ingestion -------------------------------------------------------------

_rendered: dict[tuple[str, str, str], str] = {}


def rendered(spark: SparkSession, sf_dir: str, kind: str) -> Layout:
    """The whole journal as log files, written once per application and kind."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _rendered:
        rows, root = journal(spark, sf_dir), scratch_path(spark, f"logs-{kind}")
        if kind in ("plain", "hours"):
            text = record_text()
        elif kind == "damaged":
            text = record_text(F.when(is_damaged(), broken_clock()).otherwise(clock_text(F.col("timestamp"))))
        elif kind == "encodings":
            rows, text = with_cyrillic(rows), encoded_text()
        elif kind == "alternative":
            text = alternative_text(alternative_fields())
        else:
            level = F.when(is_damaged(), "many").otherwise(F.col("level").cast("string"))
            text = alternative_text(alternative_fields() | {"level": level})
        write_files(rows, text, root, whole_hours=kind == "hours").write.format("noop").mode("overwrite").save()
        _rendered[key] = root
    return Layout(_rendered[key], parts=kind != "hours")


def is_damaged():
    """Errors at level 5 are written with a second that does not exist."""
    return (F.col("exception") != "") & (F.col("level") == 5)


def broken_clock():
    return F.regexp_replace(clock_text(F.col("timestamp")), r":\d{2}\.", ":61.")


def alternative_fields():
    single_line = {"sql", "context"}
    names = {name: name for name in TEXT_FIELDS if name in EVENT_COLUMNS}
    fields = {
        name: F.replace(F.col(name), F.lit("\n"), F.lit(" ")) if name in single_line else F.col(name)
        for name in names
    }
    fields["sql_error_code"] = F.coalesce(F.col("mssql_error_code").cast("string"), F.lit(""))
    return fields | {name: F.col(name) for name in ("line_number", "level", "duration_ms")}


def load(spark: SparkSession, sf_dir: str, kind: str, start=None, end=None) -> Load:
    return parse_files(spark, rendered(spark, sf_dir, kind), "all", LOADED_AT, start, end)


def by_day(events: DataFrame) -> DataFrame:
    """The session of an event of the journal is its day."""
    day = F.replace(F.col("event_date").cast("string"), F.lit("-"), F.lit(""))
    return events.withColumn("session_id", F.concat(F.lit("s_"), day)).select(*EVENT_COLUMNS)


def ingest_roundtrip(spark, sf_dir):
    return by_day(load(spark, sf_dir, "plain").events)


def ingest_interval(spark, sf_dir):
    events = load(spark, sf_dir, "plain", LOAD_START, LOAD_END).events
    return events.select("timestamp", "directory_name", "source_file", "line_number", "event_name", "duration_us")


def ingest_rejects(spark, sf_dir):
    rejects = load(spark, sf_dir, "damaged").rejects
    return rejects.select("directory_name", "source_file", "line_number", "reason", "record")


def ingest_load_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("directory_name", "source_file", "lines", "events", "errors", "status")


def _stats(spark, sf_dir):
    loaded = load(spark, sf_dir, "damaged")
    return load_stats(list_files(spark, rendered(spark, sf_dir, "damaged")), loaded.assembled.splits, loaded.parsed)


def ingest_totals(spark, sf_dir):
    return session_totals(_stats(spark, sf_dir))


def with_cyrillic(rows: DataFrame) -> DataFrame:
    return rows.withColumn("usr", F.when(F.col("usr") != "", F.concat(F.lit("Инженер "), F.col("usr"))).otherwise(""))


def encoded_text():
    """Directories ib1 and ib4 in cp1251, ib2 in cp866, the others in UTF-8."""
    text, name = record_text(), F.col("directory_name")
    return (
        F.when(name.isin("ib1", "ib4"), single_byte_bytes(text, "cp1251"))
        .when(name == "ib2", single_byte_bytes(text, "cp866"))
        .otherwise(text.cast("binary"))
    )


def ingest_encodings(spark, sf_dir):
    """A journal in three encodings, none of which is named to the load."""
    events = load(spark, sf_dir, "encodings").events
    return events.select("timestamp", "directory_name", "source_file", "line_number", "usr")


def hard_to_read(path: str):
    """Opens a file, but for the hour 6 of one directory (no permission) and the hour 7 of another (damaged)."""
    if "/ib1/24011006.log" in path:
        raise PermissionError(13, "Permission denied", path)
    if "/ib2/24011007.log" in path:
        raise OSError(5, "Input/output error", path)
    return open_file(path)


def ingest_failures(spark, sf_dir):
    """Load stats of the whole journal with files that cannot be read among its files."""
    layout = rendered(spark, sf_dir, "plain")
    loaded = parse_files(spark, layout, "all", LOADED_AT, isolate=True, opener=hard_to_read)
    stats = load_stats(list_files(spark, layout), loaded.assembled.splits, loaded.parsed)
    return stats.select("directory_name", "source_file", "lines", "events", "errors", "status")


def grow_files(spark: SparkSession, source: Layout, target: str, part: int, parts: int) -> None:
    """The first ``part / parts`` of the bytes of each file, wherever that cuts them, under ``target``."""

    def copy(batches):
        for batch in batches:
            for row in batch.to_pylist():
                path = row["path"].replace(source_root, target_root)
                system, place = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://"))
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with open_file(row["path"]) as file, system.open_output_stream(place) as out:
                    left = row["file_size"] * part // parts
                    while data := file.read(min(left, 4 << 20)):
                        out.write(data)
                        left -= len(data)
            yield batch.select(["path"])

    source_root, target_root = qualified(spark, source.root), qualified(spark, target)
    files = stored_files(spark, source)
    files.repartition(max(1, min(files.count(), 64)), "path").mapInArrow(copy, "path string").write.format("noop").mode("overwrite").save()


def stream_growing(spark, sf_dir):
    """The log files loaded while they grow: a third of each, two thirds, and whole."""
    store, source = EventStore(spark, scratch_path(spark, "growing-store")), rendered(spark, sf_dir, "hours")
    target, ledger = scratch_path(spark, "growing"), Ledger(spark, scratch_path(spark, "growing-ledger"))
    for step in (1, 2, 3):
        grow_files(spark, source, target, step, 3)
        resume(spark, Layout(target), store, ledger, "live", LOADED_AT, LOADED_AT if step == 3 else None)
    return by_day(store.events())


def alternative_roundtrip(spark, sf_dir):
    rows = parse_alternative(spark, read_lines(spark, rendered(spark, sf_dir, "alternative")))
    return rows.where(F.col("ok")).select(
        "timestamp",
        "directory_name",
        "source_file",
        "line_number",
        "event_name",
        "level",
        "duration_ms",
        "user_name",
        "table_name",
        "context",
        "sql_query",
        "sdbl",
        "exception",
        "sql_error_code",
        "locks",
        "rows",
        "rows_affected",
        "severity",
        "category",
    )


def alternative_load(spark, sf_dir):
    """The second layout loaded into a store, as events like any other."""
    store = EventStore(spark, scratch_path(spark, "alternative-store"))
    ingest(spark, store, rendered(spark, sf_dir, "alternative"), "all", LOADED_AT, form="fields")
    return by_day(store.events())


def alternative_rejects(spark, sf_dir):
    loaded = parse_files(spark, rendered(spark, sf_dir, "alternative_damaged"), "all", LOADED_AT, form="fields")
    return loaded.rejects.select("directory_name", "source_file", "line_number", "reason")


def alternative_stats(spark, sf_dir):
    store = EventStore(spark, scratch_path(spark, "alternative-store"))
    stats = ingest(spark, store, rendered(spark, sf_dir, "alternative_damaged"), "all", LOADED_AT, form="fields")
    return stats.select("directory_name", "source_file", "lines", "events", "errors", "status")


def store_lifecycle(spark, sf_dir):
    """Whole journal stored, one session replaced and another deleted, old dates expired."""
    store, rows = EventStore(spark, scratch_path(spark, "lifecycle")), journal(spark, sf_dir)
    store.write(rows)
    day_ten = F.col("session_id") == "s_20240110"
    store.replace_session("s_20240110", rows.where(day_ten & (F.col("level") < 4)))
    store.replace_session("s_20240110", store.events("s_20240110").where(F.col("level") < 3))
    store.delete_session("s_20240120")
    store.expire(date(2024, 4, 5))
    return store.events().select("session_id", "timestamp", "directory_name", "source_file", "line_number", "sql")


def stream_ingest(spark, sf_dir):
    """The log files followed in four or more micro-batches."""
    return by_day(followed(spark, sf_dir)[0].events())


def stream_stats(spark, sf_dir):
    """What the micro-batches have counted, file by file."""
    files = Layout(rendered(spark, sf_dir, "hours").root)
    path = F.col("file_path")
    counted = spark.read.parquet(followed(spark, sf_dir)[1])
    return counted.select(
        files.directory_name(path).alias("directory_name"), files.source_file(path).alias("source_file"), "lines", "events", "errors"
    )


def followed(spark: SparkSession, sf_dir: str) -> tuple[EventStore, str]:
    """The store and the stats of a folder that was followed anew."""
    store, stats = EventStore(spark, scratch_path(spark, "stream")), scratch_path(spark, "stream-stats")
    layout = rendered(spark, sf_dir, "hours")
    n_files = list_files(spark, layout).count()
    query = follow(
        spark,
        layout,
        store,
        "live",
        scratch_path(spark, "stream-state"),
        LOADED_AT,
        stats_path=stats,
        max_files=-(-n_files // 4),
    )
    query.awaitTermination()
    return store, stats


QUERIES = {
    # lists and pages
    "slow_top20": on_journal(analysis.slowest),
    "latest_db_errors": on_journal(analysis.latest_errors),
    "search_page": on_journal(lambda j: search.search_events(j, PAGE_FILTER, 2, 50, "duration_ms", "desc")),
    "search_page_after": page_after,
    "search_like": on_journal(
        lambda j: search.search_events(
            j, EventFilter(search="T1_\nWHERE%y'", search_mode="like"), 1, 100, "event_name", "asc"
        )
    ),
    "search_narrow": on_journal(lambda j: search.search_events(j, NARROW_FILTER, 1, 1000, "unknown", None)),
    "search_count": on_journal(lambda j: search.count_events(j, PAGE_FILTER, 50)),
    "search_user_level": on_journal(
        lambda j: j.where(EventFilter(user="user7", level_min=2, level_max=4).predicate()).select(
            "timestamp", "usr", "level", "directory_name", "source_file", "line_number"
        )
    ),
    "deep_page_time": deep_slice("timestamp", "desc"),
    "deep_page_duration": deep_slice("duration_ms", "asc"),
    "deep_page_level": deep_slice("level", "desc"),
    "deep_page_name": deep_slice("event_name", "asc"),
    "nth_event": on_journal(lambda j: search.event_detail(j, 100)),
    "analysis_events_page": on_journal(lambda j: search.analysis_events(j, ANALYSIS_FILTER, 2, 50)),
    "default_bounds": lambda s, d: search.within_sessions(journal(s, d), session_rows(s, d)).select(
        "session_id", "timestamp", "directory_name", "source_file", "line_number"
    ),
    # facets
    "event_types": on_journal(lambda j: facets.distinct_values(j, "event_name")),
    "users": on_journal(lambda j: facets.distinct_values(j, "usr")),
    "directories": on_journal(analysis.directories),
    "error_facet": on_journal(facets.error_facet),
    # analysis
    "analysis_summary": on_journal(lambda j: analysis.summary(j.where(RATIO_FILTER.predicate()))),
    "filter_ratio": lambda s, d: analysis.filter_ratio(journal(s, d), session_rows(s, d), RATIO_FILTER),
    "types_top20": on_journal(analysis.event_types),
    "severity_dist": on_journal(analysis.severity_distribution),
    "category_dist": on_journal(lambda j: facets.count_by(j, "category")),
    "level_dist": on_journal(lambda j: facets.count_by(j, "level")),
    "timeline_second": on_journal(analysis.timeline),
    "timeline_minute": on_journal(lambda j: analysis.timeline(j, "1 minute")),
    "duration_totals": on_journal(analysis.duration_totals),
    "slow_sql": on_journal(analysis.slow_queries),
    "top_errors": on_journal(analysis.top_errors),
    "problem_tables": on_journal(lambda j: analysis.problem_values(j, "tableName")),
    "problem_users": on_journal(lambda j: analysis.problem_values(j, "usr")),
    # report
    "report_summary": on_journal(report.report_summary),
    "report_types": on_journal(report.report_types),
    "duration_stats": on_journal(report.duration_stats),
    "error_codes_top20": on_journal(report.error_codes),
    "top_users": on_journal(report.top_users),
    "session_reports": on_journal(lambda j: report.report_summary(j, by_session=True)),
    "session_durations": on_journal(lambda j: report.duration_stats(j, by_session=True)),
    "session_tops": on_journal(report.session_tops),
    # sessions
    "session_list": lambda s, d: sessions.session_list(session_rows(s, d), AS_OF, limit=10, offset=5),
    "session_list_filtered": lambda s, d: sessions.session_list(
        session_rows(s, d), AS_OF, sort_by="start_date", status="completed", created_from="2024-01-05", created_to="not a date"
    ),
    "session_progress": lambda s, d: sessions.session_progress(running_sessions(s, d), AS_OF),
    "session_overlap": session_overlap,
    "session_files": session_files,
    "stored_session_list": lambda s, d: sessions.session_list(session_store(s, d).sessions(), AS_OF, limit=10, offset=5),
    "stored_session_progress": lambda s, d: sessions.session_progress(session_store(s, d).sessions(), AS_OF),
    "stored_session_files": stored_session_files,
    "stored_cascade": stored_cascade,
    "delete_sessions": delete_sessions,
    "footprint": source_sizes,
    # storage and export
    "retention_90d": on_journal(
        lambda j: retained(j, date(2024, 4, 10)).groupBy("event_date").agg(F.count(F.lit(1)).alias("cnt"))
    ),
    "export_rows": on_journal(export_rows),
    "export_file": export_file,
    "store_lifecycle": store_lifecycle,
    # ingestion
    "ingest_roundtrip": ingest_roundtrip,
    "ingest_interval": ingest_interval,
    "ingest_rejects": ingest_rejects,
    "ingest_load_stats": ingest_load_stats,
    "ingest_totals": ingest_totals,
    "ingest_failures": ingest_failures,
    "ingest_encodings": ingest_encodings,
    "alt_layout_roundtrip": alternative_roundtrip,
    "alt_layout_load": alternative_load,
    "alt_layout_rejects": alternative_rejects,
    "alt_layout_stats": alternative_stats,
    "stream_ingest": stream_ingest,
    "stream_stats": stream_stats,
    "stream_growing": stream_growing,
}
