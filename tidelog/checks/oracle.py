"""The SQL counterpart of the registered queries (DuckDB)."""

from __future__ import annotations

from tidelog.schema import DETAIL_COLUMNS, ERROR_DESCRIPTIONS, EXPORT_HEADERS, LIST_COLUMNS, PROPERTY_COLUMNS

MAPPED = {
    "usr": "CASE WHEN user_id % 25 = 0 THEN '' ELSE concat('user', user_id) END",
    "tableName": "CASE WHEN event_id % 3 = 0 THEN concat('T', event_id % 20) ELSE '' END",
    "sql": "CASE WHEN event_type = 'click' THEN "
    "concat('SELECT * FROM T', event_id % 20, chr(10), 'WHERE a = ''x, y''') ELSE '' END",
    "sdbl": "CASE WHEN event_type = 'view' THEN concat('SELECT Ref FROM Doc', event_id % 10) ELSE '' END",
    "context": "CASE WHEN event_id % 4 = 0 THEN concat('Form.Call : Module.Run', chr(10), 'Line : ', event_id % 100) "
    "WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 1 THEN 'HRESULT=80004005, native=1205' "
    "WHEN 2 THEN 'Error: 2627' ELSE 'SQLState=40001' END ELSE '' END",
    "exception": "CASE WHEN event_type = 'error' THEN 'DataBaseException' ELSE '' END",
    "locks": "CASE WHEN event_type = 'purchase' THEN concat('Info', event_id % 8, ' Exclusive') ELSE '' END",
}
PROPERTIES = ",\n    ".join(f"{MAPPED.get(c, repr(''))} AS {c}" for c in PROPERTY_COLUMNS.values())

JOURNAL = f"""WITH mapped AS (
  SELECT
    event_id,
    ts AS "timestamp",
    concat('s_', strftime(ts, '%Y%m%d')) AS session_id,
    CAST(ts AS DATE) AS event_date,
    concat('ib', user_id % 5) AS directory_name,
    concat(strftime(ts, '%y%m%d%H'), '.log') AS source_file,
    row_number() OVER (PARTITION BY user_id % 5, strftime(ts, '%y%m%d%H') ORDER BY ts, event_id) AS line_number,
    TIMESTAMP '2024-02-01 00:00:00' AS loaded_at,
    CASE event_type WHEN 'click' THEN 'DBMSSQL' WHEN 'view' THEN 'SDBL' WHEN 'purchase' THEN 'TLOCK'
      WHEN 'error' THEN 'EXCP' ELSE 'CALL' END AS event_name,
    CAST(event_id % 6 AS INTEGER) AS level,
    CAST(round(value * 20000) AS BIGINT) AS duration_us,
    CAST(round(value * 20000) AS BIGINT) / CAST(1000 AS DOUBLE) AS duration_ms,
    {PROPERTIES},
    CAST(NULL AS BIGINT) AS rows_num,
    CAST(NULL AS BIGINT) AS rows_affected_num,
    CAST(CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 1 THEN 1205 WHEN 2 THEN 2627
      WHEN 3 THEN 40001 END END AS BIGINT) AS mssql_error_code
  FROM events
), journal AS (
  SELECT *,
    CASE WHEN exception <> '' OR coalesce(mssql_error_code, 0) > 0 OR level >= 4 THEN 'critical'
      WHEN duration_ms > 5000 OR level >= 3 THEN 'high'
      WHEN duration_ms > 1000 OR level >= 2 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN contains(upper(event_name), 'DBMSSQL') OR contains(upper(event_name), 'SDBL') THEN 'database'
      WHEN contains(upper(event_name), 'LOCK') OR locks <> '' THEN 'lock'
      WHEN contains(upper(event_name), 'ERROR') OR exception <> '' OR coalesce(mssql_error_code, 0) > 0 THEN 'error'
      WHEN duration_ms > 1000 THEN 'performance' ELSE 'info' END AS category
  FROM mapped
)"""

SESSIONS = (
    JOURNAL
    + """, sessions_v AS (
  SELECT session_id, min("timestamp") AS start_date, max("timestamp") AS end_date,
    CAST(NULL AS VARCHAR) AS directory_name, 'completed' AS status, CAST(100 AS DOUBLE) AS progress_percent,
    CAST(NULL AS VARCHAR) AS error_message,
    count(DISTINCT (directory_name, source_file)) AS total_files,
    count(DISTINCT (directory_name, source_file)) AS processed_files,
    count(*) AS total_events,
    max("timestamp") AS started_at,
    max("timestamp") + to_seconds(count(*)) AS completed_at,
    max("timestamp") AS created_at,
    '' AS comment
  FROM journal GROUP BY session_id
)"""
)

RUNNING = (
    SESSIONS
    + """, files AS (
  SELECT session_id, directory_name, source_file, count(*) AS events, min("timestamp") AS first_ts,
    max("timestamp") AS last_ts, hour(max("timestamp")) < 12 AS done
  FROM journal GROUP BY ALL
), running AS (
  SELECT s.session_id, s.start_date, s.end_date, s.total_files, 'running' AS status,
    count(*) FILTER (done) AS processed_files, sum(events) FILTER (done) AS total_events,
    min(first_ts) AS started_at
  FROM sessions_v s JOIN files f USING (session_id) GROUP BY ALL
)"""
)

PAGE_WHERE = """duration_ms >= 100 AND duration_ms <= 9000
  AND "timestamp" >= TIMESTAMP '2024-01-03 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-28 12:30:00.500'
  AND (contains(context, 'SELECT') OR contains(sql, 'SELECT') OR contains(sdbl, 'SELECT'))"""
ANALYSIS_WHERE = """severity = 'critical' AND duration_ms >= 10
  AND (contains(context, 'DataBase') OR contains(sql, 'DataBase') OR contains(exception, 'DataBase'))"""
RATIO_WHERE = "event_name = 'DBMSSQL' AND duration_ms >= 50"
KEY = "directory_name, source_file, line_number, session_id"
DAMAGED = "(exception <> '' AND level = 5)"


def cut(name: str, length: int) -> str:
    return f"nullif(substr({name}, 1, {length}), '')"


def listed(columns: dict[str, str]) -> str:
    long = ("context", "sql", "exception", "planSQLText", "sdbl")
    return ", ".join(
        f'{cut(c, 1000)} AS "{out}"' if c in long else f'"{c}" AS "{out}"' for c, out in columns.items()
    )


def short_rows(columns: list[str], length: int) -> str:
    long = ("context", "sql", "exception")
    return ", ".join(f"{cut(c, length)} AS {c}" if c in long else f'"{c}"' for c in columns)


SLOW = ["timestamp", "event_name", "duration_ms", "directory_name", "source_file", "usr", "context", "sql",
        "exception", "severity"]
ERRORS = SLOW[:3] + ["mssql_error_code"] + SLOW[3:]
ANALYSIS_LIST = ["timestamp", "event_name", "level", "duration_ms", "directory_name", "source_file", "usr",
                 "context", "sql", "exception", "severity", "mssql_error_code"]
DEEP = '"timestamp", event_name, level, duration_ms, directory_name, source_file, line_number'


def page(select: str, where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"{JOURNAL} SELECT {select} FROM journal WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"


def counted(column: str, where: str = "true", top: int | None = None) -> str:
    limit = f" LIMIT {top}" if top else ""
    return (
        f"{JOURNAL} SELECT {column}, count(*) AS cnt FROM journal WHERE {where} "
        f"GROUP BY {column} ORDER BY cnt DESC, {column}{limit}"
    )


def half_up(num: str, den: str, digits: int) -> str:
    """num / den rounded half-up on whole numbers."""
    scale = 10**digits
    return (
        f"CASE WHEN {den} <> 0 THEN CAST((CAST({num} AS HUGEINT) * {2 * scale} + {den}) // (2 * {den}) AS DOUBLE)"
        f" / {scale} END"
    )


DESCRIPTIONS = "(VALUES " + ", ".join(f"({c}, '{d}')" for c, d in ERROR_DESCRIPTIONS.items()) + ") d(code, description)"
SANE = "duration_ms > 0 AND duration_ms < 10000000"


def report_summary(group: str) -> str:
    lead = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    span = "date_diff('microsecond', range_start, range_end)"
    return f"""{JOURNAL}, r AS (
  SELECT {lead}count(*) AS total_events, count(DISTINCT usr) AS unique_users,
    count(DISTINCT directory_name) AS unique_directories,
    count(*) FILTER (mssql_error_code > 0) AS mssql_errors_count,
    min("timestamp") AS range_start, max("timestamp") AS range_end
  FROM journal{by})
SELECT *, {span} / 1e6 AS duration_seconds,
  {half_up('total_events * 1000000', span, 2)} AS events_per_second,
  {half_up('total_events * 60000000', span, 1)} AS events_per_minute
FROM r"""


def duration_stats(group: str) -> str:
    lead = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    return f"""{JOURNAL} SELECT {lead}min(duration_ms) AS "min",
  {half_up('sum(duration_us)', '(count(*) * 1000)', 6)} AS "avg", max(duration_ms) AS "max",
  round(quantile_cont(duration_ms, 0.5), 6) AS median, round(quantile_cont(duration_ms, 0.95), 6) AS p95
FROM journal WHERE {SANE}{by}"""


def timeline(unit: str) -> str:
    return f"""{JOURNAL} SELECT date_trunc('{unit}', "timestamp") AS bucket, count(*) AS cnt,
  {half_up('sum(duration_us)', '(count(*) * 1000)', 2)} AS avg_duration_ms
FROM journal GROUP BY 1 ORDER BY 1 LIMIT 300"""


def problem(column: str) -> str:
    return f"""{JOURNAL} SELECT {column}, count(*) AS cnt, count(*) FILTER (mssql_error_code > 0) AS errors,
  count(*) FILTER (duration_ms > 1000) AS slow, CAST(sum(duration_us) AS BIGINT) / 1000.0::DOUBLE AS total_duration_ms,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_duration_ms
FROM journal WHERE {column} <> '' GROUP BY {column} ORDER BY sum(duration_us) DESC, {column} LIMIT 20"""


def session_list(order: str, where: str, limit: int, offset: int) -> str:
    return f"""{SESSIONS} SELECT session_id, status, start_date, end_date, directory_name, comment, progress_percent,
  total_events, total_files, processed_files, created_at, started_at, completed_at,
  date_diff('microsecond', started_at, completed_at) / 1e6 AS elapsed_seconds, error_message
FROM sessions_v WHERE {where} ORDER BY {order} DESC, session_id LIMIT {limit} OFFSET {offset}"""


PERCENT = half_up("processed_files * 100", "total_files", 2)
ELAPSED = "(date_diff('microsecond', started_at, TIMESTAMP '2024-02-01 00:00:00') / 1e6)"

ISO = (
    """CASE WHEN microsecond("timestamp") % 1000000 = 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S') """
    """ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') END"""
)


def export_cells(names: dict[str, str], texts: bool) -> str:
    long = ("context", "sql", "exception", "planSQLText", "sdbl")
    cells = []
    for column in names:
        if column == "timestamp":
            value = ISO
        elif column == "duration_ms":
            value = "CAST(duration_ms AS VARCHAR)" if texts else "duration_ms"
        elif column in long:
            value = f"substr({column}, 1, 1000)"
        else:
            value = f"coalesce(CAST(\"{column}\" AS VARCHAR), '')"
        cells.append(f'{value} AS "{names[column]}"')
    return ", ".join(cells)


EXPORTED = f'true ORDER BY "timestamp" DESC, {KEY} LIMIT 10000'
EVENT_SELECT = (
    '"timestamp", directory_name, source_file, line_number, loaded_at, event_name, level, duration_us, duration_ms, '
    + ", ".join(f'"{c}"' for c in PROPERTY_COLUMNS.values())
    + ", rows_num, rows_affected_num, severity, category, mssql_error_code, session_id, event_date"
)
ALL_EVENTS = f"{JOURNAL} SELECT {EVENT_SELECT} FROM journal"
LINES = "1 + length(sql) - length(replace(sql, chr(10), '')) + length(context) - length(replace(context, chr(10), ''))"
FLAT = "replace({0}, chr(10), ' ')"


def rejected_text() -> str:
    def quote(c):
        return (
            f"CASE WHEN NOT regexp_matches({c}, '[,''\"\\n]') THEN {c} "
            f"WHEN contains({c}, '''') THEN concat('\"', replace({c}, '\"', '\"\"'), '\"') "
            f"ELSE concat('''', {c}, '''') END"
        )

    parts = ", ".join(
        f"CASE WHEN {c} <> '' THEN concat('{key}=', {quote(c)}) END"
        for key, c in PROPERTY_COLUMNS.items()
        if c in MAPPED
    )
    return (
        "concat(strftime(\"timestamp\", '%M'), ':61.', strftime(\"timestamp\", '%f'), '-', duration_us, ',', "
        f"event_name, ',', level, ',', concat_ws(',', {parts}))"
    )


ORACLE = {
    "slow_top20": page(short_rows(SLOW, 500), "duration_ms > 1000", f'duration_ms DESC, "timestamp", {KEY}', 20),
    "latest_db_errors": page(short_rows(ERRORS, 500), "mssql_error_code > 0", f'"timestamp" DESC, {KEY}', 20),
    "search_page": page(listed(LIST_COLUMNS), PAGE_WHERE, f'duration_ms DESC, "timestamp" DESC, {KEY}', 50, 50),
    "search_page_after": page(
        '"timestamp", duration_ms, directory_name, source_file, line_number, usr',
        PAGE_WHERE,
        f'duration_ms DESC, "timestamp" DESC, {KEY}',
        50,
        50,
    ),
    "search_like": page(
        listed(LIST_COLUMNS),
        "(context LIKE concat('%T1_', chr(10), 'WHERE%y''%') OR sql LIKE concat('%T1_', chr(10), 'WHERE%y''%')"
        " OR sdbl LIKE concat('%T1_', chr(10), 'WHERE%y''%'))",
        f'event_name, "timestamp", {KEY}',
        100,
    ),
    "search_narrow": page(
        listed(LIST_COLUMNS),
        "severity = 'critical' AND category = 'error' AND directory_name = 'ib1' AND mssql_error_code = 1205",
        f'"timestamp" DESC, {KEY}',
        1000,
    ),
    "search_count": f"{JOURNAL} SELECT count(*) AS total, (count(*) + 49) // 50 AS total_pages "
    f"FROM journal WHERE {PAGE_WHERE}",
    "search_user_level": f"""{JOURNAL} SELECT "timestamp", usr, level, directory_name, source_file, line_number
FROM journal WHERE usr = 'user7' AND level BETWEEN 2 AND 4""",
    "deep_page_time": page(DEEP, "true", f'"timestamp" DESC, {KEY}', 40, 6000),
    "deep_page_duration": page(DEEP, "true", f'duration_ms, "timestamp", {KEY}', 40, 6000),
    "deep_page_level": page(DEEP, "true", f'level DESC, "timestamp" DESC, {KEY}', 40, 6000),
    "deep_page_name": page(DEEP, "true", f'event_name, "timestamp", {KEY}', 40, 6000),
    "nth_event": f"{JOURNAL}, d AS (SELECT * FROM journal ORDER BY \"timestamp\", {KEY} LIMIT 1 OFFSET 100) "
    "SELECT CAST(100 AS BIGINT) AS \"index\", "
    + ", ".join(f'"{c}" AS "{out}"' for c, out in DETAIL_COLUMNS.items())
    + " FROM d",
    "analysis_events_page": page(
        short_rows(ANALYSIS_LIST, 1000), ANALYSIS_WHERE, f'"timestamp" DESC, {KEY}', 50, 50
    ),
    "default_bounds": f"""{SESSIONS} SELECT j.session_id, j."timestamp", j.directory_name, j.source_file, j.line_number
FROM journal j JOIN sessions_v s USING (session_id)
WHERE j."timestamp" BETWEEN date_trunc('millisecond', s.start_date) AND date_trunc('millisecond', s.end_date)""",
    "event_types": f"{JOURNAL} SELECT DISTINCT event_name FROM journal WHERE event_name <> '' ORDER BY 1",
    "users": f"{JOURNAL} SELECT DISTINCT usr FROM journal WHERE usr <> '' ORDER BY 1",
    "directories": f"{JOURNAL} SELECT DISTINCT directory_name FROM journal ORDER BY 1",
    "error_facet": f"""{JOURNAL}, c AS (SELECT mssql_error_code AS code, count(*) AS n FROM journal
  WHERE mssql_error_code > 0 GROUP BY 1)
SELECT c.code, n AS "count", coalesce(d.description, 'Unknown error') AS description,
  concat(c.code, ' — ', coalesce(d.description, 'Unknown'), ' (', n, ')') AS label
FROM c LEFT JOIN {DESCRIPTIONS} ON c.code = d.code ORDER BY n DESC, c.code LIMIT 50""",
    "analysis_summary": f"""{JOURNAL} SELECT count(*) AS total, min("timestamp") AS min_ts, max("timestamp") AS max_ts,
  count(DISTINCT directory_name) AS dir_count FROM journal WHERE {RATIO_WHERE}""",
    "filter_ratio": f"""{SESSIONS}, kept AS (SELECT session_id, count(*) AS n, min("timestamp") AS a,
  max("timestamp") AS b, count(DISTINCT directory_name) AS dirs FROM journal WHERE {RATIO_WHERE} GROUP BY 1)
SELECT s.session_id, coalesce(n, 0) AS total_events, greatest(s.total_events - coalesce(n, 0), 0) AS total_filtered,
  coalesce({half_up('(s.total_events - coalesce(n, 0)) * 100', 's.total_events', 1)}, 0) AS filter_percent,
  coalesce(a, start_date) AS range_start, coalesce(b, end_date) AS range_end, coalesce(dirs, 0) AS dir_count
FROM sessions_v s LEFT JOIN kept USING (session_id)""",
    "types_top20": counted("event_name", top=20),
    "severity_dist": counted("severity"),
    "category_dist": counted("category"),
    "level_dist": counted("level"),
    "timeline_second": timeline("second"),
    "timeline_minute": timeline("minute"),
    "duration_totals": f"""{JOURNAL} SELECT count(*) AS total_events,
  CAST(sum(duration_us) AS BIGINT) / 1000.0::DOUBLE AS total_duration_ms,
  {half_up('sum(duration_us)', '(count(*) * 1000)', 6)} AS average_duration_ms,
  max(duration_ms) AS max_duration_ms, min("timestamp") AS period_start, max("timestamp") AS period_end,
  {half_up("date_diff('microsecond', min(\"timestamp\"), max(\"timestamp\"))", '60000000', 6)} AS duration_minutes
FROM journal""",
    "slow_sql": f"""{JOURNAL} SELECT sql, count(*) AS cnt, max(duration_ms) AS max_duration_ms,
  {half_up('sum(duration_us)', '(count(*) * 1000)', 6)} AS avg_duration_ms,
  CAST(sum(duration_us) AS BIGINT) / 1000.0::DOUBLE AS total_duration_ms
FROM journal WHERE sql <> '' GROUP BY sql ORDER BY max_duration_ms DESC, sql LIMIT 20""",
    "top_errors": f"""{JOURNAL}, e AS (SELECT *, row_number() OVER (PARTITION BY mssql_error_code
    ORDER BY "timestamp", {KEY}) AS r, count(*) OVER (PARTITION BY mssql_error_code) AS cnt
  FROM journal WHERE mssql_error_code > 0)
SELECT mssql_error_code AS code, coalesce(d.description, 'Unknown error') AS error_type, cnt,
  exception AS sample, context AS sample_context
FROM e LEFT JOIN {DESCRIPTIONS} ON mssql_error_code = d.code WHERE r = 1 ORDER BY cnt DESC, 1 LIMIT 20""",
    "problem_tables": problem("tableName"),
    "problem_users": problem("usr"),
    "report_summary": report_summary(""),
    "report_types": counted("event_name", "event_name <> ''", 20),
    "duration_stats": duration_stats(""),
    "error_codes_top20": counted("mssql_error_code", "mssql_error_code > 0", 20),
    "top_users": counted("usr", "usr <> ''", 10),
    "session_reports": report_summary("session_id"),
    "session_durations": duration_stats("session_id"),
    "session_tops": f"""{JOURNAL}, v AS (
  SELECT session_id, 'event_type' AS kind, event_name AS value, 0 AS num FROM journal WHERE event_name <> ''
  UNION ALL SELECT session_id, 'user', usr, 0 FROM journal WHERE usr <> ''
  UNION ALL SELECT session_id, 'error_code', CAST(mssql_error_code AS VARCHAR), mssql_error_code
  FROM journal WHERE mssql_error_code > 0
), c AS (SELECT session_id, kind, value, num, count(*) AS cnt FROM v GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY cnt DESC, num, value) AS place FROM c)
SELECT session_id, kind, value, cnt, place FROM r
WHERE place <= CASE kind WHEN 'user' THEN 10 ELSE 20 END""",
    "session_list": session_list("created_at", "true", 10, 5),
    "session_list_filtered": session_list(
        "start_date", "status = 'completed' AND created_at >= TIMESTAMP '2024-01-05'", 100, 0
    ),
    "session_progress": f"""{RUNNING} SELECT session_id, status, {PERCENT} AS progress_percent, total_files,
  processed_files, CAST(coalesce(total_events, 0) AS BIGINT) AS total_events,
  CAST(NULL AS VARCHAR) AS error_message, started_at, CAST(NULL AS TIMESTAMP) AS completed_at,
  {ELAPSED} AS elapsed_seconds,
  CASE WHEN {PERCENT} > 0 THEN round({ELAPSED} / {PERCENT} * 100 - {ELAPSED}, 3) END AS eta_seconds,
  started_at + INTERVAL 3 HOUR AS started_at_msk
FROM running""",
    "session_overlap": f"""{RUNNING}, asked AS (SELECT session_id AS request_id,
  start_date + INTERVAL 12 HOUR AS start_date, end_date + INTERVAL 12 HOUR AS end_date FROM running),
hits AS (SELECT a.*, r.session_id AS overlap_id, r.start_date AS overlap_start,
    row_number() OVER (PARTITION BY request_id ORDER BY r.start_date, r.session_id) AS n
  FROM asked a LEFT JOIN running r ON r.start_date <= a.end_date AND r.end_date >= a.start_date)
SELECT request_id, start_date, end_date, overlap_id, overlap_start FROM hits WHERE n = 1""",
    "session_files": f"""{SESSIONS}, f AS (SELECT session_id, directory_name, source_file, count(*) AS events,
  max(line_number) AS last_line_number, min("timestamp") AS first_ts, max("timestamp") AS last_ts
  FROM journal GROUP BY 1, 2, 3)
SELECT s.session_id, s.status, s.total_files, f.directory_name, f.source_file, events, last_line_number, first_ts,
  last_ts FROM sessions_v s LEFT JOIN f USING (session_id)""",
    "stored_session_list": session_list("created_at", "true", 10, 5),
    "stored_session_progress": f"""{SESSIONS} SELECT session_id, status, {PERCENT} AS progress_percent, total_files,
  processed_files, total_events, error_message, started_at, completed_at,
  date_diff('microsecond', started_at, completed_at) / 1e6 AS elapsed_seconds, CAST(NULL AS DOUBLE) AS eta_seconds,
  started_at + INTERVAL 3 HOUR AS started_at_msk FROM sessions_v""",
    "stored_session_files": f"""{SESSIONS}, f AS (SELECT session_id, directory_name, source_file, count(*) AS events
  FROM journal GROUP BY 1, 2, 3)
SELECT s.session_id, s.status, s.total_files, f.directory_name, f.source_file, events FROM sessions_v s LEFT JOIN f USING (session_id)""",
    "stored_cascade": f"""{JOURNAL} SELECT session_id, count(DISTINCT (directory_name, source_file)) AS total_files,
  count(DISTINCT (directory_name, source_file)) AS files, count(*) AS events
FROM journal WHERE event_date >= DATE '2024-01-05' GROUP BY 1""",
    "delete_sessions": f"""{SESSIONS} SELECT session_id, count(*) AS cnt FROM journal WHERE session_id NOT IN
  (SELECT session_id FROM sessions_v WHERE start_date < TIMESTAMP '2024-01-08') GROUP BY 1""",
    "retention_90d": f"{JOURNAL} SELECT event_date, count(*) AS cnt FROM journal "
    "WHERE event_date >= DATE '2024-04-10' - INTERVAL 90 DAY GROUP BY 1",
    "export_rows": f"{JOURNAL} SELECT {export_cells({c: c for c in EXPORT_HEADERS}, False)} FROM journal WHERE {EXPORTED}",
    "export_file": f"{JOURNAL} SELECT {export_cells({c: c for c in EXPORT_HEADERS}, True)} FROM journal WHERE {EXPORTED}",
    "store_lifecycle": f"""{JOURNAL} SELECT session_id, "timestamp", directory_name, source_file, line_number, sql
FROM journal WHERE (session_id <> 's_20240110' OR level < 3) AND session_id <> 's_20240120'
  AND event_date >= DATE '2024-04-05' - INTERVAL 90 DAY""",
    "ingest_roundtrip": ALL_EVENTS,
    "ingest_interval": f"""{JOURNAL} SELECT "timestamp", directory_name, source_file, line_number, event_name, duration_us
FROM journal WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10 06:30:00' AND TIMESTAMP '2024-01-20 18:45:00'""",
    "ingest_rejects": f"""{JOURNAL} SELECT directory_name, source_file, line_number, 'bad_time' AS reason,
  {rejected_text()} AS record FROM journal WHERE {DAMAGED}""",
    "ingest_load_stats": f"""{JOURNAL}, f AS (SELECT directory_name, source_file, CAST(sum({LINES}) AS BIGINT) AS lines,
  count(*) FILTER (NOT {DAMAGED}) AS events, count(*) FILTER ({DAMAGED}) AS errors FROM journal GROUP BY 1, 2)
SELECT *, CASE WHEN events > 0 THEN 'completed' ELSE 'empty' END AS status FROM f""",
    "ingest_totals": f"""{JOURNAL} SELECT count(DISTINCT (directory_name, source_file)) AS total_files,
  count(DISTINCT (directory_name, source_file)) AS processed_files,
  count(*) FILTER (NOT {DAMAGED}) AS total_events, CAST(100 AS DOUBLE) AS progress_percent FROM journal""",
    "ingest_encodings": f"""{JOURNAL} SELECT "timestamp", directory_name, source_file, line_number,
  CASE WHEN usr <> '' THEN concat('Инженер ', usr) ELSE '' END AS usr FROM journal""",
    "ingest_failures": f"""{JOURNAL}, f AS (SELECT directory_name, source_file, CAST(sum({LINES}) AS BIGINT) AS n, count(*) AS cnt,
  CASE WHEN directory_name = 'ib1' AND source_file = '24011006.log' THEN 'permission_error'
       WHEN directory_name = 'ib2' AND source_file = '24011007.log' THEN 'error' ELSE 'completed' END AS status FROM journal GROUP BY 1, 2)
SELECT directory_name, source_file, CASE WHEN status = 'completed' THEN n ELSE 0 END AS lines,
  CASE WHEN status = 'completed' THEN cnt ELSE 0 END AS events, CAST(0 AS BIGINT) AS errors, status FROM f""",
    "alt_layout_roundtrip": f"""{JOURNAL} SELECT date_trunc('second', "timestamp") AS "timestamp", directory_name,
  source_file, line_number, event_name, CAST(level AS BIGINT) AS level, duration_ms, usr AS user_name,
  tableName AS table_name, {FLAT.format('context')} AS context, {FLAT.format('sql')} AS sql_query, sdbl, exception,
  coalesce(CAST(mssql_error_code AS VARCHAR), '') AS sql_error_code, locks, CAST(0 AS BIGINT) AS rows,
  CAST(0 AS BIGINT) AS rows_affected, severity, category FROM journal""",
    "alt_layout_load": f"""{JOURNAL}, flat AS (SELECT * REPLACE (date_trunc('second', "timestamp") AS "timestamp",
  {FLAT.format('context')} AS context, {FLAT.format('sql')} AS sql) FROM journal) SELECT {EVENT_SELECT} FROM flat""",
    "alt_layout_rejects": f"""{JOURNAL} SELECT directory_name, source_file, line_number, 'bad_level' AS reason
FROM journal WHERE {DAMAGED}""",
    # A record has a line for its time and one for each of its 27 fields.
    "alt_layout_stats": f"""{JOURNAL}, f AS (SELECT directory_name, source_file, 28 * count(*) AS lines,
  count(*) FILTER (NOT {DAMAGED}) AS events, count(*) FILTER ({DAMAGED}) AS errors FROM journal GROUP BY 1, 2)
SELECT *, CASE WHEN events > 0 THEN 'completed' ELSE 'empty' END AS status FROM f""",
    "stream_ingest": ALL_EVENTS,
    "stream_growing": ALL_EVENTS,
    "stream_stats": f"""{JOURNAL} SELECT directory_name, source_file, CAST(sum({LINES}) AS BIGINT) AS lines,
  count(*) AS events, CAST(0 AS BIGINT) AS errors FROM journal GROUP BY 1, 2""",
    "footprint": f"""{SESSIONS}, sizes AS (SELECT session_id, count(DISTINCT (directory_name, source_file)) AS n_files,
  CAST(sum(strlen({rejected_text()}) + 1) AS BIGINT) AS n_bytes FROM journal GROUP BY 1)
SELECT session_id, total_events, start_date, end_date, n_files, n_bytes, round(n_bytes / 1048576.0::DOUBLE, 2) AS size_mb
FROM sessions_v LEFT JOIN sizes USING (session_id)""",
}
