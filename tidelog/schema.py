"""The event schema and the name maps of the query outputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Property key in the journal text -> event column.
PROPERTY_COLUMNS = {
    "p:processName": "p_processName",
    "t:computerName": "t_computerName",
    "t:connectID": "t_connectID",
    "Usr": "usr",
    "dbpid": "dbpid",
    "OSThread": "osThread",
    "SessionID": "sessionID",
    "Trans": "trans",
    "Func": "func",
    "tableName": "tableName",
    "Context": "context",
    "Sql": "sql",
    "Sdbl": "sdbl",
    "planSQLText": "planSQLText",
    "Exception": "exception",
    "Locks": "locks",
    "WaitConnections": "waitConnections",
    "DeadlockConnectionIntersections": "deadlockConnectionIntersections",
    "lkaid": "lkaid",
    "lka": "lka",
    "lkp": "lkp",
    "lkpid": "lkpid",
    "lksrc": "lksrc",
    "Rows": "rows",
    "RowsAffected": "rowsAffected",
    "Description": "description",
    "Data": "data",
}
# Fixed value: second spelling of a key, used when the first is absent.
PROPERTY_FALLBACKS = {"Sql": "SQL"}

# Columns stored up to TEXT_LIMIT characters (the data model's column width).
LONG_TEXT_COLUMNS = ("context", "sql", "sdbl", "planSQLText", "exception")
TEXT_LIMIT = 100_000

MAX_LEVEL = 255
MAX_ERROR_CODE = 4_294_967_295

_string_columns = list(PROPERTY_COLUMNS.values())

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("directory_name", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("loaded_at", T.TimestampNTZType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("duration_us", T.LongType()),
        T.StructField("duration_ms", T.DoubleType()),
    ]
    + [T.StructField(name, T.StringType()) for name in _string_columns]
    + [
        T.StructField("rows_num", T.LongType()),
        T.StructField("rows_affected_num", T.LongType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("mssql_error_code", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_date", T.DateType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()
PARTITION_COLUMNS = ("session_id", "event_date")

# A total order over events: every page and top-k ends with these.
EVENT_KEY = ("timestamp", "directory_name", "source_file", "line_number", "session_id")

# Event column -> name in the event list, in list order.
LIST_COLUMNS = {
    "timestamp": "timestamp",
    "event_name": "event_name",
    "level": "level",
    "duration_ms": "duration_ms",
    "p_processName": "process_name",
    "usr": "user_name",
    "tableName": "table_name",
    "context": "context",
    "sql": "sql",
    "exception": "exception",
    "severity": "severity",
    "category": "category",
    "directory_name": "directory_name",
    "source_file": "source_file",
    "line_number": "line_number",
    "t_computerName": "computerName",
    "t_connectID": "connectID",
    "dbpid": "dbpid",
    "osThread": "osThread",
    "sessionID": "sessionID",
    "trans": "trans",
    "func": "func",
    "locks": "locks",
    "waitConnections": "waitConnections",
    "deadlockConnectionIntersections": "deadlockConnectionIntersections",
    "lkaid": "lkaid",
    "lka": "lka",
    "lkp": "lkp",
    "lkpid": "lkpid",
    "lksrc": "lksrc",
    "rows": "rows",
    "rowsAffected": "rowsAffected",
    "description": "description",
    "data": "data",
    "planSQLText": "planSQLText",
    "sdbl": "sdbl",
    "mssql_error_code": "mssql_error_code",
}

# Event column -> name in the full detail view, in view order.
DETAIL_COLUMNS = {
    "timestamp": "timestamp",
    "event_name": "event_name",
    "level": "level",
    "duration_ms": "duration_ms",
    "p_processName": "process_name",
    "t_computerName": "computer_name",
    "t_connectID": "connect_id",
    "usr": "user_name",
    "dbpid": "dbpid",
    "osThread": "os_thread",
    "sessionID": "session_id",
    "trans": "trans",
    "func": "func",
    "tableName": "table_name",
    "context": "context",
    "sql": "sql",
    "sdbl": "sdbl",
    "planSQLText": "plan_sql_text",
    "exception": "exception",
    "locks": "locks",
    "waitConnections": "wait_connections",
    "deadlockConnectionIntersections": "deadlock_intersections",
    "lkaid": "lkaid",
    "lka": "lka",
    "lkp": "lkp",
    "lkpid": "lkpid",
    "lksrc": "lksrc",
    "rows": "rows",
    "rowsAffected": "rows_affected",
    "description": "description",
    "data": "data",
    "severity": "severity",
    "category": "category",
    "directory_name": "directory_name",
    "source_file": "source_file",
    "line_number": "line_number",
}

# Event column -> header of the exported file, in file order.
EXPORT_HEADERS = {
    "timestamp": "Время",
    "event_name": "Тип события",
    "level": "Уровень",
    "duration_ms": "Длительность (мс)",
    "p_processName": "Процесс",
    "usr": "Пользователь",
    "tableName": "Таблица",
    "context": "Контекст",
    "sql": "SQL",
    "exception": "Исключение",
    "severity": "Severity",
    "category": "Категория",
    "directory_name": "Инфобаза",
    "source_file": "Файл",
    "line_number": "Строка",
    "t_computerName": "Компьютер",
    "t_connectID": "Connect ID",
    "dbpid": "DB PID",
    "osThread": "OS Thread",
    "sessionID": "Session ID",
    "trans": "Trans",
    "func": "Func",
    "locks": "Locks",
    "waitConnections": "Wait Connections",
    "deadlockConnectionIntersections": "Deadlock Intersections",
    "lkaid": "lkaid",
    "lka": "lka",
    "lkp": "lkp",
    "lkpid": "lkpid",
    "lksrc": "lksrc",
    "rows": "Rows",
    "rowsAffected": "Rows Affected",
    "description": "Описание",
    "data": "Data",
    "planSQLText": "Plan SQL",
    "sdbl": "SDBL",
    "mssql_error_code": "Код ошибки MSSQL",
}

# Database error code -> description.
ERROR_DESCRIPTIONS = {
    1205: "Deadlock victim",
    2627: "Unique constraint violation",
    547: "Foreign key violation",
    2601: "Duplicate key",
    1222: "Lock timeout",
    18456: "Login failed",
    4060: "Cannot open database",
    208: "Invalid object name",
    207: "Invalid column name",
    102: "Syntax error",
}

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("start_date", T.TimestampNTZType(), False),
        T.StructField("end_date", T.TimestampNTZType(), False),
        T.StructField("directory_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("progress_percent", T.DoubleType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("total_files", T.LongType()),
        T.StructField("processed_files", T.LongType()),
        T.StructField("total_events", T.LongType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("comment", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)
