"""The ``field;value`` layout."""

from datetime import datetime

import pytest

from tidelog.operators.alternative import parse_alternative
from tidelog.plans.ingest import parse_files
from tidelog.plans.load import load_session
from tidelog.sources.files import Layout, read_lines
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore

from .conftest import LOADED_AT


def parse(spark, logs, **bounds):
    return parse_alternative(spark, read_lines(spark, Layout(logs.root)), **bounds)


def test_fields_types_and_rejects(spark, logs):
    logs(
        "a/26031005.log",
        "usr;before any record\n"
        "2026-03-10 05:05:59.123\n"
        'event_name;"CALL"\n\n  duration_ms;12.5  \n"usr";Ann\ncontext;a;b\nno separator\nrows;7\nusr;"Bob"\n'
        "2026-03-10  05:06:00.9 level;3\n"
        "2026-03-10 05:07:00.1\nlevel;many\n"
        "2026-03-10 05:08:00.1\nexception;x\nlevel;\nduration_ms;6000\n"
        "2026-13-10 05:08:00.1\n",
    )
    rows = parse(spark, logs).orderBy("event_seq").collect()
    assert [r.ok for r in rows] == [True, True, False, True, False]
    first, second, _, fourth, _ = rows
    assert first.timestamp == datetime(2026, 3, 10, 5, 5, 59)
    assert (first.event_name, first.duration_ms, first.user_name, first.context, first.rows) == ("CALL", 12.5, "Bob", "a;b", 7)
    assert (first.level, first.rows_affected, first.severity, first.category) == (0, 0, "low", "info")
    assert (second.level, second.severity) == (3, "high")
    assert (fourth.level, fourth.severity, fourth.category) == (0, "critical", "error")


def test_interval_in_whole_seconds(spark, logs):
    logs("a/26031005.log", "2026-03-10 05:00:10.9\nusr;in\n2026-03-10 05:00:11.1\nusr;out\n")
    rows = parse(spark, logs, start=datetime(2026, 3, 10, 5, 0, 10), end=datetime(2026, 3, 10, 5, 0, 10)).collect()
    assert [r.user_name for r in rows] == ["in"]


def test_broken_bytes_are_left_out(spark, logs):
    logs("a/26031005.log", b"2026-03-10 05:00:10.9\nusr;a\xffb\n")
    assert parse(spark, logs).first().user_name == "ab"


TEXT = (
    'usr;"before any record"\n'
    '2026-03-10 05:05:59.123\nevent_name;"CALL"\nduration_ms;12.5\nusr;Bob\ncontext;a;b\nrows;7\nline_number;40\ndirectory_name;"x"\nsql_error_code;1205\n'
    "2026-03-10 05:06:00.9\nlevel;3\nsql_error_code;none\n"
    "2026-03-10 05:07:00.1\nlevel;many\ndirectory_name;y\n"
    "2026-03-10 05:08:00.1\nduration_ms;1,5\n"
    "2026-03-10 05:09:00.1\nlevel;300\n"
    "2026-03-10 05:10:00.1\nsql_error_code;99999999999\n"
    "2026-13-10 05:08:00.1\nusr;late\n"
    "2026-03-10 05:11:00.1\nrowsAffected;?\n"
)


def test_the_layout_is_loaded_like_the_other(spark, logs, tmp_path):
    logs("a/26031005.log", TEXT)
    logs("b/26031006.log", b"2026-03-10 06:00:10.9\nusr;a\xffb\n")
    logs("b/26031007.log", "")
    events, sessions = EventStore(spark, str(tmp_path / "events")), SessionStore(spark, str(tmp_path / "sessions"))
    hours = datetime(2026, 3, 10, 5), datetime(2026, 3, 10, 8)
    stats = load_session(spark, events, sessions, Layout(logs.root), "s", LOADED_AT, *hours, form="fields")
    assert {(r.source_file, r.lines, r.events, r.errors, r.status) for r in stats.collect()} == {
        ("26031005.log", 26, 2, 6, "completed"), ("26031006.log", 2, 1, 0, "completed"), ("26031007.log", 0, 0, 0, "empty")
    }
    first, second, third = events.events("s").orderBy("timestamp").collect()
    assert (first.directory_name, first.source_file, first.line_number, first.duration_us, first.duration_ms) == ("x", "26031005.log", 40, 12500, 12.5)
    assert (first.event_name, first.usr, first.context, first.rows, first.rows_num, first.mssql_error_code, first.severity) == ("CALL", "Bob", "a;b", "7", 7, 1205, "critical")
    assert (second.directory_name, second.line_number, second.level, second.mssql_error_code, second.rows_num, second.lka) == ("a", 2, 3, None, None, "")
    assert (third.directory_name, third.usr, third.timestamp) == ("b", "ab", datetime(2026, 3, 10, 6, 0, 10))
    assert sessions.sessions().first().total_events == 3


def test_reject_reasons_of_the_layout(spark, logs):
    logs("a/26031005.log", TEXT)
    load = parse_files(spark, Layout(logs.root), "s", LOADED_AT, form="fields")
    rejects = {r.line_number: (r.reason, r.directory_name) for r in load.rejects.collect()}
    assert rejects == {
        n: (reason, "a")
        for n, reason in ((3, "bad_level"), (4, "bad_duration"), (5, "level_out_of_range"), (6, "error_code_out_of_range"), (7, "bad_time"), (8, "bad_rows_affected"))
    }
    assert load.rejects.where("line_number = 3").first().record.startswith("2026-03-10 05:07:00.1\nlevel;many")
    inside = parse_files(spark, Layout(logs.root), "s", LOADED_AT, datetime(2026, 3, 10, 5, 6), datetime(2026, 3, 10, 5, 6, 30), form="fields")
    assert [r.line_number for r in inside.events.collect()] == [2] and inside.rejects.count() == 1
    with pytest.raises(ValueError, match="form"):
        parse_files(spark, Layout(logs.root), "s", LOADED_AT, form="other")
