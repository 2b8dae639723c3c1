"""File discovery, provenance, encodings and load stats."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.plans.ingest import ingest, load_stats, session_totals
from tidelog.plans.load import load_session
from tidelog.plans.sessions import loaded_session, session_list
from tidelog.schema import SESSION_SCHEMA
from tidelog.sources.files import Layout, date_stems, hour_stems, list_files, read_lines
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore

from .conftest import LOADED_AT

LINE = "00:01.5-1000,CALL,1,Usr={}\n"


def test_hour_and_date_globs():
    start, end = datetime(2026, 3, 10, 22, 30), datetime(2026, 3, 12, 1, 0)
    assert hour_stems(start, end) == ["26031022*", "26031023*", "260311*", "26031200*", "26031201*"]
    assert date_stems(datetime(2026, 3, 10, 22), datetime(2026, 3, 11, 1)) == ["260310*", "260311*"]
    assert Layout("/x").glob(hour_stems(datetime(2026, 3, 10, 5), datetime(2026, 3, 10, 5, 59))) == "{26031005*.log}"
    assert Layout("/x", parts=True).glob() == "{*.log,*.log.[0-9]*}"


def test_files_of_the_interval_only(spark, logs, load):
    for name in ("a/26031005.log", "a/26031006.log", "b/c/26031005.log", "b/26031005.txt", "26031005.log"):
        logs(name, LINE.format(name))
    result = load(logs, datetime(2026, 3, 10, 5), datetime(2026, 3, 10, 5, 59))
    got = sorted((r.directory_name, r.source_file, r.usr) for r in result.events.collect())
    assert got == [
        ("a", "26031005.log", "a/26031005.log"),
        ("b", "26031005.log", "b/c/26031005.log"),
        ("root", "26031005.log", "26031005.log"),
    ]


def test_directory_of_a_file_outside_the_root(spark):
    layout = Layout("/data/logs")
    paths = ["file:/data/logs/x/y/26031005.log", "s3a://host/data/logs/26031005.log", "file:///elsewhere/z/26031005.log"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(layout.directory_name(F.col("p"))).collect()]
    assert got == ["x", "root", "z"]


def test_names_with_spaces_plus_and_cyrillic(spark, logs, load):
    logs("Инфо база+1 (50%)/26031005.log", LINE.format("Вася"))
    row = load(logs).events.first()
    assert (row.directory_name, row.usr) == ("Инфо база+1 (50%)", "Вася")


def test_a_name_that_is_not_an_hour_goes_to_quarantine(logs, load):
    logs("a/26031005_1.log", LINE.format("x"))
    logs("a/26139905.log", LINE.format("x"))
    result = load(logs, datetime(2026, 3, 10, 5), datetime(2026, 3, 10, 6))
    assert result.events.count() == 0
    assert [(r.source_file, r.reason) for r in result.rejects.collect()] == [("26031005_1.log", "bad_file_name")]
    assert {r.reason for r in load(logs).rejects.collect()} == {"bad_file_name"}


def test_byte_order_mark_line_ends_and_missing_last_newline(logs, load):
    logs("a/26031005.log", b"\xef\xbb\xbf00:01.0-1,CALL,1,Usr=a\r\n00:02.0-1,CALL,1,Context='x\r\ny\rz'\r\n00:03.0-1,CALL,1,Usr=last")
    rows = load(logs).events.orderBy("line_number").collect()
    assert [(r.usr, r.context) for r in rows] == [("a", ""), ("", "x\ny\rz"), ("last", "")]


def test_encodings(logs, load):
    text = "00:01.0-1,CALL,1,Usr=Пользователь,Descr='два\nстроки ё'\n"
    logs("utf/26031005.log", text)
    logs("win/26031005.log", text.encode("cp1251"))
    logs("broken/26031005.log", ("00:01.0-1,CALL,1,Usr=ж\n" * 3).encode() + b"00:02.0-1,CALL,1,Usr=\xff\xfez\n")
    rows = {}
    for r in load(logs).events.collect():
        rows.setdefault(r.directory_name, []).append(r.usr)
    assert rows["utf"] == ["Пользователь"] and rows["win"] == ["Пользователь"]
    # Mostly valid UTF-8: a damaged line does not change the file's encoding.
    assert sorted(rows["broken"]) == sorted(["ж"] * 3 + ["\ufffd\ufffdz"])


def test_the_code_page_of_each_file_is_voted(logs, load):
    text = "00:01.0-1,CALL,1,Usr=Съешь ещё этих мягких,Descr='булок\nДА'\n"
    for name, codec in (("utf", "utf-8"), ("win", "cp1251"), ("dos", "cp866")):
        logs(f"{name}/26031005.log", (text * 3).encode(codec))
    logs("ascii/26031005.log", "00:01.0-1,CALL,1,Usr=plain\n")
    # More lines in UTF-8 than broken ones; and broken bytes that are no letters of either page.
    logs("mixed/26031005.log", text.encode() * 3 + text.encode("cp866"))
    logs("odd/26031005.log", b"00:01.0-1,CALL,1,Usr=\xb9\n")
    rows = {}
    for r in load(logs).events.collect():
        rows.setdefault(r.directory_name, []).append(r.usr)
    whole = "Съешь ещё этих мягких"
    assert rows["utf"] == rows["win"] == rows["dos"] == [whole] * 3 and rows["ascii"] == ["plain"]
    assert rows["mixed"].count(whole) == 3 and rows["odd"] == ["№"]
    assert set(load(logs, codepage="cp1251").events.where("directory_name = 'dos'").select("usr").first()) != {whole}


def test_forced_encodings(logs, load):
    logs("dos/26031005.log", "00:01.0-1,CALL,1,Usr=Юзер\n".encode("cp866"))
    assert load(logs, encoding="cp866").events.first().usr == "Юзер"
    assert load(logs, codepage="cp866").events.first().usr == "Юзер"
    assert "\ufffd" in load(logs, encoding="utf-8").events.first().usr


def test_load_stats_and_totals(spark, logs, load):
    logs("a/26031005.log", "junk\n" + LINE.format("x") + "more\n00:61.0-1,CALL,1,\n")
    logs("a/26031006.log", "only junk\n")
    logs("b/26031005.log", "")
    result = load(logs)
    files = list_files(spark, Layout(logs.root))
    gone = files.where("directory_name = 'a'").limit(1).select(
        F.lit("file:/gone/26031007.log").alias("file_path"), F.lit(10).cast("bigint").alias("file_size"),
        F.lit(-1).cast("bigint").alias("file_id"), F.lit("gone").alias("directory_name"), F.lit("26031007.log").alias("source_file"),
    )
    stats = load_stats(files.unionByName(gone), result.assembled.splits, result.parsed)
    got = {(r.directory_name, r.source_file): (r.lines, r.events, r.errors, r.status) for r in stats.collect()}
    assert got == {
        ("a", "26031005.log"): (4, 1, 1, "completed"),
        ("a", "26031006.log"): (1, 0, 0, "empty"),
        ("b", "26031005.log"): (0, 0, 0, "empty"),
        ("gone", "26031007.log"): (0, 0, 0, "deleted"),
    }
    totals = session_totals(stats).first()
    assert (totals.total_files, totals.processed_files, totals.total_events, totals.progress_percent) == (4, 3, 1, 75.0)
    start, end = datetime(2026, 3, 10, 5), datetime(2026, 3, 10, 6)
    session = loaded_session(stats, "s1", start, end, "2026-03-10 06:00:00", "2026-03-10 06:01:30.5")
    assert session.columns == SESSION_SCHEMA.fieldNames()
    shown = session_list(session, "2026-03-11 00:00:00").first()
    assert (shown.total_events, shown.elapsed_seconds, shown.start_date) == (1, 90.5, start)
    with pytest.raises(ValueError):
        loaded_session(stats, "s1", end, start, end, end)


def test_footprint_equals_the_files_on_disk(spark, logs, tmp_path):
    logs("a/26031005.log", LINE.format("x") * 300)
    logs("a/26031105.log", LINE.format("y") * 200)
    store = EventStore(spark, str(tmp_path / "store"))
    for name in ("s1", "s2"):
        ingest(spark, store, Layout(logs.root), name, LOADED_AT)
    sizes = {name: [f.stat().st_size for f in tmp_path.glob(f"store/version=*/session_id={name}/**/*.parquet")] for name in ("s1", "s2")}
    assert all(len(s) > 1 for s in sizes.values())
    want = {(n, len(s), sum(s), round(sum(s) / 1048576, 2)) for n, s in sizes.items()}
    assert {(r.session_id, r.n_files, r.n_bytes, r.size_mb) for r in store.footprint().collect()} == want
    files = store.events().select("session_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()
    read = files.groupBy("session_id").agg(F.count("*"), F.sum("bytes"))
    assert {tuple(r) for r in read.collect()} == {w[:3] for w in want}


def test_ingest_is_repeatable(spark, logs, tmp_path):
    logs("a/26031005.log", LINE.format("x") * 3)
    store = EventStore(spark, str(tmp_path / "store"))
    assert store.events("s1").count() == 0
    for _ in range(2):
        stats = ingest(spark, store, Layout(logs.root), "s1", LOADED_AT)
        assert [(r.events, r.status) for r in stats.collect()] == [(3, "completed")]
    ingest(spark, store, Layout(logs.root), "s 2/'x", LOADED_AT)
    assert store.events("s1").count() == 3 and store.events().count() == 6
    assert store.events("s 2/'x").count() == 3
    assert store.events("unknown").count() == 0
    assert {r.session_id for r in store.footprint().collect()} == {"s1", "s 2/'x"}
    assert store.delete_session("s 2/'x") and not store.delete_session("unknown")
    assert store.events().count() == 3
    assert store.expire(datetime(2026, 6, 8).date()) == []
    assert store.expire(datetime(2026, 6, 9).date()) == ["2026-03-10"]
    assert store.events().count() == 0


def test_missing_root_loads_nothing(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    assert ingest(spark, store, Layout(str(tmp_path / "nowhere")), "s1", LOADED_AT).count() == 0


def test_only_the_needed_columns_and_partitions_are_read(spark, logs, tmp_path):
    logs("a/26031005.log", LINE.format("x"))
    store = EventStore(spark, str(tmp_path / "store"))
    ingest(spark, store, Layout(logs.root), "s1", LOADED_AT)
    from tidelog.plans.analysis import slowest

    plan = slowest(store.events("s1"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_id" in plan
    assert "GreaterThan(duration_ms,1000.0)" in plan
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "planSQLText" not in slowest(store.events("s1"))._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_lines_keep_lone_carriage_returns(spark, logs):
    logs("a/26031005.log", b"one\rtwo\nthree")
    assert sorted(r.value for r in read_lines(spark, Layout(logs.root)).collect()) == ["one\rtwo", "three"]


@pytest.mark.parametrize("value", ["2024-02-30 00:00:00"])
def test_impossible_dates_are_null(spark, value):
    assert spark.range(1).select(F.lit(value).try_cast("timestamp_ntz")).first()[0] is None


def stored(store, session_id):
    return sorted(r.usr for r in store.events(session_id).collect())


def test_a_load_that_cannot_work_leaves_the_session(spark, logs, tmp_path):
    logs("a/26031005.log", LINE.format("x") + LINE.format("y"))
    store = EventStore(spark, str(tmp_path / "store"))
    ingest(spark, store, Layout(logs.root), "s1", LOADED_AT)
    before = stored(store, "s1")
    assert len(before) == 2
    assert ingest(spark, store, Layout(str(tmp_path / "nowhere")), "s1", LOADED_AT).count() == 0
    with pytest.raises(ValueError):
        ingest(spark, store, Layout(logs.root), "s1", LOADED_AT, datetime(2026, 3, 11), datetime(2026, 3, 10))
    with pytest.raises(Exception):
        store.replace_session("s1", store.events("s1").withColumn("usr", F.raise_error(F.lit("broken")).cast("string")))
    assert stored(store, "s1") == before


def test_a_session_is_replaced_by_part_of_itself(spark, logs, tmp_path):
    logs("a/26031005.log", LINE.format("x") + LINE.format("y"))
    logs("a/26031105.log", LINE.format("z"))
    store = EventStore(spark, str(tmp_path / "store"))
    ingest(spark, store, Layout(logs.root), "s[1]", LOADED_AT)
    ingest(spark, store, Layout(logs.root), "other", LOADED_AT)
    store.replace_session("s[1]", store.events("s[1]").where("usr = 'x'"))
    assert stored(store, "s[1]") == ["x"] and stored(store, "other") == ["x", "y", "z"]
    store.replace_session("s[1]", store.events("s[1]").where("usr = 'nobody'"))
    assert stored(store, "s[1]") == [] and len(stored(store, "other")) == 3


def test_only_hour_files_are_read(spark, logs, load):
    logs("a/26031005.log", LINE.format("x"))
    logs("a/26031005.log.1", LINE.format("y"))
    logs("a/26031005.log.bak", "junk")
    result = load(logs)
    assert [r.usr for r in result.events.collect()] == ["x"] and result.rejects.count() == 0
    assert list_files(spark, Layout(logs.root)).count() == 1


def test_unknown_encodings_are_refused(spark, logs, load):
    logs("a/26031005.log", LINE.format("x"))
    with pytest.raises(Exception, match="unknown encoding"):
        load(logs, encoding="koi8-r").events.collect()


def test_a_load_is_recorded(spark, logs, tmp_path):
    logs("a/26031005.log", LINE.format("x") + "00:61.0-1,CALL,1,\n")
    events, sessions = EventStore(spark, str(tmp_path / "store")), SessionStore(spark, str(tmp_path / "sessions"))
    assert sessions.sessions().count() == 0 and sessions.files().count() == 0
    hours = datetime(2026, 3, 10, 5), datetime(2026, 3, 10, 6)
    load_session(spark, events, sessions, Layout(logs.root), "s1", LOADED_AT, *hours, comment="first")
    row = sessions.sessions().first()
    assert (row.status, row.total_files, row.total_events, row.progress_percent, row.comment) == ("completed", 1, 1, 100.0, "first")
    assert [(r.session_id, r.lines, r.events, r.errors) for r in sessions.files().collect()] == [("s1", 2, 1, 1)]
    with pytest.raises(Exception, match="unknown encoding"):
        load_session(spark, events, sessions, Layout(logs.root), "s2", LOADED_AT, *hours, encoding="koi8-r")
    with pytest.raises(ValueError):
        load_session(spark, events, sessions, Layout(logs.root), "s3", LOADED_AT, *reversed(hours))
    assert {(r.session_id, r.status, r.error_message is None) for r in sessions.sessions().collect()} == {
        ("s1", "completed", True), ("s2", "failed", False)
    }
    assert events.events("s1").count() == 1
    assert sessions.delete("s1", events) and not sessions.delete("s1", events)
    assert sessions.files().count() == 0 and events.events().count() == 0 and sessions.sessions().count() == 1
    with pytest.raises(KeyError):
        sessions.fail("s1", "gone", LOADED_AT)
