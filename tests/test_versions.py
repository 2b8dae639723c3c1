"""What readers see while a store changes, and deletions that break off."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidelog.plans.load import load_session
from tidelog.session import create_text, read_text
from tidelog.sources import session_store as module
from tidelog.sources.files import Layout
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore, footprint

from .conftest import LOADED_AT

LINE = "00:0{0}.0-1,CALL,1,Usr=u{0}\n"
HOURS = datetime(2026, 3, 10), datetime(2026, 3, 12)


@pytest.fixture
def stores(spark, logs, tmp_path):
    logs("a/26031005.log", "".join(LINE.format(i) for i in range(5)))
    logs("a/26031105.log", "".join(LINE.format(i) for i in range(3)))
    events, sessions = EventStore(spark, str(tmp_path / "events")), SessionStore(spark, str(tmp_path / "sessions"))
    for name in ("s1", "s 2/é"):
        load_session(spark, events, sessions, Layout(logs.root), name, LOADED_AT, *HOURS)
    return events, sessions


def count(store, session_id="s1"):
    return store.events(session_id).count()


def test_readers_see_the_old_or_the_new_rows(stores, monkeypatch):
    events, _ = stores
    seen, write, change = [], events._write, events._change
    early = events.events("s1")

    def written(*args):
        found = write(*args)
        seen.append(count(events))  # written, but not committed
        return found

    def changed(after):
        seen.append(count(events))
        found = change(after)
        seen.append(count(events))
        return found

    monkeypatch.setattr(events, "_write", written)
    monkeypatch.setattr(events, "_change", changed)
    events.replace_session("s1", events.events("s1").where("usr = 'u1'"))
    assert seen == [8, 8, 2]
    # A reader from before goes on with the old rows, until they are cleaned away.
    assert early.count() == 8 and count(events, "s 2/é") == 8
    assert events.clean() == 2 and events.clean() == 0
    assert count(events) == 2 and count(events, "s 2/é") == 8


def test_a_write_that_fails_leaves_no_rows(stores):
    events, _ = stores
    with pytest.raises(Exception, match="broken"):
        events.write(events.events("s1").withColumn("usr", F.when(F.col("usr") == "u2", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("usr"))))
    assert events.events().count() == 16
    events.clean()
    assert events.events().count() == 16


def test_writers_at_the_same_time_lose_nothing(spark, stores, monkeypatch):
    events, _ = stores
    other, change, rows = EventStore(spark, events.path), events._change, events.events("s1").where("usr = 'u0'")

    def late(after):
        other.delete_session("s 2/é")  # commits first

        def again(live):
            if not raced:
                raced.append(other.replace_session("s3", rows))  # and once more between reading and committing
            return after(live)

        raced = []
        return change(again)

    monkeypatch.setattr(events, "_change", late)
    events.replace_session("s1", rows)
    assert {r.session_id: r.n for r in events.events().groupBy("session_id").agg(F.count("*").alias("n")).collect()} == {"s1": 2, "s3": 2}


def test_expired_dates_and_partitions(spark, stores):
    events, _ = stores
    assert events.expire(date(2026, 6, 9)) == ["2026-03-10"]
    assert (count(events), count(events, "s 2/é")) == (3, 3)
    events.write(events.events("s1").withColumn("usr", F.lit("v")))
    assert {r.usr for r in events.events("s1").collect()} == {"v"} and count(events, "s 2/é") == 3
    live = {r.session_id: r.n_files for r in events.footprint().collect()}
    events.clean()
    kept = {r.session_id: r.n_files for r in footprint(spark, events.path).collect()}
    assert live == kept and set(live) == {"s1", "s 2/é"}


@pytest.mark.parametrize("step", range(5))
def test_a_deletion_that_breaks_off_is_ended(spark, stores, monkeypatch, step):
    events, sessions = stores

    class Stopped(Exception):
        pass

    calls = []

    def counted(real):
        def call(*args):
            if len(calls) == step:
                raise Stopped
            calls.append(real)
            return real(*args)

        return call

    with monkeypatch.context() as patch:
        patch.setattr(module, "drop_path", counted(module.drop_path))
        patch.setattr(EventStore, "delete_session", counted(EventStore.delete_session))
        try:
            sessions.delete("s 2/é", events)
            assert step > 3
        except Stopped:
            assert step <= 3
    # Not shown by the store it broke off in, nor by one opened later, which ends it.
    assert [r.session_id for r in sessions.sessions().collect()] == ["s1"] == [r.session_id for r in sessions.files().select("session_id").distinct().collect()]
    later = SessionStore(spark, sessions.path)
    assert count(events, "s 2/é") == 0 and count(events) == 8
    assert later.recover() == [] and later._folders("files", "s 2/é") == later._folders("sessions", "s 2/é") == []
    assert later.sessions().count() == 1


def test_small_files_are_made_once(spark, tmp_path):
    path = f"{tmp_path}/x/1.json"
    assert create_text(spark, path, "é") and not create_text(spark, path, "b")
    assert read_text(spark, path) == "é"
