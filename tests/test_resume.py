"""Files that grow between runs."""

import random

import pytest

from tidelog.plans.ingest import parse_files
from tidelog.sources import ranges
from tidelog.sources.files import Layout
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore
from tidelog.streaming.resume import Ledger, resume

from .conftest import LOADED_AT

CLOSED = "2026-03-11 00:00:00"


def content(n, codec="utf-8"):
    lines = [f"{i // 60 % 60:02d}:{i % 60:02d}.{i:06d}-{i},CALL,1,Usr='Иван {i}',Context='a\nb {i}\n\nстрока'\r\n" for i in range(n)]
    return ("junk above\n" + "".join(lines)).encode(codec)


def rows(df):
    return sorted(map(str, df.drop("session_id", "loaded_at").collect()))


@pytest.fixture
def start(spark, logs, tmp_path):
    store, ledger = EventStore(spark, str(tmp_path / "store")), Ledger(spark, str(tmp_path / "ledger"))

    def run(closed_before=None, **options):
        return {r.source_file: r for r in resume(spark, Layout(logs.root), store, ledger, "live", LOADED_AT, closed_before, **options).collect()}

    return run, store, ledger


def test_growing_files_give_each_event_once(spark, logs, start, tmp_path):
    run, store, _ = start
    sessions = SessionStore(spark, str(tmp_path / "sessions"))
    files = {"a/26031005.log": content(60), "b c/26031005.log": content(40, "cp1251"), "b c/26031006.log": content(25), "d/26031007.log": b"", "e/26031008.log": content(30, "cp866")}
    draw = random.Random(3)
    cuts = {name: [*sorted(draw.sample(range(1, len(data)), 3)), len(data)] if data else [0] * 4 for name, data in files.items()}
    # One cut inside a header, one inside a character.
    cuts["a/26031005.log"][1] = files["a/26031005.log"].index("00:31.".encode()) + 4
    cuts["b c/26031006.log"][0] = files["b c/26031006.log"].index("Иван 7".encode()) + 1
    cuts = {name: sorted(c) for name, c in cuts.items()}
    seen = 0
    for step in range(4):
        for name, data in files.items():
            logs(name, data[: cuts[name][step]])
        run(CLOSED if step == 3 else None, sessions=sessions)
        before, seen = seen, store.events().count()
        assert seen >= before
    want = parse_files(spark, Layout(logs.root), "live", LOADED_AT).events
    assert want.count() == 155 and rows(store.events()) == rows(want)
    assert run(CLOSED) == {}
    kept = sessions.sessions().collect()
    assert sum(r.total_events for r in kept) == 155 and {r.status for r in kept} == {"completed"}


def test_the_open_record_waits_for_its_end(logs, start):
    run, store, ledger = start
    logs("a/26031005.log", "00:01.0-1,CALL,1,Context='one\n")
    assert run()["26031005.log"].events == 0 and store.events().count() == 0
    logs("a/26031005.log", "00:01.0-1,CALL,1,Context='one\ntwo'\n00:02.0-2,CALL,1,Usr=u")
    assert run()["26031005.log"].events == 1
    assert run() == {} and ledger.runs() == [0, 1]
    logs("a/26031005.log", "00:01.0-1,CALL,1,Context='one\ntwo'\n00:02.0-2,CALL,1,Usr=user\n")
    assert run()["26031005.log"].events == 0
    run(CLOSED)
    assert [(r.line_number, r.context, r.usr) for r in store.events().orderBy("line_number").collect()] == [(1, "one\ntwo", ""), (2, "", "user")]
    logs("a/26031005.log", "00:01.0-1,CALL,1,Context='one\ntwo'\n00:02.0-2,CALL,1,Usr=user\n00:03.0-2,CALL,1,\n")
    assert run(CLOSED) == {}  # a closed file is not looked into again


def test_only_new_bytes_are_read(logs, start):
    run, _, ledger = start
    logs("a/26031005.log", content(50))
    run()
    offset = ledger.rows().first().offset
    assert offset == content(50).rindex(b"00:49.")
    logs("a/26031005.log", content(52))

    def watched(path):
        file = ranges.open_file(path)

        class Watched:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

            def read_at(self, n, at):
                assert at >= offset
                return file.read_at(n, at)

        return Watched()

    assert run(opener=watched)["26031005.log"].events == 2


@pytest.mark.parametrize("broken", ["replace_session", "write"])
def test_a_run_that_breaks_off_is_done_again(spark, logs, start, monkeypatch, broken):
    run, store, ledger = start
    logs("a/26031005.log", content(20))
    run()

    def stop(*_, **__):
        raise RuntimeError("stopped")

    logs("a/26031005.log", content(30))
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(store if broken == "replace_session" else ledger, broken, stop)
        run()
    logs("a/26031005.log", content(45))
    run(CLOSED)
    assert rows(store.events()) == rows(parse_files(spark, Layout(logs.root), "live", LOADED_AT).events)


def test_files_that_fail_keep_their_place(spark, logs, start):
    run, store, _ = start
    logs("a/26031005.log", content(20))
    logs("a/26031006.log", content(20))
    run()

    def forbidding(path):
        if "26031006" in path:
            raise PermissionError(13, "Permission denied")
        return ranges.open_file(path)

    logs("a/26031005.log", content(30))
    logs("a/26031006.log", content(30))
    stats = run(opener=forbidding)
    assert {n: (r.status, r.events) for n, r in stats.items()} == {"26031005.log": ("completed", 10), "26031006.log": ("permission_error", 0)}
    assert run()["26031006.log"].events == 10  # unchanged since, but not yet loaded
    logs("a/26031005.log", content(3))
    shrunk = run()["26031005.log"]
    assert (shrunk.status, shrunk.events) == ("error", 0) and "shorter" in shrunk.message
    assert store.events().count() == 58


def test_nothing_to_load(spark, tmp_path, start):
    run, store, ledger = start
    assert run() == {} and ledger.runs() == []
    with pytest.raises(ValueError, match="whole hour files"):
        resume(spark, Layout("x", parts=True), store, ledger, "live", LOADED_AT)
