"""Following a folder of closed hours."""

import pytest

from tidelog.sources.files import Layout
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore
from tidelog.streaming.follow import follow

from .conftest import LOADED_AT


def test_each_run_loads_only_new_files(spark, logs, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    stats, sessions = str(tmp_path / "stats"), SessionStore(spark, str(tmp_path / "sessions"))

    def run():
        query = follow(
            spark, Layout(logs.root), store, "live", str(tmp_path / "state"), LOADED_AT, stats_path=stats, max_files=1,
            sessions=sessions,
        )
        query.awaitTermination()
        assert query.exception() is None

    lines = "".join(f"{i:02d}:00.0-1,CALL,1,Context='a\nb{i}'\n" for i in range(60))
    logs("a/26031005.log", lines)
    logs("b/26031005.log", lines + "00:61.0-1,CALL,1,")
    run()
    assert store.events().count() == 120
    assert {r.session_id for r in store.events().select("session_id").distinct().collect()} == {"live_0", "live_1"}
    logs("a/26031006.log", lines)
    run()
    run()
    assert store.events().count() == 180
    rows = spark.read.parquet(stats).orderBy("batch_id").collect()
    assert sorted((r.lines, r.events, r.errors) for r in rows) == [(120, 60, 0), (120, 60, 0), (121, 60, 1)]
    assert [r.batch_id for r in rows] == [0, 1, 2]
    assert {r.context for r in store.events("live_2").collect()} == {f"a\nb{i}" for i in range(60)}
    kept = sessions.sessions().orderBy("session_id").collect()
    assert [(r.session_id, r.status, r.total_files, r.total_events) for r in kept] == [(f"live_{i}", "completed", 1, 60) for i in range(3)]
    assert sessions.files().count() == 3


def test_parts_are_not_followed(spark, logs, tmp_path):
    with pytest.raises(ValueError, match="whole hour files"):
        follow(spark, Layout(logs.root, parts=True), EventStore(spark, str(tmp_path / "store")), "live", str(tmp_path / "state"), LOADED_AT)
