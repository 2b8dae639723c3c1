"""Files read by byte ranges, and files that cannot be read."""

import io
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.plans.ingest import ingest, load_stats, parse_files, parse_lines
from tidelog.plans.load import load_session
from tidelog.sources import ranges
from tidelog.sources.files import Layout, list_files
from tidelog.sources.session_store import SessionStore
from tidelog.sources.store import EventStore

from .conftest import LOADED_AT

CONTENT = b"\xef\xbb\xbf00:01.0-1,CALL,1,Usr=a\r\nmore\n\n00:02.0-1,CALL,1,Usr=b\n" + b"x" * 37 + b"\n00:03.0-5,EXCP,2,Usr=\xef"


class File(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("content", [CONTENT, CONTENT + b"\n", b"\n\n\n", b"one", b"one\n", b""])
def test_ranges_of_any_size_give_every_line_once(content, monkeypatch):
    want, at = [], 0
    for line in content.split(b"\n")[: -1 if content.endswith(b"\n") or not content else None]:
        want.append((at, line.removeprefix(b"\xef\xbb\xbf")))
        at += len(line) + 1
    firsts = [0] + [a for a, _ in want[1:3]]
    for read in (1, 3, 1 << 20):
        monkeypatch.setattr(ranges, "READ_BYTES", read)
        for first in firsts:
            for size in (1, 2, 7, 1000):
                got = []
                for start in range(first, len(content), size):
                    for lines, place in ranges._lines_of(File(content), first, start, min(len(content), start + size), len(content)):
                        for line in lines:
                            got.append((place, line))
                            place = content.find(b"\n", place) + 1
                assert got == [w for w in want if w[0] >= first], (read, first, size)


def test_ranges_load_what_a_plain_scan_loads(spark, logs):
    for hour in range(3):
        logs(f"a b/2603100{hour}.log", CONTENT * 5)
        logs(f"é+/2603100{hour}.log", "00:01.0-1,CALL,1,Usr='Иван'\n".encode("cp1251") * 40)
    logs("a b/26031005.log", b"")
    plain = parse_files(spark, Layout(logs.root), "s", LOADED_AT)
    rows = lambda load: sorted(map(str, load.parsed.drop("file_path").collect()))
    for size in (50, 1 << 20):
        lines = ranges.read_ranges(ranges.file_ranges(ranges.stored_files(spark, Layout(logs.root)), size))
        assert rows(parse_lines(spark, lines, Layout(logs.root), "s", LOADED_AT)) == rows(plain)


def forbidding(path):
    if "bad/26031001" in path:
        raise PermissionError(13, "Permission denied")
    if "gone/" in path:
        raise FileNotFoundError(2, "No such file")
    file = ranges.open_file(path)
    if "bad/26031002" not in path:
        return file

    class Broken:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            file.close()

        def read_at(self, n, at):
            if at:
                raise OSError(5, "Input/output error: bad block")
            return file.read_at(64, 0)

    return Broken()


def test_files_that_cannot_be_read_are_rows(spark, logs, tmp_path):
    good = "".join(f"00:{i:02d}.0-1,CALL,1,Usr=u{i}\n" for i in range(50))
    for name in ("good/26031001.log", "good/26031002.log", "bad/26031001.log", "bad/26031002.log", "gone/26031003.log"):
        logs(name, good)
    logs("good/26031003.log", "")
    store, sessions = EventStore(spark, str(tmp_path / "events")), SessionStore(spark, str(tmp_path / "sessions"))
    day = datetime(2026, 3, 10), datetime(2026, 3, 10, 23)
    stats = load_session(spark, store, sessions, Layout(logs.root), "s", LOADED_AT, *day, opener=forbidding)
    found = {(r.directory_name, r.source_file): (r.status, r.lines, r.events, r.errors) for r in stats.collect()}
    assert found == {
        ("good", "26031001.log"): ("completed", 50, 50, 0), ("good", "26031002.log"): ("completed", 50, 50, 0), ("good", "26031003.log"): ("empty", 0, 0, 0),
        ("bad", "26031001.log"): ("permission_error", 0, 0, 0), ("bad", "26031002.log"): ("error", 0, 0, 0), ("gone", "26031003.log"): ("deleted", 0, 0, 0),
    }
    said = {r.status: r.message for r in sessions.files().collect()}
    assert "Permission denied" in said["permission_error"] and "bad block" in said["error"] and said["completed"] is None
    assert {r[0] for r in store.events().select("directory_name").distinct().collect()} == {"good"} and store.events().count() == 100
    row = sessions.sessions().first()
    assert (row.status, row.total_files, row.processed_files, row.total_events) == ("completed", 6, 3, 100)


def test_a_folder_among_the_files(spark, logs, tmp_path):
    """Something that opens as no file at all, without any injected failure."""
    logs("a/26031001.log", "00:01.0-1,CALL,1,\n")
    link = tmp_path / "logs" / "a" / "26031002.log"
    link.symlink_to(tmp_path / "logs" / "a" / "target")
    (tmp_path / "logs" / "a" / "target").write_text("00:01.0-1,CALL,1,\n")
    stats = ingest(spark, EventStore(spark, str(tmp_path / "e")), Layout(logs.root), "s", LOADED_AT)
    assert sorted(r.events for r in stats.collect()) == [1, 1]


def test_the_first_problem_of_a_file_leaves_the_others(spark, logs):
    for hour in range(4):
        logs(f"a/2603100{hour}.log", "00:01.0-1,CALL,1,\n" * 300)

    def failing(path):
        if "26031002" in path:
            raise ValueError("corrupt: header\nof the file")
        return ranges.open_file(path)

    load = parse_files(spark, Layout(logs.root), "s", LOADED_AT, isolate=True, opener=failing)
    stats = load_stats(list_files(spark, Layout(logs.root)), load.assembled.splits, load.parsed)
    assert {r.source_file: (r.status, r.events) for r in stats.collect()} == {f"2603100{h}.log": (("error", 0) if h == 2 else ("completed", 300)) for h in range(4)}
    assert stats.where(F.col("message") == "corrupt: header\nof the file").count() == 1
