from pathlib import Path

import pytest

from tidelog.plans.ingest import parse_files
from tidelog.session import build_session
from tidelog.sources.files import Layout

LOADED_AT = "2026-03-11 00:00:00"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tidelog-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def logs(tmp_path):
    """A folder for log files with a writer."""
    root = tmp_path / "logs"
    root.mkdir()

    def write(name: str, content: bytes | str) -> Path:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return path

    write.root = str(root)
    return write


@pytest.fixture
def load(spark):
    def run(logs, start=None, end=None, **options):
        return parse_files(spark, Layout(logs.root), "s1", LOADED_AT, start, end, **options)

    return run
