"""Record assembly: the Arrow step against a plain loop, and split independence."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.operators.assemble import MAX_RECORD_BYTES, assemble, to_pieces
from tidelog.operators import assemble as assemble_module
from tidelog.sources.files import Layout, read_lines

SCHEMA = pa.schema(
    [
        ("file_id", pa.int64()),
        ("part", pa.int64()),
        ("block_start", pa.int64()),
        ("is_header", pa.bool_()),
        ("file_path", pa.string()),
        ("bad", pa.bool_()),
        ("wide", pa.bool_()),
        ("raw", pa.binary()),
    ]
)

lines = st.lists(st.tuples(st.integers(0, 2), st.booleans(), st.booleans()), max_size=30)


def batches_of(rows, size):
    table = pa.Table.from_pylist(rows, SCHEMA)
    return table.to_batches(max_chunksize=size)


@given(st.lists(lines, max_size=4), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_pieces_match_a_plain_loop(splits, size):
    rows, expected = [], []
    for i, split in enumerate(splits):
        piece, number = None, 0
        for j, (width, header, bad) in enumerate(split):
            text = f"{i}.{j}".encode() + b"x" * width
            rows.append(
                dict(
                    file_id=i // 2,
                    part=0,
                    block_start=i,
                    is_header=header,
                    file_path=f"f{i // 2}" if header else None,
                    bad=bad,
                    wide=not bad,
                    raw=text,
                )
            )
            if header or piece is None:
                number += header
                piece = [i // 2, i, number, [], 0]
                expected.append(piece)
            piece[3].append(text)
            piece[4] += bad
    got = pa.Table.from_batches(list(to_pieces(iter(batches_of(rows, size)))) or [], None) if rows else None
    found = got.to_pylist() if got else []
    assert [(f["file_id"], f["block_start"], f["piece"], f["raw"], f["n_lines"], f["bad_lines"]) for f in found] == [
        (e[0], e[1], e[2], b"\n".join(e[3]), len(e[3]), e[4]) for e in expected
    ]
    last = [a["block_start"] != b["block_start"] for a, b in zip(found, found[1:])] + [True]
    assert [f["is_last"] for f in found] == last[: len(found)]


def content(n):
    """Records of one to three lines; some longer than a small split."""
    out = ["stray line before the first header"]
    for i in range(n):
        out.append(f"{i % 60:02d}:{i % 59:02d}.{i:06d}-{i},CALL,1,Descr=v{i}")
        out += [f"continued {i} " + "y" * (i % 7)] * (i % 3)
        if i % 50 == 7:
            out += ["long " + "z" * 900] * 12
    return "\n".join(out)


@pytest.mark.parametrize("split_bytes", [4096, 9000, 134217728])
def test_records_do_not_depend_on_split_size(spark, logs, split_bytes):
    text = content(400)
    logs("ib/26031005.log", text.replace("\n", "\r\n"))
    logs("ib2/26031005.log", text + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        result = assemble(spark, read_lines(spark, Layout(logs.root)))
        rows = result.records.orderBy("file_path", "event_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for line in text.split("\n")[1:]:
        if "," in line and line[2] == ":":
            want.append([line])
        else:
            want[-1].append(line)
    assert len(rows) == 2 * len(want)
    for half in (rows[: len(want)], rows[len(want) :]):
        assert [r.event_seq for r in half] == list(range(1, len(want) + 1))
        assert [r.record for r in half] == ["\n".join(w) for w in want]
        assert [r.n_lines for r in half] == [len(w) for w in want]
    if split_bytes == 4096:
        assert result.splits.count() > 4


def test_parts_of_a_split_hour_are_joined_in_order(spark, logs):
    logs("ib/26031005.log", "05:00.1-1,A,1,a=1\nmore\n")
    logs("ib/26031005.log.2", "tail of the first\n05:01.1-1,B,1,a=2\n")
    logs("ib/26031005.log.10", "05:02.1-1,C,1,a=3\nx\n")
    rows = assemble(spark, read_lines(spark, Layout(logs.root, parts=True))).records.orderBy("event_seq").collect()
    assert [(r.event_seq, r.record) for r in rows] == [
        (1, "05:00.1-1,A,1,a=1\nmore\ntail of the first"),
        (2, "05:01.1-1,B,1,a=2"),
        (3, "05:02.1-1,C,1,a=3\nx"),
    ]


def test_a_record_too_long_for_one_value_is_marked_not_collected(spark, logs, monkeypatch):
    assert MAX_RECORD_BYTES == 1 << 30
    monkeypatch.setattr(assemble_module, "MAX_RECORD_BYTES", 20_000)
    logs("ib/26031005.log", "05:00.1-1,A,1,a=1\n" + "q" * 99 + "\n" + ("w" * 99 + "\n") * 500 + "05:01.1-1,B,1,b=2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        rows = assemble(spark, read_lines(spark, Layout(logs.root))).records.orderBy("event_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    long = sorted((r for r in rows if r.event_seq == 1), key=lambda r: r.record_piece)
    assert len(long) > 4 and all(r.oversized and len(r.record) < 20_000 for r in long)
    assert [r.record_piece for r in long] == list(range(len(long))) and sum(r.n_lines for r in long) == 502
    assert "\n".join(r.record for r in long) == "05:00.1-1,A,1,a=1\n" + "q" * 99 + "\n" + "\n".join(["w" * 99] * 500)
    assert [(r.oversized, r.record_piece, r.n_lines) for r in rows if r.event_seq == 2] == [(False, 0, 1)]
