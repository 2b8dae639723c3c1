"""Multi-line record assembly that never shuffles the text.

Records may cross the borders of file splits. The work is done in two parts:

1. ``to_pieces`` runs inside each scan task. Lines reach it in file order, so
   it can close every record that starts and ends in the same split without
   moving a byte. The first lines of a split that belong to a record opened
   earlier become piece 0; the last record of a split is marked, because it
   may go on in the next split.
2. ``number_records`` works on what is left: per split one row with its header
   count (their running sum per file gives every record its ordinal), and the
   two border pieces of each split, which are the only ones that are grouped.

The pieces are written once to the shared folder and read back, so the raw
files are read a single time and a lost executor does not start the scan over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.text import single_byte_text
from tidelog.session import BROADCAST_ROWS, scratch_path

# Fixed value: the header line of a record (a byte-order mark may precede it).
HEADER = r"^\uFEFF?\d{2}:\d{2}\.\d+-\d+,\s*[^,]+,\s*\d+,"

# A record is one string value; the JVM cannot hold one beyond 2 GiB. Longer
# ones stay in the pieces their file splits hold, which are all rejected.
MAX_RECORD_BYTES = 1 << 30

SPLIT_KEY = ("file_id", "part", "block_start")

# What the encoding of a file is voted by, and how earlier votes are called.
VOTES = {"bad_lines": "bad_before", "wide_lines": "wide_before", "win_bytes": "win_before", "dos_bytes": "dos_before"}

PIECE_SCHEMA = (
    "file_id bigint, part bigint, block_start bigint, piece bigint, is_last boolean, "
    "file_path string, n_lines bigint, bad_lines bigint, wide_lines bigint, n_bytes bigint, "
    "raw binary, at bigint, problem string, win_bytes bigint, dos_bytes bigint"
)

# Bytes that are Cyrillic letters in one code page and hardly ever
# anything in the other (0xE0 to 0xEF are letters in both).
ONLY_CP1251 = np.isin(np.arange(256), [*range(0xC0, 0xE0), *range(0xF0, 0x100)])
ONLY_CP866 = np.isin(np.arange(256), range(0x80, 0xB0))


@dataclass(frozen=True)
class Assembled:
    """``records``: one row per record. ``splits``: one row per file split. ``pieces``: its records before they are joined."""

    records: DataFrame
    splits: DataFrame
    pieces: DataFrame
    staged: tuple[str, ...]  # folders the frames read from


def marked_lines(lines: DataFrame, header: str = HEADER) -> DataFrame:
    """Flag header lines and lines that are not valid (or not plain) UTF-8.

    ``at`` (the byte a line begins at) and ``problem`` (why a file could not be
    read) are null for a source that does not give them.
    """
    value = F.when(F.col("value").endswith("\r"), F.rtrim(F.col("value"), F.lit("\r"))).otherwise(F.col("value"))
    is_header = value.rlike(header)
    given = lambda name, kind: (F.col(name) if name in lines.columns else F.lit(None)).cast(kind).alias(name)
    return lines.select(
        "file_id",
        "part",
        "block_start",
        is_header.alias("is_header"),
        F.when(is_header, F.col("file_path")).alias("file_path"),
        (~F.is_valid_utf8(value)).alias("bad"),
        (F.is_valid_utf8(value) & (F.length(value) != F.octet_length(value))).alias("wide"),
        value.cast("binary").alias("raw"),
        given("at", "bigint"),
        given("problem", "string"),
    )


def _joined(rows: pa.Table, starts: np.ndarray, numbers: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """One output row per piece; piece i runs from ``starts[i]`` to the next start."""
    bounds = np.append(starts, rows.num_rows)
    raw = pa.concat_arrays(rows.column("raw").chunks)
    lines = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), raw)
    text = pc.binary_join(lines, pa.scalar(b"\n", pa.binary()))
    firsts = rows.take(pa.array(starts))

    def total(flag: str) -> pa.Array:
        flags = rows.column(flag).to_numpy().astype(np.int64)
        return pa.array(np.add.reduceat(flags, starts))

    columns = {
        **{name: firsts.column(name) for name in SPLIT_KEY},
        "piece": pa.array(numbers, pa.int64()),
        "is_last": pa.array(last),
        "file_path": firsts.column("file_path"),
        "n_lines": pa.array(np.diff(bounds), pa.int64()),
        "bad_lines": total("bad"),
        "wide_lines": total("wide"),
        "n_bytes": pc.binary_length(text).cast(pa.int64()),
        "raw": text,
        "at": firsts.column("at") if "at" in rows.column_names else pa.nulls(len(starts), pa.int64()),
        "problem": _first_problems(rows, starts),
        "win_bytes": _letters(rows, raw, starts, ONLY_CP1251),
        "dos_bytes": _letters(rows, raw, starts, ONLY_CP866),
    }
    return pa.table(columns).combine_chunks().to_batches()[0]


def _letters(rows: pa.Table, raw: pa.Array, starts: np.ndarray, letters: np.ndarray) -> pa.Array:
    """Bytes of a code page's own letters per piece, in lines that are not UTF-8."""
    bad = np.flatnonzero(rows.column("bad").to_numpy())
    found = np.zeros(len(starts), np.int64)
    if len(bad):
        lines = raw.take(pa.array(bad)).cast(pa.binary())
        ends = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1)
        seen = np.concatenate(([0], np.cumsum(letters[np.frombuffer(lines.buffers()[2], np.uint8, ends[-1])])))
        np.add.at(found, np.searchsorted(starts, bad, side="right") - 1, np.diff(seen[ends]))
    return pa.array(found)


def _first_problems(rows: pa.Table, starts: np.ndarray) -> pa.Array:
    """The first problem among the lines of each piece; hardly ever there is one."""
    if "problem" not in rows.column_names or rows.column("problem").null_count == rows.num_rows:
        return pa.nulls(len(starts), pa.string())
    problems = rows.column("problem").combine_chunks()
    found: list[str | None] = [None] * len(starts)
    for line in np.flatnonzero(problems.is_valid().to_numpy(zero_copy_only=False))[::-1]:
        found[int(np.searchsorted(starts, line, side="right")) - 1] = problems[int(line)].as_py()
    return pa.array(found, pa.string())


def to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the lines of each record of a split with line feeds (Arrow only).

    Pieces are numbered by the headers of their split seen so far, so piece 0
    holds the lines above the first header.
    """
    held: list[pa.RecordBatch] = []  # rows of the piece that is still open
    number = 0  # its number
    seen = None  # split key of the last row

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.stack([batch.column(name).to_numpy() for name in SPLIT_KEY])
        header = batch.column("is_header").to_numpy(zero_copy_only=False)
        shifted = np.concatenate([keys[:, :1] if seen is None else seen, keys[:, :-1]], axis=1)
        fresh = (keys != shifted).any(axis=0)
        fresh[0] |= seen is None
        seen = keys[:, -1:]

        cuts = np.flatnonzero(fresh | header)
        if len(cuts) == 0:
            held.append(batch)
            continue
        headers = number + np.cumsum(header)
        at_split_start = np.where(fresh, headers - header, 0)
        numbers = headers - np.maximum.accumulate(at_split_start)

        n_held = sum(rows.num_rows for rows in held)
        starts = cuts + n_held
        piece_numbers = numbers[cuts]
        ends_split = fresh[cuts]
        if n_held:
            starts = np.insert(starts, 0, 0)
            piece_numbers = np.insert(piece_numbers, 0, number)
            ends_split = np.insert(ends_split, 0, False)
        if len(starts) > 1:
            rows = pa.Table.from_batches([*held, batch]).slice(0, int(starts[-1]))
            yield _joined(rows, starts[:-1], piece_numbers[:-1], ends_split[1:])
        held = [batch.slice(int(cuts[-1]))]
        number = int(numbers[-1])

    if held:
        rows = pa.Table.from_batches(held)
        yield _joined(rows, np.array([0]), np.array([number]), np.array([True]))


def text_of(raw: Column, codepage: Column) -> Column:
    """Valid text of raw bytes: UTF-8 with U+FFFD for broken bytes, or a code page."""
    unknown = F.raise_error(F.concat(F.lit("unknown encoding: "), codepage)).cast("string")
    return (
        F.when(codepage == "cp1251", single_byte_text(raw, "cp1251"))
        .when(codepage == "cp866", single_byte_text(raw, "cp866"))
        .when(codepage == "utf-8", F.make_valid_utf8(raw.cast("string")))
        .otherwise(unknown)
    )


def split_table(
    pieces: DataFrame, encoding: str, codepage: str, facts: dict[str, Column] | None = None, votes: DataFrame | None = None
) -> DataFrame:
    """Per split: header count, ordinal offset, line count, and file encoding.

    ``facts`` are columns computed from ``file_path``, once per split here
    rather than once per record later.

    The encoding is a vote of the file's non-ASCII lines: more of them broken
    than valid as UTF-8 means the file is in a single-byte code page: the given
    one, or with ``auto`` the one whose own letters are more bytes of the broken
    lines (cp1251 if equal). ``votes`` (``file_id`` and the columns of ``VOTES``)
    are those of lines read in an earlier run. ``last_at`` is where the last record of a split begins.
    """
    per_split = pieces.groupBy(*SPLIT_KEY).agg(
        F.max("piece").alias("n_headers"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("bad_lines").alias("bad_lines"),
        F.sum("wide_lines").alias("wide_lines"),
        F.min("file_path").alias("low_path"),
        F.max("file_path").alias("high_path"),
        F.max(F.when(F.col("piece") > 0, F.col("at"))).alias("last_at"),
        F.min("problem").alias("problem"),
        F.sum("win_bytes").alias("win_bytes"),
        F.sum("dos_bytes").alias("dos_bytes"),
    )
    if votes is not None:
        per_split = per_split.join(votes, "file_id", "left")
    earlier = lambda name: F.coalesce(F.max(name).over(whole), F.lit(0)) if votes is not None else F.lit(0)
    whole = Window.partitionBy("file_id")
    before = whole.orderBy("part", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    if encoding == "auto":
        bad, wide, win, dos = (F.sum(column).over(whole) + earlier(before) for column, before in VOTES.items())
        page = F.when(dos > win, "cp866").otherwise("cp1251") if codepage == "auto" else F.lit(codepage)
        chosen = F.when(bad > wide, page).otherwise("utf-8")
    else:
        chosen = F.lit(encoding)
    low, high = F.min("low_path").over(whole), F.max("high_path").over(whole)
    clash = F.raise_error(F.concat(F.lit("two files share one id: "), low, F.lit(", "), high))
    return per_split.select(
        *SPLIT_KEY,
        "n_headers",
        F.coalesce(F.sum("n_headers").over(before), F.lit(0)).alias("offset"),
        "n_lines",
        chosen.alias("encoding"),
        F.when(low != high, clash).otherwise(low).alias("file_path"),
        "last_at",
        F.min("problem").over(whole).alias("problem"),
    ).withColumns(facts or {})


def assemble(
    spark: SparkSession,
    lines: DataFrame,
    header: str = HEADER,
    encoding: str = "auto",
    codepage: str = "auto",
    facts: dict[str, Column] | None = None,
    votes: DataFrame | None = None,
) -> Assembled:
    """Records of the journal files in ``lines``.

    ``lines`` has ``file_id, part, block_start, file_path, value`` in file order
    within each split. A record row has ``file_id, file_path``, the facts,
    ``event_seq`` (ordinal in its file, from 1), ``n_lines``, ``record``,
    ``oversized`` and ``record_piece``. A record too long for one value has a
    row for each of its pieces, numbered from 0; together they hold its text. A
    file with a ``problem`` has no records.
    """
    pieces_path = scratch_path(spark, "pieces")
    marked_lines(lines, header).mapInArrow(to_pieces, PIECE_SCHEMA).write.option(
        "compression", "zstd"
    ).parquet(pieces_path)
    pieces = spark.read.parquet(pieces_path)

    splits_path = scratch_path(spark, "splits")
    split_table(pieces, encoding, codepage, facts, votes).write.parquet(splits_path)
    splits = spark.read.parquet(splits_path)

    records = number_records(pieces, splits, list(facts or {}))
    return Assembled(records, splits, pieces, (pieces_path, splits_path))


def number_records(pieces: DataFrame, splits: DataFrame, facts: list[str]) -> DataFrame:
    """Give every piece its ordinal and merge the pieces at split borders."""
    lookup = splits.where(F.col("problem").isNull()).select(*SPLIT_KEY, "offset", "encoding", "file_path", *facts)
    if splits.count() <= BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    about_file = ["file_id", "file_path", *facts]
    numbered = pieces.drop("file_path").join(lookup, list(SPLIT_KEY)).select(
        *about_file,
        (F.col("offset") + F.col("piece")).alias("event_seq"),
        "part",
        "block_start",
        "piece",
        "is_last",
        "n_lines",
        "n_bytes",
        "encoding",
        "raw",
    )
    at_border = (F.col("piece") == 0) | F.col("is_last")
    inner = numbered.where(~at_border).select(
        *about_file,
        "event_seq",
        "n_lines",
        text_of(F.col("raw"), F.col("encoding")).alias("record"),
        F.lit(False).alias("oversized"),
        F.lit(0).alias("record_piece"),
    )
    # Ordinal 0: lines above the first header of a file, which have no record.
    border = numbered.where(at_border & (F.col("event_seq") > 0))
    key = [*about_file, "event_seq"]
    too_long = (
        border.groupBy("file_id", "event_seq")
        .agg(F.sum("n_bytes").alias("total"))
        .where(F.col("total") > MAX_RECORD_BYTES)
        .select("file_id", "event_seq", F.lit(True).alias("oversized"))
    )
    marked = (
        border.join(too_long, ["file_id", "event_seq"], "left")
        .withColumn("oversized", F.coalesce("oversized", F.lit(False)))
        .withColumn("record", text_of(F.col("raw"), F.col("encoding")))
    )
    in_file_order = Window.partitionBy("file_id", "event_seq").orderBy("part", "block_start", "piece")
    apart = marked.where("oversized").select(
        *key, "n_lines", "record", "oversized", (F.row_number().over(in_file_order) - 1).alias("record_piece")
    )
    merged = (
        marked.where(~F.col("oversized"))
        .groupBy(*key)
        .agg(
            F.sum("n_lines").alias("n_lines"),
            F.array_sort(
                F.collect_list(F.struct("part", "block_start", "piece", "record"))
            ).alias("found"),
        )
        .select(
            *key,
            "n_lines",
            F.array_join(F.col("found.record"), "\n").alias("record"),
            F.lit(False).alias("oversized"),
            F.lit(0).alias("record_piece"),
        )
    )
    return inner.unionByName(merged).unionByName(apart)
