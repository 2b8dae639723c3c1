"""Journal files read by byte ranges: from any position on, and with a file's failure as a row instead of an end of the load."""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.files import Layout, local_path, short_scheme

# Bytes of a file one task reads at a time, and those of one read.
RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20

LINE_SCHEMA = "file_id bigint, part bigint, block_start bigint, file_path string, value binary, at bigint, problem string"
PROBLEMS = ("permission_error", "deleted", "error")

Opener = Callable[[str], pa.NativeFile]


def open_file(path: str) -> pa.NativeFile:
    """A journal file for reads at any position; ``path`` is a URI or a local path."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(path.removeprefix("file:"))
    system, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return system.open_input_file(place)


def stored_files(spark: SparkSession, layout: Layout, stems: list[str] | None = None) -> DataFrame:
    """One row per file on disk: ``path, file_path`` (its hour file), ``file_id, part, file_size``; empty files too."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", layout.glob(stems))
        .load(layout.root)
    )
    # A scan skips files of zero bytes, so the names come from the file index.
    names = spark.createDataFrame([(uri,) for uri in listing.inputFiles()], "uri string")
    sizes = listing.select(short_scheme(local_path(F.col("_metadata.file_path"))).alias("path"), "length")
    found = names.select(short_scheme(local_path(F.col("uri"))).alias("path")).join(sizes, "path", "left")
    key = layout.file_key(F.col("path"))
    return found.select(
        "path", key.alias("file_path"), F.xxhash64(key).alias("file_id"), layout.part(F.col("path")).alias("part"),
        F.coalesce("length", F.lit(0)).alias("file_size"),
    )


def file_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The bytes of ``files`` from ``offset`` (0 if there is no such column) to ``file_size``, in ranges of bounded size."""
    first = F.col("offset") if "offset" in files.columns else F.lit(0).cast("bigint")
    rows = files.withColumn("first", first).where(F.col("file_size") > F.col("first"))
    starts = F.sequence(F.col("first"), F.col("file_size") - 1, F.lit(range_bytes).cast("bigint"))
    return rows.select("path", "file_path", "file_id", "part", "first", F.col("file_size").alias("end"), F.explode(starts).alias("start")).withColumn(
        "stop", F.least(F.col("start") + range_bytes, F.col("end"))
    )


def _lines_of(file: pa.NativeFile, first: int, start: int, stop: int, end: int) -> Iterator[tuple[list[bytes], int]]:
    """The lines that begin in ``[start, stop)``, several at a time, with the byte the first of them begins at.

    A line belongs to the range it begins in, so a range reads on to the end of
    its last line and leaves out the end of a line that began before. ``first``
    is the beginning of a line. A byte-order mark at the start of a file is no text.
    """
    at, held = start, b""
    if start > first:
        at -= 1
        while at < end:
            data = file.read_at(min(READ_BYTES, end - at), at)
            if not data:
                return
            found = data.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(data)
    read = at
    while at < stop:
        data = file.read_at(min(READ_BYTES, end - read), read) if read < end else b""
        read += len(data)
        if not data:
            if held:
                yield [held], at
            return
        *lines, held = (held + data).split(b"\n")
        # Lines that begin at ``stop`` or later are the next range's.
        kept, place = [], at
        for line in lines:
            if place >= stop:
                break
            kept.append(line)
            place += len(line) + 1
        if kept and at == 0 and kept[0].startswith(codecs.BOM_UTF8):
            yield [kept[0].removeprefix(codecs.BOM_UTF8)], 0
            at = len(kept.pop(0)) + 1
        if kept:
            yield kept, at
        at = place


def read_ranges(ranges: DataFrame, opener: Opener = open_file) -> DataFrame:
    """The lines of the ranges with the byte each begins at, as ``assemble`` takes them.

    What cannot be opened or read gives a row with a ``problem`` instead:
    ``permission_error``, ``deleted`` or ``error``, a colon and the message. The
    other files go on.
    """

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                about = [row["file_id"], row["part"], row["start"], row["file_path"]]
                try:
                    with opener(row["path"]) as file:
                        for lines, at in _lines_of(file, row["first"], row["start"], row["stop"], row["end"]):
                            yield _batch(about, lines, at)
                except Exception as problem:  # noqa: BLE001
                    kinds = {PermissionError: "permission_error", FileNotFoundError: "deleted"}
                    yield _batch(about, [b""], row["start"], f"{kinds.get(type(problem), 'error')}: {problem}"[:1000])

    # Ranges in order of their files: a task's lines of one range follow each other.
    spread = ranges.repartition(max(1, min(ranges.count(), 4 * ranges.sparkSession.sparkContext.defaultParallelism)), "file_id", "start")
    lines = spread.mapInArrow(scan, LINE_SCHEMA)
    return lines.withColumn("value", F.col("value").cast("string"))


def _batch(about: list, lines: list[bytes], at: int, problem: str | None = None) -> pa.RecordBatch:
    values = pa.array(lines, pa.binary())
    sizes = pc.add(pc.binary_length(values).cast(pa.int64()), 1)
    begins = pc.add(pc.subtract(pc.cumulative_sum(sizes), sizes), at)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    fixed = [pa.repeat(pa.scalar(value, kind), len(lines)) for value, kind in zip(about, kinds)]
    return pa.RecordBatch.from_arrays(
        [*fixed, values, begins, pa.array([problem] * len(lines), pa.string())],
        ["file_id", "part", "block_start", "file_path", "value", "at", "problem"],
    )
