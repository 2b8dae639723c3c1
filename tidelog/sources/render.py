"""Events written back as journal text: the inverse of the parser."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import PROPERTY_COLUMNS

FILE_KEY = ["directory_name", "source_file", "line_number"]


def quoted(value: Column) -> Column:
    """Quote a value that needs it, with the quote that needs less doubling."""
    double = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    special = value.rlike(r"[,'\"\n\r]|^\s|\s$")
    return F.when(~special, value).when(value.contains("'"), double).otherwise(single)


def record_text(clock: Column | None = None) -> Column:
    """``mm:ss.ffffff-duration,NAME,level,key=value,...`` of an event row."""
    if clock is None:
        clock = clock_text(F.col("timestamp"))
    listed = [
        F.when(F.col(name) != "", F.concat(F.lit(f"{key}="), quoted(F.col(name))))
        for key, name in PROPERTY_COLUMNS.items()
    ]
    return F.concat(
        clock,
        F.lit("-"),
        F.col("duration_us"),
        F.lit(","),
        F.col("event_name"),
        F.lit(","),
        F.col("level"),
        F.lit(","),
        F.concat_ws(",", *listed),
    )


def clock_text(ts: Column) -> Column:
    s = ts.cast("string")
    fraction = F.rpad(F.substring(s, 21, 6), 6, "0")
    return F.concat(F.substring(s, 15, 5), F.lit("."), fraction)


def alternative_text(fields: dict[str, Column]) -> Column:
    """A time line and one ``field;"value"`` line per field."""
    s = F.col("timestamp").cast("string")
    stamp = F.concat(F.substring(s, 1, 19), F.lit("."), F.rpad(F.substring(s, 21, 6), 6, "0"))
    lines = [F.concat(F.lit(f'{name};"'), value.cast("string"), F.lit('"')) for name, value in fields.items()]
    return F.concat_ws("\n", stamp, *lines)


def write_files(events: DataFrame, text: Column, root: str, whole_hours: bool = False) -> DataFrame:
    """Write hour files ``<root>/<directory_name>/<source_file>``; returns them.

    Range partitioning by file and ordinal spreads a large hour over several
    tasks. The task that holds the first record of an hour writes the file
    itself, a later one writes ``<source_file>.<first ordinal>``, so names give
    the order and a repeated task replaces its own files. ``whole_hours`` keeps
    each hour in one task and file instead.
    """
    rows = (
        events.withColumn("text", text.cast("binary"))
        .select(*FILE_KEY, "text")
        .repartitionByRange(*(FILE_KEY[:2] if whole_hours else FILE_KEY))
        .sortWithinPartitions(*FILE_KEY)
    )
    return rows.mapInArrow(_file_writer(root), "path string, n_records bigint")


def _file_writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        current, path, hidden, sink, count = None, "", "", None, 0
        done: list[tuple[str, int]] = []

        def finish():
            if sink is not None:
                sink.close()
                fs.move(hidden, path)
                done.append((path, count))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).dictionary_encode().indices.to_numpy() for c in FILE_KEY[:2]]
            fresh = np.concatenate(([True], np.any([np.diff(k) != 0 for k in keys], axis=0)))
            starts = np.append(np.flatnonzero(fresh), batch.num_rows)
            runs = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), batch.column("text"))
            texts = pc.binary_join(runs, pa.scalar(b"\n", pa.binary()))
            for i, (start, stop) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                folder, name, first = (batch.column(c)[start].as_py() for c in FILE_KEY)
                if (folder, name) != current:
                    finish()
                    current, count = (folder, name), 0
                    full = name if first == 1 else f"{name}.{first}"
                    path, hidden = f"{base}/{folder}/{full}", f"{base}/{folder}/_{uuid.uuid4().hex}"
                    fs.create_dir(f"{base}/{folder}", recursive=True)
                    sink = fs.open_output_stream(hidden)
                sink.write(texts[i].as_py() + b"\n")
                count += stop - start
        finish()
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([p for p, _ in done], pa.string()),
                "n_records": pa.array([n for _, n in done], pa.int64()),
            }
        )

    return write
