"""What the operators share: lineage cuts, bounded text slices, word tables, held-out rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import shared_dir

# Texts worked on at once in a task; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20
# The same where each word of a text takes a row of numbers.
WORD_SLICE_BYTES = 1 << 20
# Rows up to which a lookup side is hinted as a broadcast, and numbers in their
# lists: some 30 MB. The sides in question hold a few numbers or a list of them
# per row; beyond it Spark joins by a shuffle.
LOOKUP_ROWS, LOOKUP_VALUES = 200_000, 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def lookup(df: DataFrame, listed: str | None = None) -> DataFrame:
    """A side that was cut, hinted as a broadcast if its counted rows, and the values in its column ``listed`` of lists, are few."""
    if listed:
        rows, values = df.agg(F.count("*"), F.coalesce(F.sum(F.size(listed)), F.lit(0))).first()
        return F.broadcast(df) if rows <= LOOKUP_ROWS and values <= LOOKUP_VALUES else df
    return F.broadcast(df) if df.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else df


def held_out(doc_id: Column | str) -> Column:
    """Rows no model may learn from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """White-space separated words of texts (null: none): a code per word, the words before each text, the distinct words."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    filled = pc.not_equal(words, "")
    kept = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))[offsets - offsets[0]]
    coded = words.filter(filled).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), kept.astype(np.int64), coded.dictionary.to_pylist()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each text; an empty text has zero."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]
