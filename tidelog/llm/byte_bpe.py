"""Byte-level BPE of texts of any length: chunks are pre-tokenised apart and stitched where they agree."""

from __future__ import annotations

import base64
import os
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import cut, slices

# Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 9
# A match may look at up to three characters behind its end ("'re" and the like).
LOOKAHEAD = 4


class Codec:
    """A rank file and the pattern that splits texts before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def starts(self, text: str) -> np.ndarray:
        """Places where a match of the pattern starts."""
        return np.fromiter((m.start() for m in self.pattern.finditer(text)), np.int64)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file, made once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _encode_rows(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``ids`` in place of ``text``; the first column is kept."""
    key = rows.columns[0]

    def run(batches):
        for part in slices(batches, "text"):
            ids = [codec(path, pattern).encode(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(ids, pa.binary())], [key, "ids"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids binary")


def _encode_long(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``doc_id, ids`` of texts longer than a chunk.

    Every chunk reaches into the next one. The matches of the pattern from a
    place on depend only on the text from there on, so where a start found in
    the end of one chunk is also a start in the next chunk, the next chunk's
    matches are right from there on; the piece between two such places is
    encoded by itself. A text in which two chunks agree nowhere (one match
    longer than the overlap) is encoded whole.
    """

    def split(batches):
        for part in slices(batches, "text"):
            for row, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                count = -(-len(text) // chunk)
                for k in range(count):
                    piece = text[k * chunk : (k + 1) * chunk + overlap]
                    columns = [pa.array([row], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([k], pa.int64()), pa.array([k == count - 1]), pa.array([piece])]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "k", "last", "text"])

    def pretokenise(batches):
        for part in slices(batches, "text"):
            heads, tails = [], []
            for text in part.column("text").to_pylist():
                starts = codec(path, pattern).starts(text)
                heads.append(starts[starts < overlap].tolist())
                tails.append((starts[(starts >= chunk) & (starts <= len(text) - LOOKAHEAD)] - chunk).tolist())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), part.column("last"), *lists], ["row", "k", "last", "head", "tail"])

    def encode(batches):
        for part in slices(batches, "text"):
            pieces = zip(*(part.column(c).to_pylist() for c in ("text", "start", "stop")))
            ids = [codec(path, pattern).encode(text[start:stop]) for text, start, stop in pieces]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "k")), pa.array(ids, pa.binary())], ["row", "doc_id", "k", "ids"])

    rows = cut(long.withColumn("row", F.monotonically_increasing_id()).mapInArrow(split, "row long, doc_id long, k long, last boolean, text string"))
    spread = rows.repartition("row", "k")
    found = spread.mapInArrow(pretokenise, "row long, k long, last boolean, head array<long>, tail array<long>")
    in_order = Window.partitionBy("row").orderBy("k")
    # Offsets of the stitch with the chunk before and with the next one, from the chunks' own starts.
    met = found.withColumn("start", F.array_min(F.array_intersect(F.lag("tail").over(in_order), "head")))
    met = met.withColumn("next", F.lead("start").over(in_order))
    broken = (F.col("k") > 0) & F.col("start").isNull()
    whole = F.max(broken).over(Window.partitionBy("row"))
    ends = cut(met.select("row", "k", F.coalesce("start", F.lit(0)).alias("start"), F.when(~F.col("last"), F.col("next") + chunk).alias("stop"), whole.alias("whole")))
    stitched = rows.join(ends.where(~F.col("whole")).drop("whole"), ["row", "k"]).select("row", "doc_id", "k", "text", "start", "stop")
    joined = (
        stitched.mapInArrow(encode, "row long, doc_id long, k long, ids binary")
        .groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .select("doc_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, part: F.concat(all_, part["ids"])).alias("ids"))
    )
    rest = rows.join(ends.where("whole").select("row").distinct(), "row", "left_semi")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.substring("text", 1, chunk).alias("text")))), lambda p: p["text"]), "")
    rest = rest.groupBy("row", "doc_id").agg(text.alias("text")).select("doc_id", "text")
    return joined.unionByName(_encode_rows(rest, path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``ids`` are little-endian unsigned 32-bit integers, those the tiktoken
    library gives for the whole text without special tokens; a null or empty
    text has none. Null and repeated doc_ids are kept row by row. Texts beyond
    ``chunk`` characters are dealt over tasks in overlapping chunks.
    """
    short, long = _split_by_length(docs, chunk)
    return _encode_rows(short, path, pattern).unionByName(_encode_long(long, path, pattern, chunk, overlap))


def _split_by_length(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.where(F.length("text") <= chunk), rows.where(F.length("text") > chunk)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with the raw bytes of its ids in a column ``decoded``."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches):
        for part in slices(batches, "ids"):
            raw = [codec(path, pattern).decode(ids or b"") for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{kinds}, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the documents encoded, and decoded again.

    Rows as in ``encode_documents``. A text of up to ``chunk`` characters is
    encoded, decoded and hashed in one pass, so its ids never leave the worker.
    """

    def run(batches):
        for part in slices(batches, "text"):
            found = []
            for text in part.column("text").to_pylist():
                ids = codec(path, pattern).encode(text)
                found.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(codec(path, pattern).decode(ids)).hexdigest()))
            n, ids, decoded = zip(*found)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows, long = _split_by_length(docs, chunk)
    short = rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    both = decode_documents(_encode_long(long, path, pattern, chunk, overlap), path, pattern)
    return short.unionByName(
        both.select(
            "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        )
    )
