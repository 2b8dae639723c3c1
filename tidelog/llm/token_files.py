"""Token ids as binary files: blocks of ids transposed into planes, each plane compressed by zstandard.

A file holds the ids of consecutive documents. Layout::

    magic "TPLN" | planes of block 0 | planes of block 1 | ... | index | length of the index (8 bytes) | magic

The index is compressed JSON: the kind of plane (``byte`` or ``bit``), for each
block its place, number of ids and plane lengths, and the documents' ids and
numbers of tokens. A block is found and read without the others.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import cut, slices
from tidelog.session import qualified, scratch_path

MAGIC = b"TPLN"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 25
# Distinct words a Python worker keeps the ids of, so that a repeated word is not encoded again;
# beyond that only the most frequent half stays. Some 200 MB.
WORDS_KEPT = 1_000_000
END_ID = 2


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """A block of ids as planes of equal length, the least significant first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(octets[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == "byte":
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one file; memory holds one block and the documents' lengths."""

    def __init__(self, path: str, kind: str, block_ids: int, level: int = 3):
        system, place = _open(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.path, self.kind, self.block_ids = path, kind, block_ids
        self.out, self.pack = system.open_output_stream(place), zstandard.ZstdCompressor(level=level).compress
        self.out.write(MAGIC)
        self.at, self.waiting, self.pending, self.blocks, self.docs = len(MAGIC), 0, [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.empty(0, "<u4"), *self.pending])
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            block = ids[at : min(whole, at + self.block_ids)]
            planes = [self.pack(p) for p in to_planes(block, self.kind)]
            self.blocks.append([self.at, len(block), [len(p) for p in planes]])
            self.at += self.out.write(b"".join(planes))
        self.pending, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        """Ends the file; returns the number of its ids."""
        self._flush(True)
        index = {"kind": self.kind, "blocks": self.blocks, "doc_ids": [d for d, _ in self.docs], "n_tokens": [n for _, n in self.docs]}
        packed = self.pack(json.dumps(index).encode())
        self.out.write(packed + struct.pack("<Q", len(packed)) + MAGIC)
        self.out.close()
        return sum(n for _, n in self.docs)


class Reader:
    def __init__(self, path: str):
        system, place = _open(path)
        self.file = system.open_input_file(place)
        size, tail = self.file.size(), len(MAGIC) + 8
        end = self.file.read_at(tail, size - tail)
        if end[8:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        length = struct.unpack("<Q", end[:8])[0]
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.index = json.loads(self.unpack(self.file.read_at(length, size - tail - length)))

    def block(self, number: int) -> np.ndarray:
        at, n, lengths = self.index["blocks"][number]
        packed, planes = self.file.read_at(sum(lengths), at), []
        for length in lengths:
            planes.append(self.unpack(packed[:length]))
            packed = packed[length:]
        return from_planes(planes, n, self.index["kind"])

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """Each document's id and its ids in pieces; the pieces must be consumed in order."""
        left, number = np.empty(0, "<u4"), 0

        def pieces(n: int) -> Iterator[np.ndarray]:
            nonlocal left, number
            while n:
                if not len(left):
                    left, number = self.block(number), number + 1
                piece, left = left[:n], left[n:]
                n -= len(piece)
                yield piece

        for doc_id, n in zip(self.index["doc_ids"], self.index["n_tokens"]):
            yield doc_id, pieces(n)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] ... starts[i] + sizes[i] - 1`` of all i, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class WordEncoder:
    """Ids of whole texts by a byte-level tokenizer of the ``tokenizers`` library.

    In a text whose only white space are single spaces and line feeds between
    words, a pre-token never crosses the place before a space, nor either side
    of a line feed, so words are encoded apart, each with what goes before it,
    and remembered. New words are encoded in one call, as a text: the ids that
    begin with white space tell where each word begins. A mark of ``ENDS``
    between a letter or digit and white space is a pre-token of its own, so it
    is encoded apart from its word. Texts with other white space are encoded
    whole. Text that spells a special token is ordinary text, as in the example
    of the tokenizer files' README: ``encode_special_tokens`` is set.
    """

    ENDS = ",.;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = sorted((number, name) for name, number in self.tokenizer.get_vocab(with_added_tokens=False).items())
        self.opens = np.zeros(names[-1][0] + 1, bool)
        # A space and a line feed, as a byte-level vocabulary writes them.
        self.opens[[number for number, name in names if name[0] in "\u0120\u010a"]] = True
        self.marks = {mark: self._encoded([mark])[0] for mark in self.ENDS}
        # Number of each known word; its ids in ``flat``, and how often it was met.
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.uses = np.empty(0, "<u4"), *(np.empty(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keeps the half of the words that were met most, and of those only words met again."""
        names = np.array(list(self.known), object)
        kept = np.argsort(-self.uses, kind="stable")[: WORDS_KEPT // 2]
        kept = np.sort(kept[self.uses[kept] > 1])
        self.known = dict(zip(names[kept].tolist(), range(len(kept))))
        self.flat, self.sizes, self.uses = self.flat[_ranges(self.starts[kept], self.sizes[kept])], self.sizes[kept], self.uses[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.flat, self.sizes = np.concatenate((self.flat, flat.astype("<u4"))), np.concatenate((self.sizes, sizes))
        self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int64)))

    def _learn(self, words: set[str]) -> None:
        """Encodes words; one after a line feed begins with it, all others come after a space."""
        odd = [w for w in words if [w[w[:1] == "\n" :]] != w.split()]
        self._remember(odd, np.empty(0, "<u4"), np.zeros(len(odd), np.int64))
        marked = [w for w in words.difference(odd) if w[-1] in self.marks and len(w) > 1 and w[-2].isalnum()]
        plain = list(words.union([w[:-1] for w in marked]).difference(marked, self.known))
        if plain:
            ids = self._encoded(["".join(w if w[0] == "\n" else " " + w for w in plain)])[0]
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(plain):
                sizes = np.diff(np.append(begins, len(ids)))
            else:
                each = self._encoded([w if w[0] == "\n" else " " + w for w in plain])
                ids, sizes = np.concatenate(each), np.array([len(e) for e in each])
            self._remember(plain, ids, sizes)
        if marked:
            stems = np.array([self.known[w[:-1]] for w in marked])
            ends = [self.marks[w[-1]] for w in marked]
            pieces, sizes = self.flat[_ranges(self.starts[stems], self.sizes[stems])], self.sizes[stems]
            flat = np.insert(pieces, np.repeat(np.cumsum(sizes), [len(e) for e in ends]), np.concatenate(ends))
            self._remember(marked, flat, sizes + [len(e) for e in ends])

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words, new ones learned."""
        at = list(map(self.known.get, words))
        if None in at:
            new = {w for w, number in zip(words, at) if number is None}
            if len(self.known) + 2 * len(new) > WORDS_KEPT:
                self._forget()
                new = set(words) - self.known.keys()
            self._learn(new)
            at = list(map(self.known.get, words))
        return np.array(at)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        # The first word is encoded as after a line feed, whose id is then dropped.
        lists = pc.split_pattern(pa.array([f"\n{t}".replace("\n", " \n")[1:] for t in texts], pa.large_string()), " ")
        coded, offsets = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        distinct = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
        numbers, codes = self._numbers(pc.binary_join(distinct, " ")[0].as_py().split(" ")), coded.indices.to_numpy()
        self.uses[numbers] += np.bincount(codes, minlength=len(numbers))
        starts, sizes = self.starts[numbers], self.sizes[numbers]
        ids = self.flat[_ranges(starts[codes], sizes[codes])]
        ends = np.concatenate(([0], np.cumsum(sizes[codes])))[offsets]
        # A word without ids is none, or holds white space.
        whole = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(sizes[codes] == 0)))[offsets]))
        found = [ids[a + 1 : z] for a, z in zip(ends[:-1], ends[1:])]
        for i, own in zip(whole, self._encoded([texts[i] for i in whole])):
            found[i] = own
        return found


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, made once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    kind: str = "byte",
    block_ids: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the documents' ids under ``folder`` and returns the manifest ``path, start, n_ids, n_docs``.

    Documents go out in ascending ``doc_id`` (null first, repeated ids by text, so
    that an id of many texts is spread over tasks), one or more files per range. A task names its files anew in each
    attempt, and only files of finished tasks are in the manifest, so a lost
    executor leaves no half file among them. ``start`` counts the ids in all
    files before. Null and empty texts have the end id alone.
    """

    def write(batches):
        writer, made, part = None, [], TaskContext.get().partitionId()
        for piece in slices(batches, "text"):
            ids = encoder(tokenizer).encode([t or "" for t in piece.column("text").to_pylist()])
            for doc_id, own in zip(piece.column("doc_id").to_pylist(), ids):
                writer = writer or Writer(f"{folder}/{part:06d}-{len(made):04d}-{uuid.uuid4().hex}.tok", kind, block_ids)
                writer.add(doc_id, np.append(own, np.array([end_id], "<u4")))
                if sum(b[1] for b in writer.blocks[-1:]) and len(writer.blocks) * block_ids >= file_ids:
                    made.append((writer.path, writer.close(), len(writer.docs)))
                    writer = None
        if writer:
            made.append((writer.path, writer.close(), len(writer.docs)))
        paths, n_ids, n_docs = zip(*made) if made else ((), (), ())
        columns = [[part] * len(made), list(range(len(made))), paths, n_ids, n_docs]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "number", "path", "n_ids", "n_docs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = qualified(docs.sparkSession, folder)
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    files = cut(ordered.mapInArrow(write, "part long, number long, path string, n_ids long, n_docs long"))
    # One row per file, so a running sum in one task stays small.
    before = F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    return files.select("path", F.coalesce(before, F.lit(0)).alias("start"), "n_ids", "n_docs")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of a manifest, one block in memory at a time."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                for doc_id, pieces in Reader(path).documents():
                    crc, n = 0, 0
                    for piece in pieces:
                        crc, n = zlib.crc32(np.ascontiguousarray(piece, "<u4"), crc), n + len(piece)
                    rows.append((doc_id, start, n, crc))
                    start += n
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A number of partitions that adaptive execution leaves as it is: the rows are tiny, the files are not.
    spread = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """The documents written as token files in the shared folder and read back; see the two functions above."""
    return read_token_files(write_token_files(docs, scratch_path(spark, "token-files"), tokenizer, **options))
