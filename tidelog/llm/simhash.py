"""Near-duplicate documents by SimHash: fingerprints, tiled exact comparison, groups."""

from __future__ import annotations

from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, lookup, slices
from tidelog.llm.components import Forest, connected_components

RADIUS = 3
# A fingerprint is four words of 16 bits. Cells hold two population counts of each.
WORDS, CELL = 4, 2
SIDE = 16 // CELL + 1
# Fingerprints on one side of a comparison task; a cell with more is dealt into pieces.
TILE_ROWS = 1 << 16
BLOCK = 1 << 21
HASHED_AT_ONCE = 1 << 19


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included, as an unsigned number.

    Words are runs without ASCII white space of the text with A-Z in lower
    case; fewer words than ``width`` make one shingle, none gives zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = [end + i for i, end in enumerate(accumulate(map(len, words)))]
    starts = [0, *(end + 1 for end in ends[:-1])]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    for at in range(0, n, HASHED_AT_ONCE):
        pieces = zip(starts[at : min(n, at + HASHED_AT_ONCE)], last[at : at + HASHED_AT_ONCE])
        hashes = np.array([digest(joined[a:z], seed) for a, z in pieces], np.uint64)
        counts += _bit_counts(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, digest: bool = False) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits of the fingerprint as a signed long. With ``digest`` also a hash of the whole row."""
    keys = ["doc_id", "digest"] if digest else ["doc_id"]

    def run(batches):
        for part in slices(batches, "text"):
            found = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(found.view(np.int64))], [*keys, "fp"])

    columns = {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")} | ({"digest": row_digest(docs)} if digest else {})
    rows = docs.select(*[column.alias(name) for name, column in columns.items()])
    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "fp"]))


def row_digest(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def _populations(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four words of each fingerprint."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, WORDS)).astype(np.int8)


def _touched(populations: np.ndarray):
    """Cells with a population vector within the radius: ``(rows, cell numbers, whether their own)``.

    Two fingerprints at distance d have population vectors at most d apart, so
    a fingerprint is sent to its own cell and as a guest to later cells only.
    """
    own, offset = np.divmod(populations.astype(np.int64), CELL)
    reach = -(-RADIUS // CELL)
    weights = SIDE ** np.arange(WORDS - 1, -1, -1)
    for step in product(range(-reach, reach + 1), repeat=WORDS):
        if step < (0,) * WORDS or sum(max(0, (abs(s) - 1) * CELL + 1) for s in step if s) > RADIUS:
            continue
        move = np.array(step)
        cost = np.where(move > 0, move * CELL - offset, np.where(move < 0, offset + 1 + (-move - 1) * CELL, 0)).sum(axis=1)
        cells = own + move
        rows = np.flatnonzero((cost <= RADIUS) & (cells >= 0).all(axis=1) & (cells < SIDE).all(axis=1))
        if len(rows):
            yield rows, cells[rows] @ weights, not any(step)


def _compare(table: pa.Table) -> pa.Table:
    """A forest of the links between the left and the right fingerprints of one tile."""
    fps = table.column("fp").to_numpy().view(np.uint64)
    role = table.column("role").to_numpy()
    names, index = np.unique(fps, return_inverse=True)
    left, right = index[(role & 1) > 0], index[(role & 2) > 0]
    populations, forest = _populations(names), Forest(len(names))
    codes = populations.astype(np.int64) @ (17 ** np.arange(WORDS))
    left = left[np.argsort(codes[left], kind="stable")]
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(codes[left]) != 0, [True]))) if len(left) else []
    for start, stop in zip(cuts[:-1], cuts[1:]):
        rows = left[start:stop]
        # Tiles of equal population counts; those further apart than the radius are skipped.
        near = right[np.abs(populations[right] - populations[rows[0]]).sum(axis=1) <= RADIUS]
        if not len(near):
            continue
        for at in range(0, len(rows), step := max(1, BLOCK // len(near))):
            block = rows[at : at + step]
            a, b = np.nonzero(np.bitwise_count(names[block][:, None] ^ names[near][None, :]) <= RADIUS)
            other = block[a] != near[b]
            forest.unite_pairs(block[a[other]], near[b[other]])
    rows, roots = forest.links()
    signed = names.view(np.int64)
    return pa.table({"a": signed[rows], "b": signed[roots]})


def simhash_links(distinct: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all within the radius, one per row and tile at most.

    Fingerprints meet in the cells of their population counts, and every pair
    of tiles within a cell is compared exactly. A cell with more than
    ``tile_rows`` fingerprints is dealt into pieces, of which every left piece
    meets every right one, so a task's memory is bounded. The table of cell
    sizes has at most ``SIDE ** WORDS`` (6561) rows whatever the input.
    """

    def cells(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for rows, cell, own in _touched(_populations(fps)):
                arrays = [pa.array(cell), pa.array(fps[rows].view(np.int64)), pa.array(np.full(len(rows), own))]
                yield pa.RecordBatch.from_arrays(arrays, ["cell", "fp", "own"])

    placed = distinct.select("fp").mapInArrow(cells, "cell long, fp long, own boolean")
    sizes = {
        row["cell"]: (max(1, -(-row["owned"] // tile_rows)), max(1, -(-row["n"] // tile_rows)))
        for row in placed.groupBy("cell").agg(F.count_if("own").alias("owned"), F.count("*").alias("n")).collect()
        if row["n"] > tile_rows
    }

    def tiles(batches):
        for batch in batches:
            cell, fp, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "own"))
            split = np.isin(cell, list(sizes)) if sizes else np.zeros(len(cell), bool)
            parts = [(cell[~split] << 32, fp[~split], np.where(own[~split], 3, 2))]
            for c in np.unique(cell[split]):
                lefts, rights = sizes[int(c)]
                here, key = split & (cell == c), fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for side, role, mine, others in ((here & own, 1, lefts, rights), (here, 2, rights, lefts)):
                    piece = (key[side] % mine).astype(np.int64)
                    for other in range(others):
                        pair = piece * rights + other if role == 1 else other * rights + piece
                        parts.append(((c << 32) + pair, fp[side], np.full(side.sum(), role)))
            columns = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tile", "fp", "role"])

    dealt = placed.mapInArrow(tiles, "tile long, fp long, role long")
    return dealt.groupBy("tile").applyInArrow(_compare, "a long, b long")


def _rooted(classes: DataFrame, tile_rows: int) -> DataFrame:
    """``classes`` (one row per ``fp``) with the ``root`` of each fingerprint's component."""
    found = connected_components(simhash_links(classes.select("fp"), tile_rows), "a", "b")
    joined = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return cut(joined.withColumn("root", F.coalesce("root", "fp")))


def simhash_groups(docs: DataFrame, width: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Equal fingerprints form one class, so copies are never compared with each
    other. ``component_id`` is the smallest id reachable by links of 3 or fewer
    differing bits. Null and empty texts have fingerprint zero and link like
    any other; a null id never names a component (a component of null ids only
    has a null one); repeated rows are returned as often as they come.
    """
    rows = cut(fingerprints(docs, width))
    rooted = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), tile_rows)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, width: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row of each group of ``simhash_groups``: the one with the smallest ``doc_id`` (null last; of equal ids by a hash of the row).

    Rows are told apart by id and content, not by id alone, so of two texts
    under one id each stays unless a row with its own fingerprint group does.
    Of rows equal in every column one stays. The result does not depend on the
    order of the rows. Only the keys of rows that go (and of repeated ones) are
    joined with the documents, so texts are shuffled only where these are many.
    """
    rows = cut(fingerprints(docs, width, digest=True))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    rooted = _rooted(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), tile_rows)
    groups = rooted.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("n")).where("n > 1").select("root", "first")
    shared = lookup(cut(rooted.join(groups, "root").select("fp", "first")))
    stays = key.eqNullSafe(F.col("first"))
    members = rows.join(shared, "fp").groupBy("doc_id", "digest").agg(F.first(stays).alias("stays"), F.count("*").alias("n"))
    moved = lookup(cut(members.where("NOT stays OR n > 1")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_digest(docs).alias("digest")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.digest") == F.col("m.digest"))
    kept = own.join(moved.alias("m"), same, "left_anti").select("row.*")
    repeated = moved.where("stays")
    if repeated.limit(1).count():
        again = own.join(lookup(repeated).alias("m"), same, "left_semi").dropDuplicates(["doc_id", "digest"])
        kept = kept.unionByName(again.select("row.*"))
    return kept
