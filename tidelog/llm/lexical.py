"""Ranked lexical search: blocks of documents as K2-treaps over a grid of terms and documents, searched best-first."""

from __future__ import annotations

import math
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import cut, slices
from tidelog.session import scratch_path

# A term is a maximal run of characters that are neither ASCII marks nor ASCII
# spaces. In the bytes of a text, letters A-Z become lower case and bytes of no
# term spaces.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
TOP = 20
# A block of the index: so many documents or bytes of text at most (one document at least).
BLOCK_DOCS, BLOCK_BYTES = 1 << 13, 16 << 20
# Terms of items that a search holds at once; more items are searched in several passes.
TERMS_AT_ONCE = 1 << 20
# Items searched together in a block, and ranges of documents opened for each of them in a step.
ITEMS_AT_ONCE, OPENED = 64, 24
_POPULATION = np.array([bin(i).count("1") for i in range(16)], np.int64)


def _low(text: str | None) -> bytes:
    """A text with its terms between spaces."""
    return b"" if text is None else text.encode().translate(_BYTES)


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of each text, with only A-Z lower-cased; null texts have none."""
    return pc.ascii_split_whitespace(pa.array(map(_low, texts.to_pylist()), pa.binary()).cast(pa.string()))


def _counted(lists: pa.ListArray, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, term, occurrences)`` of each distinct term of each text, and each text's length; new terms get numbers in ``known``."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    lengths = np.diff(np.concatenate(([0], np.cumsum(filled)))[offsets - offsets[0]])
    coded = words.filter(pa.array(filled)).dictionary_encode()
    numbers = np.array([known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()], np.int64)
    pairs = np.repeat(np.arange(len(lengths)), lengths) << 32 | numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    pairs, times = np.unique(pairs, return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, times, lengths


def _spread(values: np.ndarray) -> np.ndarray:
    """The lower 32 bits of each value, moved to the even places."""
    found = values.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        found = (found | found << np.uint64(shift)) & np.uint64(mask)
    return found


def _gathered(codes: np.ndarray) -> np.ndarray:
    """The even places of each code, moved together."""
    found = codes & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        found = (found | found >> np.uint64(shift)) & np.uint64(mask)
    return found.astype(np.int64)


def build_treap(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, bits: int) -> bytes:
    """The points of a grid of ``2**bits`` rows and columns as a packed K2-treap.

    A cell is a square; its quadrants that hold points follow on the next level.
    For a cell of several points a byte says which quadrants there are (low
    half) and which of them hold a single point (high half); a single point ends
    its branch and keeps what is left of its coordinates. Each cell has the
    largest value in it, as the difference to that of its parent, so that
    values fall from the root down.
    """
    code = _spread(rows) << np.uint64(1) | _spread(columns)
    order = np.argsort(code, kind="stable")
    code, values = code[order], values[order].astype(np.int64)
    top = values.max(initial=0)
    masks, falls, rest, above, depth = [], [], [], np.array([top]), 0
    if len(code) == 1:
        rest.append(code)
    while len(code) > 1:
        depth += 1
        left = np.uint64(2 * (bits - depth))
        prefix = code >> left
        starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        sizes = np.diff(np.append(starts, len(code)))
        largest, alone, cell = np.maximum.reduceat(values, starts), sizes == 1, prefix[starts]
        quadrant, parent = (cell & np.uint64(3)).astype(np.int64), cell >> np.uint64(2)
        first = np.concatenate(([True], parent[1:] != parent[:-1]))
        masks.append(np.bitwise_or.reduceat(1 << quadrant | alone.astype(np.int64) << (quadrant + 4), np.flatnonzero(first)).astype(np.uint8))
        falls.append((above[np.cumsum(first) - 1] - largest).astype(np.uint32))
        rest.append(code[starts[alone]] & ((np.uint64(1) << left) - np.uint64(1)))
        code, values = (a[np.repeat(~alone, sizes)] for a in (code, values))
        above = largest[~alone]
    sizes = [(len(m), len(f), len(r)) for m, f, r in zip(masks, falls, rest)] if masks else []
    head = struct.pack("<qqqq", bits, int(top), len(order), len(sizes)) + np.array(sizes, "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for part in (masks, falls, rest) for a in part))


class Treap:
    """An unpacked treap. Cells are numbered level by level; a cell's quadrants follow each other."""

    def __init__(self, packed: bytes):
        data = zstandard.ZstdDecompressor().decompress(packed)
        self.bits, top, points, depth = struct.unpack_from("<qqqq", data)
        sizes, at = np.frombuffer(data, "<i8", 3 * depth, 32).reshape(-1, 3), 32 + 24 * depth
        parts = []
        for kind, column in (("u1", 0), ("<u4", 1), ("<u8", 2)):
            for n in sizes[:, column]:
                parts.append(np.frombuffer(data, kind, n, at))
                at += parts[-1].nbytes
        masks, falls, rest = parts[:depth], parts[depth : 2 * depth], parts[2 * depth :]
        if points == 1:
            rest = [np.frombuffer(data, "<u8", 1, at)]
        self.empty = points == 0
        # Per cell: largest value, quadrants, first quadrant's cell; row and column of a single point, else -1.
        n = 1 + sum(len(f) for f in falls)
        self.value, self.mask, self.first = np.empty(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.int64)
        self.row, self.column = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.value[0], end, prefix, inner = top, 1, np.zeros(1, np.uint64), np.zeros(1, np.int64)
        if points == 1:
            self._place(np.zeros(1, np.int64), rest[0])
        for level in range(depth):
            parent, quadrant = np.nonzero(masks[level][:, None] >> np.arange(4, dtype=np.uint8) & 1)
            alone = (masks[level][parent] >> (quadrant + 4).astype(np.uint8) & 1).astype(bool)
            cells = np.arange(end, end + len(parent))
            self.mask[inner] = masks[level] & 15
            self.first[inner] = cells[np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))]
            self.value[cells] = self.value[inner][parent] - falls[level]
            prefix = prefix[parent] << np.uint64(2) | quadrant.astype(np.uint64)
            self._place(cells[alone], prefix[alone] << np.uint64(2 * (self.bits - level - 1)) | rest[level])
            prefix, inner, end = prefix[~alone], cells[~alone], end + len(cells)

    def _place(self, cells: np.ndarray, codes: np.ndarray) -> None:
        self.row[cells], self.column[cells] = _gathered(codes >> np.uint64(1)), _gathered(codes)


def search_treap(treap: Treap, rows: np.ndarray, weights: np.ndarray, floors: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(item, column, score)`` of the columns that can be among the ``top`` of each item (more, if scores tie at the end).

    ``rows`` and ``weights`` have one line per item: the rows of its terms (-1:
    none) and what a value in them counts. A range of columns is known by its
    place on a level and by the cell of each row there, so the paths of all rows
    descend together. The sum of the cells' largest values bounds every column
    of the range from above, and is the score once the range is one column.
    Ranges are opened by falling bounds until none is left that could reach the
    ``top`` found so far, or ``floors``, scores already known to be reached.
    """
    n_items, width = rows.shape
    none = np.empty(0, np.int64)
    found = (none, none, none)
    if treap.empty or not width:
        return found
    floors = np.maximum(floors, 1)
    item, depth, place = np.arange(n_items), np.zeros(n_items, np.int64), np.zeros(n_items, np.int64)
    cells = np.where((rows >= 0) & ((treap.row[0] < 0) | (treap.row[0] == rows)), 0, -1).astype(np.int32)
    bound = np.where(cells >= 0, treap.value[cells] * weights, 0).sum(axis=1)
    while True:
        alive = np.flatnonzero(bound >= floors[item])
        if not len(alive):
            return found
        alive = alive[np.lexsort((-bound[alive], item[alive]))]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(item[alive]) != 0)))
        rank = np.arange(len(alive)) - np.repeat(starts, np.diff(np.append(starts, len(alive))))
        opened, kept = alive[rank < OPENED], alive[rank >= OPENED]
        whose, shift, own, at = item[opened], treap.bits - 1 - depth[opened], rows[item[opened]], cells[opened]
        single, mask, first = treap.row[at] >= 0, treap.mask[at].astype(np.int64), treap.first[at]
        parts = [(item[kept], depth[kept], place[kept], cells[kept], bound[kept])]
        for side in (0, 1):
            quadrant = (own >> shift[:, None] & 1) * 2 + side
            below = np.where(mask >> quadrant & 1, first + _POPULATION[mask & ((1 << quadrant) - 1)], -1)
            here = place[opened] * 2 + side
            below = np.where(single, np.where(treap.column[at] >> shift[:, None] == here[:, None], at, -1), below)
            below = np.where(at >= 0, below, -1)
            point = treap.row[below]
            below = np.where((point >= 0) & (point != own), -1, below)
            sums = np.where(below >= 0, treap.value[below] * weights[whose], 0).sum(axis=1)
            parts.append((whose, depth[opened] + 1, here, below.astype(np.int32), sums))
        item, depth, place, cells, bound = (np.concatenate(p) for p in zip(*parts))
        ended = (depth == treap.bits) & (bound >= floors[item])
        if ended.any():
            more = item[ended], place[ended], bound[ended]
            found = tuple(np.concatenate(p) for p in zip(found, more))
            order = np.lexsort((-found[2], found[0]))
            found = tuple(p[order] for p in found)
            starts = np.flatnonzero(np.concatenate(([True], np.diff(found[0]) != 0)))
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            last = rank == top - 1
            floors[found[0][last]] = np.maximum(floors[found[0][last]], found[2][last])
            found = tuple(p[found[2] >= floors[found[0]]] for p in found)
        open_ = depth < treap.bits
        item, depth, place, cells, bound = (a[open_] for a in (item, depth, place, cells, bound))


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats, of all documents."""

    def run(batches):
        for batch in batches:
            n = [len(_low(t).split()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], ["filled", "terms"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "filled long, terms long")
    return tuple(counts.agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


INDEX = "block string, docs array<long>, terms array<string>, found array<int>, treap binary"


def build_index(docs: DataFrame) -> DataFrame:
    """A stored table of blocks: their document ids, terms, documents per term, and the treap of impacts.

    An impact is what an occurrence count gives in a document of its length:
    10**9 * tf div (1000 * tf + 12 * m) with m = 75 + 25 * n * N div L. In a
    block, terms are numbered by falling largest impact and documents by length,
    so that near cells have near values. Documents without a term have no points.
    """
    filled, total = corpus_counts(docs)

    def block(ids: list, parts: list, known: dict[str, int]) -> pa.RecordBatch:
        lengths = np.concatenate([p[3] for p in parts])
        starts = np.cumsum([0, *(len(p[3]) for p in parts)])
        doc = np.concatenate([p[0] + s for p, s in zip(parts, starts)])
        term, times = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        short = np.array([75 + 25 * n * filled // total for n in lengths.tolist()], np.int64)
        impact = 1_000_000_000 * times // (1000 * times + 12 * short[doc])
        largest = np.zeros(len(known), np.int64)
        np.maximum.at(largest, term, impact)
        by_impact, by_length = np.argsort(-largest, kind="stable"), np.argsort(lengths, kind="stable")
        row, column = np.argsort(by_impact), np.argsort(by_length)
        names = np.array(list(known), object)[by_impact]
        bits = max(1, int(max(len(names), len(ids)) - 1).bit_length())
        treap = build_treap(row[term], column[doc], impact, bits)
        listed = lambda values, kind: pa.array([values], pa.list_(kind))
        columns = [pa.array([uuid.uuid4().hex]), listed([ids[i] for i in by_length], pa.int64()), listed(names.tolist(), pa.string()),
                   listed(np.bincount(term, minlength=len(names))[by_impact].astype(np.int32), pa.int32()), pa.array([treap], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "docs", "terms", "found", "treap"])

    def run(batches):
        ids, parts, known, size = [], [], {}, 0
        for piece in slices(batches, "text"):
            texts = piece.column("text")
            size += texts.nbytes
            parts.append(_counted(terms_of(texts), known))
            ids += piece.column("doc_id").to_pylist()
            if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                if known:
                    yield block(ids, parts, known)
                ids, parts, known, size = [], [], {}, 0
        if known:
            yield block(ids, parts, known)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch_path(docs.sparkSession, "lexical-index")
    # Blocks are large rows, so a row group holds few of them.
    rows.mapInArrow(run, INDEX).write.option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path).withColumns({"n_docs": F.lit(filled)})


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the best documents of every item, by exact integer scores.

    The score sums w * impact over the item's terms, repeats included, where w
    is floor(1000 * ln((2N + 2) / (2 df + 1))). At most ``top`` documents with a
    score above 0 are returned, equal scores by ascending id (null last). Equal
    rows of ``items`` count once; rows that share an id but not the text are
    ranked each on its own. Items without a term have no rows. The items are the
    broadcast side, in passes of at most some ``TERMS_AT_ONCE`` terms.
    """
    spark = index.sparkSession

    def listed(batches):
        for batch in batches:
            terms = [[w for w in found if w] for found in terms_of(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    rows = cut(rows.mapInArrow(listed, f"item_id {kind}, terms array<string>").where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()))
    total = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    passes, found = -(-total // TERMS_AT_ONCE), None
    n_docs = index.select("n_docs").first() if passes else None
    for number in range(passes):
        # The mean of a pass is below the bound; a hash spreads the items over the passes.
        own = rows.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).select("item", "terms").collect()
        made = _search_pass(index, own, n_docs[0] if n_docs else 0, top)
        found = made if found is None else found.unionByName(made)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_pass(index: DataFrame, own: list, n_docs: int, top: int) -> DataFrame:
    """``item, doc_id, score``: each task's best documents of the given items."""
    names = pa.array(sorted({t for r in own for t in r["terms"]}), pa.string())
    sent = index.sparkSession.sparkContext.broadcast(names)

    def counts(batches):
        for batch in batches:
            for terms, found in zip(batch.column("terms"), batch.column("found")):
                at = pc.index_in(sent.value, terms.values)
                held = at.is_valid()
                arrays = [pc.indices_nonzero(held).cast(pa.int64()), found.values.take(at.filter(held)).cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["term", "df"])

    spread = index.select("terms", "found").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(names), np.int64)
    for row in spread.collect():  # one row per term of the pass at most
        df[row["term"]] = row["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    number = {t: i for i, t in enumerate(names.to_pylist())}
    terms = [np.unique([number[t] for t in r["terms"]], return_counts=True) for r in own]
    sent_items = index.sparkSession.sparkContext.broadcast(([r["item"] for r in own], [(t, weight[t] * n) for t, n in terms]))

    def run(batches):
        keys, wanted = sent_items.value
        best = [[] for _ in keys]
        floors = np.zeros(len(keys), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                docs = batch.column("docs")[at].as_py()
                rows = pc.fill_null(pc.index_in(sent.value, batch.column("terms")[at].values), -1).to_numpy()
                treap = Treap(batch.column("treap")[at].as_py())
                for start in range(0, len(keys), ITEMS_AT_ONCE):
                    some = [(rows[t], w) for t, w in wanted[start : start + ITEMS_AT_ONCE]]
                    width = max(len(r) for r, _ in some)
                    grid, weights = np.full((len(some), width), -1, np.int64), np.zeros((len(some), width), np.int64)
                    for i, (r, w) in enumerate(some):
                        grid[i, : len(r)], weights[i, : len(r)] = r, w
                    found = search_treap(treap, grid, weights, floors[start : start + len(some)].copy(), top)
                    for i, column, score in zip(*(p.tolist() for p in found)):
                        best[start + i].append((-score, docs[column] is None, docs[column] or 0))
                for i, listed in enumerate(best):
                    if len(listed) > top:
                        best[i] = sorted(listed)[:top]
                    if len(best[i]) >= top:
                        floors[i] = max(floors[i], -max(best[i])[0])
        rows = [(key, None if null else doc, -score) for key, listed in zip(keys, best) for score, null, doc in listed]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return cut(index.select("docs", "terms", "treap").mapInArrow(run, "item long, doc_id long, score long"))


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The best documents of every item, from an index of all documents; see ``build_index`` and ``search``.

    Null and empty texts have no terms and are never found; repeated rows are
    documents each; other columns are ignored; without documents or items there
    are no rows.
    """
    return search(build_index(docs), items, top)


RANKED_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2, 3),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, corpus GROUP BY term, n_docs),
scored AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM tf JOIN weights USING (term) JOIN wanted USING (term), corpus GROUP BY 1, 2),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""
