"""Near-duplicate vectors: collisions counted over many sorted projections, then verified."""

from __future__ import annotations

from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, lookup
from tidelog.llm.components import Forest, connected_components

COSINE = 0.95
RECALL = 0.999
# One-dimensional projections per pair, and half a window in standard
# deviations of the difference that a pair at exactly COSINE has.
PROJECTIONS, WINDOW = 32, 2.0
# Vectors that a routing bucket should hold, and vectors on one side of a task.
BUCKET_ROWS, TILE_ROWS = 512, 1 << 13
QUERY_ROWS = 256
PAIRS_AT_ONCE = 1 << 16


def collision_threshold(recall: float, projections: int = PROJECTIONS, window: float = WINDOW) -> int:
    """The highest count that a pair at the limit of similarity reaches with this probability.

    Its projections differ by a normal with a known deviation, so it collides
    in each window with probability p, and the count is binomial.
    """
    p = erf(window / sqrt(2))
    missed = 0.0
    for count in range(projections + 1):
        missed += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if missed > 1 - recall:
            return count
    return projections


def routing(rows: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET_ROWS) -> tuple[int, int]:
    """``(sign bits per table, tables)`` with which a pair at ``cosine`` shares a bucket with probability ``recall``.

    The bits grow with the logarithm of the rows, so buckets keep their size.
    """
    bits = max(0, round(log2(max(1, rows) / bucket)))
    together = (1 - acos(cosine) / pi) ** bits
    return bits, 1 if bits == 0 else ceil(log(1 - recall) / log(1 - together))


def _unit(vectors: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of length one in double precision; shorter ones are padded with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    found = np.zeros((len(lengths), dims))
    found[np.arange(dims) < lengths[:, None]] = vectors.flatten().to_numpy()
    found /= np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


class Plan:
    """Directions and thresholds, the same in every task."""

    def __init__(self, rows: int, dims: int, cosine: float, recall: float):
        self.dims, self.cosine = dims, cosine
        self.bits, self.tables = routing(rows, cosine, recall)
        draw = np.random.default_rng(20_250_101)
        self.signs = draw.standard_normal((dims, self.tables * self.bits))
        self.lines = draw.standard_normal((dims, PROJECTIONS))
        self.window = WINDOW * sqrt(2 - 2 * cosine)
        self.least = collision_threshold(recall)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        bits = (unit @ self.signs > 0).reshape(len(unit), self.tables, self.bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))

    def counted(self, left: np.ndarray, right: np.ndarray):
        """For blocks of left rows: ``(first row, collisions with each right row)``.

        Each projection of the right rows is sorted once; a left row's window
        is then a range of ranks, found by binary search.
        """
        ours, theirs = left @ self.lines, right @ self.lines
        ranks = np.empty((PROJECTIONS, len(right)), np.uint16)
        low, wide = (np.empty((PROJECTIONS, len(left)), np.uint16) for _ in range(2))
        for i in range(PROJECTIONS):
            order = np.argsort(theirs[:, i])
            values = theirs[order, i]
            ranks[i, order] = np.arange(len(right))
            low[i] = np.searchsorted(values, ours[:, i] - self.window, "left")
            wide[i] = np.searchsorted(values, ours[:, i] + self.window, "right") - low[i]
        for at in range(0, len(left), QUERY_ROWS):
            rows = slice(at, at + QUERY_ROWS)
            counts = np.zeros((len(left[rows]), len(right)), np.uint8)
            for i in range(PROJECTIONS):
                # Ranks below the window wrap around, so one comparison tests both ends.
                counts += (ranks[i][None, :] - low[i, rows][:, None]) < wide[i, rows][:, None]
            yield at, counts

    def compare(self, table: pa.Table) -> pa.Table:
        """Links found between the left and right vectors of one tile of a bucket.

        A pair that meets in an earlier table as well is left to that table,
        so each link is counted once.
        """
        number = table.column("tables")[0].as_py()
        ids, role, weight = (table.column(c).to_numpy() for c in ("rep", "role", "weight"))
        unit = _unit(table.column("embedding"), self.dims)
        buckets = self.buckets(unit)[:, :number]
        left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        forest, links = Forest(len(ids)), np.zeros(len(ids))
        for at, counts in self.counted(unit[left], unit[right]):
            a, b = np.nonzero(counts >= self.least)
            a, b = left[a + at], right[b]
            later = ids[a] < ids[b]
            a, b = a[later], b[later]
            for start in range(0, len(a), PAIRS_AT_ONCE):
                i, j = a[start : start + PAIRS_AT_ONCE], b[start : start + PAIRS_AT_ONCE]
                first = ~(buckets[i] == buckets[j]).any(axis=1)
                i, j = i[first], j[first]
                linked = np.einsum("ij,ij->i", unit[i], unit[j]) >= self.cosine
                i, j = i[linked], j[linked]
                links += np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
                forest.unite_pairs(i, j)
        # A split tile may hold a vector twice, as left and as right: both rows are reported.
        found = np.flatnonzero(links)
        roots = forest.roots(found)
        return pa.table({"a": ids[found], "b": ids[roots], "links": links[found].astype(np.int64)})


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id``, ``embedding``; others are ignored).

    Equal vectors form one class with a weight. Classes are routed by signs of
    random projections into tables of buckets, whose number grows with the
    rows so that pairs at the limit still meet with probability ``recall``. In
    a bucket every projection is sorted, the collisions of a pair in
    query-centred windows are counted, and pairs that reach a count calibrated
    to ``recall`` are verified by cosine in double precision. A bucket with
    more than ``tile_rows`` vectors is dealt into pieces, every left one
    meeting every right one. A task returns counts and one link per vector,
    never pairs.

    Null vectors, zero vectors, and vectors with null or non-finite components
    link with nothing; neither do vectors of different length. Repeated rows
    are copies of each other; a null id never names a component. ``kept`` is
    false for a null id.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = (
        rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
        .withColumn("rep", F.coalesce("least", F.lit(-1) - F.abs(F.xxhash64("embedding") % (1 << 62))))
    )
    classes = cut(classes)
    n, dims = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    plan = Plan(n, dims or 1, cosine, recall)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = plan.buckets(_unit(batch.column("embedding"), plan.dims))
            size = np.diff(batch.column("embedding").offsets.to_numpy())
            for number in range(plan.tables):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(size), number, np.int32)), pa.array(buckets[:, number]), pa.array(size.astype(np.int32))],
                    [*batch.schema.names, "tables", "bucket", "size"],
                )

    kind = "rep long, weight long, embedding array<double>"
    routed = classes.select("rep", "weight", "embedding").mapInArrow(route, f"{kind}, tables int, bucket long, size int")
    key = ["tables", "bucket", "size"]
    large = cut(routed.groupBy(*key).count().where(F.col("count") > tile_rows).select(*key, F.ceil(F.col("count") / tile_rows).cast("long").alias("pieces")))
    pieces = F.coalesce("pieces", F.lit(1).cast("long"))
    mine = F.pmod(F.xxhash64("rep"), pieces)
    both = F.array(F.struct(F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(3).alias("role")))
    others = F.sequence(F.lit(0).cast("long"), pieces - 1)
    split = F.concat(
        F.transform(others, lambda o: F.struct(mine.alias("left"), o.alias("right"), F.lit(1).alias("role"))),
        F.transform(others, lambda o: F.struct(o.alias("left"), mine.alias("right"), F.lit(2).alias("role"))),
    )
    dealt = routed.join(lookup(large), key, "left").select("*", F.inline(F.when(pieces == 1, both).otherwise(split)))
    found = cut(dealt.groupBy(*key, "left", "right").applyInArrow(lambda tile: plan.compare(tile), "a long, b long, links long"))

    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(found, "a", "b").select(F.col("node").alias("rep"), "root")
    joined = classes.join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    used = rows.where("usable").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return used.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


GROUPS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
