"""Connected components: forests inside a task, and stars of growing size over a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut


class Forest:
    """Links between the rows of one task, kept as parents, so that only one link per row leaves it."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                return found
            found = above

    def unite(self, rows: np.ndarray) -> None:
        """All of these rows belong together."""
        roots = self.roots(rows)
        least = roots.min()
        self.parent[roots] = least
        self.parent[rows] = least

    def unite_pairs(self, left: np.ndarray, right: np.ndarray) -> None:
        """Pairs sorted by their left row: each left row with all of its partners."""
        if len(left):
            starts = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
            for start, stop in zip(starts, [*starts[1:], len(left)]):
                self.unite(np.append(right[start:stop], left[start]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are not a root, and their roots."""
        rows = np.arange(len(self.parent))
        roots = self.roots(rows)
        changed = roots != rows
        return rows[changed], roots[changed]


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` of every linked node but the roots; a root is the smallest node of its component.

    Alternates the large-star and small-star steps of Kiveris et al. ("Connected
    Components in MapReduce and Beyond", 2014): a logarithmic number of rounds,
    never more links than at the start, and only minima are gathered per node,
    so a node with many links needs no large group. Each round ends with a
    checkpoint. Links to itself or to null are ignored.
    """
    links = cut(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    signature = _signature(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(nearest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(moved.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct())
        before, signature = signature, _signature(links)
        if before == signature:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
