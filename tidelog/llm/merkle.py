"""A Merkle manifest of a dataset: a tree of digests per source, one over the sources, and a recursive climb that verifies every row.

H is the lowercase hex SHA-256 of its inputs joined; digests enter it as hex
text. They are kept as 32 bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import cut, lookup

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT = 16
BYTES = 32
# The tree over the sources; the sources' trees are numbered from 0.
ROOT_TREE = -1


def digest(data: Column) -> Column:
    """H of digests laid end to end, or of text, as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def _text(data: Column) -> Column:
    return F.lower(F.hex(data))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda all_, one: F.concat(all_, one))


def leaf(text: Column | str = "text") -> Column:
    """H of the fields of a row, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    values = [F.col(name).cast("string") for name in FIELDS[:-1]] + [F.col(text) if isinstance(text, str) else text]
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return digest(F.concat(*parts))


def lower_cased(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_tampered(doc_id: Column) -> Column:
    """Whether 5 divides the crc32 of the decimal id; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place in its group (from 0), and ``n``, the rows of the group.

    ``order`` must tell any two rows of a group apart. Rows are sorted in ranges,
    whatever the size of a group, and each range counts its rows from a number
    of its own; the counts of all ranges (one row per range and group in it)
    give the places of their first rows.
    """
    rows = cut(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_row", 33))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range", *group).agg(F.min("_row").alias("first"), F.count("*").alias("own"))
    ranges = ranges.select("_range", *group, (F.col("first") - F.coalesce(F.sum("own").over(before), F.lit(0))).alias("zero"), F.sum("own").over(whole).alias("n"))
    found = rows.alias("r").join(lookup(cut(ranges)).alias("c"), _same("r", "c", ["_range", *group]))
    columns = [f"r.{c}" for c in rows.columns if c not in ("_row", "_range")]
    return found.select(*columns, (F.col("r._row") - F.col("c.zero")).alias("at"), "c.n")


def _runs(rows: DataFrame, *columns: str) -> DataFrame:
    """``tree, run, n, nodes``: up to ``FANOUT`` consecutive nodes of a tree in order."""
    nodes = F.array_sort(F.collect_list(F.struct("at", *columns))).alias("nodes")
    return rows.groupBy("tree", F.expr(f"at div {FANOUT}").alias("run")).agg(F.max("n").alias("n"), nodes)


def _above(n: str) -> Column:
    return F.expr(f"({n} + {FANOUT - 1}) div {FANOUT}")


def _levels(runs: DataFrame, most: int) -> list[DataFrame]:
    """The levels above the leaves: ``tree, level, at, children, digest, n`` of each node; ``most`` leaves are in a tree at most."""
    levels, level = [], 0
    while most > 1:
        level, most = level + 1, -(-most // FANOUT)
        children = _joined(F.transform("nodes", lambda node: node["digest"]))
        rows = runs.where("n > 1").select("tree", F.lit(level).alias("level"), F.col("run").alias("at"), children.alias("children"), _above("n").alias("n"))
        levels.append(cut(rows.withColumn("digest", digest(_text(F.col("children"))))))
        runs = _runs(levels[-1], "digest")
    return levels


def _link(tree: Column, level: Column, at: Column, n: Column, sources: int) -> list[Column]:
    """The parent of a node that is one of ``n`` on its level, and its place there; null above the root."""
    top, none = n == 1, F.lit(None).cast("bigint")
    is_root = top & ((tree == ROOT_TREE) | F.lit(sources == 1))
    place = F.when(top, tree).otherwise(at)
    return [
        F.when(is_root, none).when(top, F.lit(ROOT_TREE)).otherwise(tree).cast("bigint").alias("up_tree"),
        F.when(is_root, none).when(top, F.lit(1)).otherwise(level + 1).cast("bigint").alias("up_level"),
        F.when(is_root, none).otherwise(F.floor(place / FANOUT)).cast("bigint").alias("up_at"),
        F.when(is_root, none).otherwise(place % FANOUT).cast("int").alias("place"),
    ]


# One row per run of leaves: they have all siblings but each other in common,
# so a step joins the parent's row once for the run, appends the siblings and
# folds the digest of each leaf of the run.
CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT tree, run, up_tree, up_level, up_at, place, folds, siblings FROM {{leaves}}
  UNION ALL
  SELECT c.tree, c.run, p.up_tree, p.up_level, p.up_at, p.place,
    transform(c.folds, f -> unhex(sha2(lower(hex(concat(substring(p.children, 1, {BYTES} * c.place), f, substring(p.children, {BYTES} * (c.place + 1) + 1)))), 256))),
    concat(c.siblings, substring(p.children, 1, {BYTES} * c.place), substring(p.children, {BYTES} * (c.place + 1) + 1))
  FROM climb c JOIN {{nodes}} p ON p.tree = c.up_tree AND p.level = c.up_level AND p.at = c.up_at
)
SELECT tree, run, folds, siblings FROM climb WHERE up_level IS NULL
"""


def _climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, run, folds, siblings`` at the root: what the leaves of a run fold to, and their siblings above the leaves."""
    spark = leaves.sparkSession
    conf, key = spark.conf, "spark.sql.cteRecursionRowLimit"
    limit = conf.get(key)
    conf.set(key, "-1")  # rows grow with the table; the depth of the trees ends the recursion
    try:
        return cut(spark.sql(CLIMB, leaves=leaves, nodes=nodes))
    finally:
        conf.set(key, limit)


def _before(i: Column) -> Column:
    """The digests of a run before its i-th node."""
    return _joined(F.slice(F.col("nodes.digest"), F.lit(1), i))


def _after(i: Column) -> Column:
    return _joined(F.slice(F.col("nodes.digest"), i + 2, F.lit(FANOUT)))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    The leaves of a source ascend by ``doc_id`` (null first; equal ids by
    digest, equal rows in any order, which changes no digest); every 16
    consecutive nodes make one of the level above until one is left, the
    subroot. The subroots by source (null first, then by UTF-8 bytes) make the
    root likewise. The siblings on the way from a leaf to the root are its
    proof. A recursive query ascends the stored nodes by their parents from the
    leaf as it is found now (where ``is_tampered``: its text in lower case) and
    folds it with the original siblings; ``verified`` says whether the root
    comes out. Only ``FIELDS`` are read; a null in any of them is a value of its
    own; an empty table has no rows.
    """
    text = F.when(is_tampered(F.col("doc_id")), lower_cased(F.col("text"))).otherwise(F.col("text"))
    rows = docs.select(*[F.col(c).cast("string" if c in ("source", "lang", "text") else "long").alias(c) for c in FIELDS])
    rows = rows.select("doc_id", "source", leaf().alias("digest"), leaf(text).alias("now"))
    rows = placed(cut(rows.withColumn("_tie", F.monotonically_increasing_id())), ["source"], ["doc_id", "digest", "_tie"])
    trees = placed(rows.groupBy("source").agg(F.max("n").alias("leaves")), [], ["source"]).select("source", "leaves", F.col("at").alias("tree"), F.col("n").alias("trees"))
    trees = cut(trees)
    sources, most = trees.agg(F.count("*"), F.coalesce(F.max("leaves"), F.lit(0))).first()
    if not sources:
        kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], kinds)

    numbered = rows.alias("r").join(lookup(trees).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    numbered = numbered.select("t.tree", "r.at", "r.n", "r.doc_id", "r.digest", "r.now")
    runs = cut(_runs(numbered, "doc_id", "digest", "now"))
    levels = _levels(runs, most)
    lone = numbered.where("n = 1").select("tree", "digest")
    subroots = reduce(DataFrame.unionByName, [level.where("n = 1").select("tree", "digest") for level in levels], lone)
    subroots = cut(subroots)
    top = subroots.select(F.lit(ROOT_TREE).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(sources).alias("n"), "digest")
    above = _levels(_runs(top, "digest"), sources)
    root = bytes((above[-1] if above else subroots).select("digest").first()[0])
    both = [level.select("tree", "level", "at", "children", *_link(F.col("tree"), F.col("level"), F.col("at"), F.col("n"), sources)) for level in levels + above]

    # The first step is within the run: each of its leaves has the others as siblings.
    first = F.transform("nodes", lambda node, i: F.when(F.col("n") == 1, node["now"]).otherwise(digest(_text(F.concat(_before(i), node["now"], _after(i))))))
    lone_run = F.col("n") == 1
    start = _link(F.col("tree"), F.when(lone_run, 0).otherwise(1), F.when(lone_run, F.lit(0)).otherwise(F.col("run")), _above("n"), sources)
    leaves = runs.select("tree", "run", *start, first.alias("folds"), F.lit(b"").alias("siblings"))
    if both:
        climbed = _climb(leaves, cut(reduce(DataFrame.unionByName, both)))
    else:
        climbed = leaves.select("tree", "run", "folds", "siblings")

    ended = runs.join(climbed, ["tree", "run"]).select("tree", "folds", "siblings", "nodes", F.posexplode("nodes").alias("i", "node"))
    i = F.col("i")
    proof = F.concat(_before(i), _after(i), F.col("siblings"))
    checked = ended.select("tree", F.col("node.doc_id").alias("doc_id"), _text(F.col("node.digest")).alias("leaf"), F.sha2(_text(proof), 256).alias("proof_sha256"), F.get("folds", i).alias("folded"))
    named = checked.join(lookup(subroots), "tree")
    return named.select(
        "doc_id", "leaf", _text(F.col("digest")).alias("subroot"), _text(F.lit(root)).alias("root"), "proof_sha256",
        _text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified"),
    )


MANIFEST_SQL = r"""
WITH RECURSIVE crc AS (SELECT row_number() OVER () AS id, doc_id, source, CASE WHEN doc_id IS NULL THEN false ELSE
    xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substring(doc_id::VARCHAR, i::INT, 1))::BIGINT),
      lambda c, x: list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END), xor(c, x)), 4294967295::BIGINT), 4294967295::BIGINT) % 5 = 0 END AS tampered,
    [CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
     CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END] AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
hashed AS (SELECT id, doc_id, source, tampered, sha256(array_to_string(head, '') || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(array_to_string(head, '') || CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END) AS altered FROM crc),
trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS n_trees FROM (SELECT DISTINCT source FROM documents)),
leaves AS (SELECT h.*, t.tree, t.n_trees, row_number() OVER (PARTITION BY t.tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS p, count(*) OVER (PARTITION BY t.tree) AS n
  FROM hashed h JOIN trees t ON h.source IS NOT DISTINCT FROM t.source),
lower_nodes AS (SELECT tree, 0 AS l, p, leaf AS d, n FROM leaves
  UNION ALL SELECT tree, l + 1, p // 16, sha256(string_agg(d, '' ORDER BY p)), (any_value(n) + 15) // 16 FROM lower_nodes WHERE n > 1 GROUP BY tree, l, p // 16),
upper_nodes AS (SELECT -1::BIGINT AS tree, 0 AS l, tree AS p, d, (SELECT count(*) FROM trees) AS n FROM lower_nodes WHERE n = 1
  UNION ALL SELECT tree, l + 1, p // 16, sha256(string_agg(d, '' ORDER BY p)), (any_value(n) + 15) // 16 FROM upper_nodes WHERE n > 1 GROUP BY tree, l, p // 16),
nodes AS (SELECT * FROM lower_nodes UNION ALL SELECT * FROM upper_nodes),
kids AS (SELECT tree, l, p // 16 AS q, list(d ORDER BY p) AS ds FROM nodes WHERE n > 1 GROUP BY 1, 2, 3),
climb AS (SELECT id, n_trees, tree, 0 AS l, p, n, CASE WHEN tampered THEN altered ELSE leaf END AS f, '' AS proof FROM leaves
  UNION ALL SELECT id, n_trees, CASE WHEN n > 1 THEN c.tree ELSE -1 END, CASE WHEN n > 1 THEN c.l + 1 ELSE 0 END, CASE WHEN n > 1 THEN p // 16 ELSE c.tree END, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE n_trees END,
    CASE WHEN n > 1 THEN sha256(array_to_string(ds[1 : p % 16], '') || f || array_to_string(ds[p % 16 + 2 :], '')) ELSE f END,
    CASE WHEN n > 1 THEN proof || array_to_string(ds[1 : p % 16], '') || array_to_string(ds[p % 16 + 2 :], '') ELSE proof END
  FROM climb c LEFT JOIN kids k ON k.tree = c.tree AND k.l = c.l AND k.q = c.p // 16 WHERE n > 1 OR c.tree <> -1),
root AS (SELECT d AS root FROM upper_nodes WHERE n = 1)
SELECT doc_id, leaf, s.d AS subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM leaves JOIN climb c USING (id) JOIN lower_nodes s ON s.tree = leaves.tree AND s.n = 1 JOIN root ON true WHERE c.tree = -1 AND c.n = 1
"""
