"""Benchmark decontamination: short test items found inside documents of any length, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, lookup

WIDTH, CONTAINMENT = 5, 0.8
SPACE = " \t\n\x0b\f\r"


def words_of(text: str) -> Column:
    """Lower-cased words between runs of ASCII white space; null and blank texts have none."""
    trimmed = F.btrim(F.lower(F.col(text)), F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x09-\x0D\x20]+")).otherwise(F.array().cast("array<string>"))


def _word(words: str, at: Column, width: int) -> list[Column]:
    return [F.get(words, (at + i).cast("int")) for i in range(width)]


def _hash(words: str, at: Column, width: int) -> Column:
    return F.xxhash64(*_word(words, at, width))


def _starts(words: str, width: int) -> Column:
    return F.sequence(F.lit(0), F.size(words) - width)


def _shingles(words: str, width: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, width), lambda i: F.concat_ws(" ", *_word(words, i, width))))


def item_sketches(items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """``item, item_id, width, words, n, sketch`` for every item with a word.

    Items are partitioned by the power of two above their number ``n`` of
    distinct shingles. The sketch is the bottom of the item's MinHash values,
    and in a partition with at most u shingles it has floor((1 - c) * u) + 1 of
    them. A text that holds the share c of an item's shingles lacks at most
    floor((1 - c) * n) of them, so it holds a value of the sketch: the search
    misses nothing. An item with fewer words than a shingle is one shingle of
    its own width.
    """
    rows = items.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0).distinct()
    rows = cut(rows.withColumn("item", F.monotonically_increasing_id()).withColumn("width", F.least(F.lit(width), F.size("words"))))
    found = []
    for w in sorted(r["width"] for r in rows.select("width").distinct().collect()):  # width values at most
        hashes = F.array_sort(F.array_distinct(F.transform(_starts("words", w), lambda i: _hash("words", i, w))))
        found.append(rows.where(F.col("width") == w).withColumn("hashes", hashes).withColumn("n", F.size(_shingles("words", w))))
    if not found:
        return rows.select("item", "item_id", "width", "words", F.size("words").alias("n"), F.array().cast("array<bigint>").alias("sketch"))
    sized = found[0]
    for more in found[1:]:
        sized = sized.unionByName(more)
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    keep = (F.floor((1 - containment) * upper + 1e-9) + 1).cast("int")
    return sized.select("item", "item_id", "width", "words", "n", F.slice("hashes", F.lit(1), keep).alias("sketch"))


def contaminated_pairs(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_matched, containment`` of documents that hold an item.

    ``docs`` has ``doc_id, text`` and ``items`` has ``item_id, text``; other
    columns are ignored. First the documents' shingle hashes meet the items'
    sketches (see ``item_sketches``); only the items' side is ever broadcast,
    and only if its counted values are few. Then the candidates are verified by
    their exact distinct shingles. Null, blank and empty texts hold and name
    nothing. Rows with one doc_id are looked at one by one; a pair of ids that
    is found more than once is returned with its highest containment.
    """
    known = cut(item_sketches(items, width, containment))
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("digest"), words_of("text").alias("words"))
    if not widths:
        empty = rows.where(F.lit(False))
        return empty.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("n_shingles"), F.lit(0).alias("n_matched"), F.lit(0.0).alias("containment"))
    candidates, verified = None, None
    for w in widths:
        sketch = lookup(cut(known.where(F.col("width") == w).select("item", F.explode("sketch").alias("hash"))))
        hashed = (
            rows.where(F.size("words") >= w)
            .select("doc_id", "digest", "words", F.explode(_starts("words", w)).alias("at"))
            .select("doc_id", "digest", _hash("words", F.col("at"), w).alias("hash"))
        )
        met = hashed.join(sketch, "hash").select("doc_id", "digest", "item").distinct()
        candidates = met if candidates is None else candidates.unionByName(met)
    candidates = cut(candidates)
    near = lookup(candidates).alias("c")
    texts = rows.alias("d").join(near, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.digest") == F.col("c.digest")))
    texts = texts.select("d.doc_id", "d.words", "c.item")
    for w in widths:
        wanted = known.where(F.col("width") == w).select("item", "item_id", "n", _shingles("words", w).alias("shingles"))
        pairs = texts.join(wanted, "item").withColumn("n_matched", F.size(F.array_intersect("shingles", _shingles("words", w))))
        verified = pairs if verified is None else verified.unionByName(pairs)
    share = F.col("n_matched") / F.col("n")
    return (
        verified.withColumn("containment", share)
        .where(share >= containment - 1e-9)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("containment", "n", "n_matched")).alias("best"))
        .select("doc_id", "item_id", F.col("best.n").alias("n_shingles"), F.col("best.n_matched").alias("n_matched"), F.col("best.containment").alias("containment"))
    )


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in no contaminated pair; rows with a null id are judged together."""
    held = lookup(cut(contaminated_pairs(docs, items, **options).select("doc_id").distinct())).alias("held")
    kept = docs.alias("docs")
    return kept.join(held, F.col("docs.doc_id").eqNullSafe(F.col("held.doc_id")), "left_anti")


PAIRS_SQL = r"""
WITH items AS (
  SELECT item_id, list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s
  FROM (SELECT item_id, string_split_regex(trim(lower(text), e' \t\n\x0b\f\r'), '[\x09-\x0D\x20]+') AS w FROM benchmark) WHERE len(w) >= 5),
wanted AS (SELECT item_id, len(s) AS n, unnest(s) AS shingle FROM items),
words AS (SELECT doc_id, string_split_regex(trim(lower(text), e' \t\n\x0b\f\r'), '[\x09-\x0D\x20]+') AS w FROM documents),
held AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS shingle FROM words WHERE len(w) >= 5)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_matched, count(*) / n AS containment
FROM held JOIN wanted USING (shingle) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
"""
