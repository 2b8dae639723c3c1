"""Line dedup by the spread of a line over sites, by DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, lookup

# Distinct sites from which on a line is boilerplate. Lines of near copies reach
# 2 to 6 sites, passages that are repeated on purpose 10 or more; the limit is
# nearer to the copies because a hot site, one that has a third of all rows,
# makes the documents of a passage share it.
SITES = 7
# 2**LG_K registers: a standard error of 1.04 / 64, below 2 %.
LG_K = 12
SPACE = " \t\x0b\f\r"


def _keys() -> list[Column]:
    """Two independent 64-bit hashes of a trimmed line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")]


def site_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, source, digest, at, h1, h2`` of every line that is not blank; ``at`` counts from 0."""
    lines = docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    lines = lines.withColumn("line", F.btrim("raw", F.lit(SPACE))).where(F.length("line") > 0)
    return lines.select("doc_id", "source", "digest", "at", *_keys())


def boilerplate_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """``h1, h2, first`` of lines on at least so many distinct sites; ``first`` is their smallest doc_id.

    Each line hash has a HyperLogLog sketch of its sites, built in the tasks
    that read the lines and merged by the aggregation. Lines whose estimate is
    within four standard errors of the limit are counted exactly.
    """
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("source", LG_K).alias("sketch"), F.min("doc_id").alias("first"))
    band = 1 + ceil(4 * sites * 1.04 / 2 ** (LG_K / 2))
    spread = sketches.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("spread"))
    likely = cut(spread.where(F.col("spread") >= sites - band))
    near = lookup(likely.where(F.col("spread") <= sites + band).select("h1", "h2", "first"))
    counted = lines.join(near, ["h1", "h2"]).groupBy("h1", "h2", "first").agg(F.count_distinct("source").alias("spread"))
    exact = counted.where(F.col("spread") >= sites).select("h1", "h2", "first")
    return cut(likely.where(F.col("spread") > sites + band).select("h1", "h2", "first").unionByName(exact))


def without_boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """The columns of ``docs`` with boilerplate lines cut out of ``text``, and ``n_lines``, ``n_removed``.

    A line is boilerplate if its trimmed form is on at least ``sites`` distinct
    sites. The document with the smallest id that has it keeps it, so no
    passage disappears altogether; all others lose each of its occurrences.
    Blank lines stay. A null site is no site, a null text stays null without
    lines, and a null id is never the smallest unless all are null. Equal rows
    are treated alike.
    """
    lines = site_lines(docs.select("doc_id", F.col(site).cast("string").alias("source"), "text"))
    known = lookup(boilerplate_lines(lines, sites))
    hits = lines.join(known, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = lookup(cut(hits.groupBy("doc_id", "digest").agg(F.collect_set("at").alias("gone"))), "gone")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("digest")).alias("d")
    g = gone.alias("g")
    joined = own.join(g, F.col("d.row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.digest") == F.col("g.digest")), "left")
    split = F.split("row.text", "\n")
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("text")
    columns = [text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


LINES_SQL = rf"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
trimmed AS (SELECT *, trim(raw, e' \t\x0b\f\r') AS line FROM lines),
spread AS (SELECT line, min(doc_id) AS first FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
marked AS (SELECT t.*, s.line IS NOT NULL AND t.doc_id <> s.first AS gone FROM trimmed t LEFT JOIN spread s USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
