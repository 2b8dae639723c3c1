"""A training corpus made from ``documents``, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and
returns a DataFrame: the columns of documents, and from the last stage the
token digests. Extra columns of ``docs`` are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import boilerplate, byte_bpe, contamination, language, simhash
from tidelog.llm.common import cut, held_out, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS = 3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the language the model finds in them as ``lang``; those without a letter (null and empty texts too) go."""
    docs = docs.select(*COLUMNS)
    found = language.with_language(docs, language.learn(docs, ~held_out("doc_id")))
    kept = found.where(F.col("lang_pred") != language.UNDETERMINED)
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; those that consist of nothing else go, a blank document stays."""
    cleaned = boilerplate.without_boilerplate(docs)
    blank = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(boilerplate.SPACE + "\n"))) == 0
    return cleaned.where(~(blank & (F.col("n_removed") > 0))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (three-word shingles, three bits): the smallest id, a null id last."""
    return simhash.without_near_copies(docs, SHINGLE_WORDS).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_boilerplate),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]

# SQL has neither the language model nor the fingerprints nor the merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if number < len(STAGES) else docs
    return docs
