"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WORD_SLICE_BYTES, cut, held_out, slices, sums, word_table

# Labelled documents learned from (at most, in expectation), and terms of the lexicon.
TRAINING_ROWS, LEXICON_TERMS = 12_000, 5_000
# A term belongs to the lexicon from this many toxic documents and log odds on.
TERM_ROWS, TERM_ODDS = 5, 2.5
STEMS = (4, 5, 6)
NEAR_WORDS = 3
THRESHOLD = 0.3
TREES, DEPTH = 20, 3

# Second-person words of the languages in question (fixed values).
SECOND_PERSON = {"you", "your", "yours", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ti", "tus", "vosotros"}
# Signs often put in the place of letters (fixed values).
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
FEATURES = [
    "word_density", "stem_density", "word_hits", "stem_hits", "near_second_person", "second_person", "capitals",
    "capital_words", "punctuation", "exclamations", "obfuscated", "hidden_hits", "digits", "log_words",
]
_LETTERS = regex.compile(r"[^\p{L}]+")
_MASKED = regex.compile(r"\p{L}[^\p{L}\s.,;:'’\-]+\p{L}")


def _plain(word: str) -> str:
    return _LETTERS.sub("", word.lower())


def _word_features(word: str, words: set[str], stems: set[str]) -> tuple:
    """In lexicon as a word, as a stem; second person; capitals, letters, signs, exclamations, masked, only found unmasked, digits."""
    plain = _plain(word)
    hit, stem = plain in words, any(plain[:n] in stems for n in STEMS if len(plain) >= n)
    masked = _MASKED.search(word) is not None
    hidden = False
    if masked and not hit and not stem:
        shown = _plain(word.lower().rstrip("!?.,").translate(LOOKALIKES))
        hidden = shown in words or any(shown[:n] in stems for n in STEMS if len(shown) >= n)
    letters = len(plain)
    upper = sum(map(str.isupper, word))
    return hit, stem, plain in SECOND_PERSON, upper, letters > 1 and upper == letters, letters, len(word) - letters, word.count("!"), masked, hidden, sum(map(str.isdigit, word))


def text_features(texts: pa.Array, words: set[str], stems: set[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text; null and blank texts have zeros."""
    codes, offsets, distinct = word_table(texts)
    table = np.array([_word_features(w, words, stems) for w in distinct], float).reshape(-1, 11)
    rows = table[codes]
    total, n = sums(rows, offsets), np.diff(offsets)
    hits = (rows[:, 0] + rows[:, 1] + rows[:, 9]) > 0
    # Hits within a few words of a second-person word of the same text.
    text = np.repeat(np.arange(len(n)), n)
    near = np.zeros(len(codes), bool)
    for step in range(1, NEAR_WORDS + 1):
        same = text[step:] == text[:-step]
        near[step:] |= same & (rows[:-step, 2] > 0)
        near[:-step] |= same & (rows[step:, 2] > 0)
    close = sums((hits & near).astype(float), offsets)
    per_word, letters = np.maximum(1, n), np.maximum(1, total[:, 5])
    return np.column_stack([
        total[:, 0] / per_word, total[:, 1] / per_word, total[:, 0], total[:, 1], close / per_word, total[:, 2] / per_word, total[:, 3] / letters,
        total[:, 4] / per_word, total[:, 6] / np.maximum(1, total[:, 5] + total[:, 6]), total[:, 7] / per_word, total[:, 8] / per_word, total[:, 9], total[:, 10] / per_word, np.log1p(n),
    ])


def learn_lexicon(rows: DataFrame) -> tuple[set[str], set[str]]:
    """Words and stems of ``rows`` (``text``, ``toxic``) that toxic documents have far more often than others.

    Document counts over all of these rows; at most ``LEXICON_TERMS`` terms,
    those in most toxic documents first, go to the driver.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    long = lambda least: F.filter(words, lambda w: F.length(w) >= least)
    stems = [F.array_distinct(F.transform(long(n), lambda w, n=n: F.concat(F.lit("s:"), F.substring(w, 1, n)))) for n in STEMS]
    terms = rows.select("toxic", F.explode(F.concat(F.transform(long(2), lambda w: F.concat(F.lit("w:"), w)), *stems)).alias("term"))
    counts = F.count("*")
    bad = terms.where("toxic = 1").groupBy("term").agg(counts.alias("bad")).where(F.col("bad") >= TERM_ROWS)
    bad = cut(bad.orderBy(F.desc("bad"), "term").limit(20 * LEXICON_TERMS))
    good = terms.where("toxic = 0").join(F.broadcast(bad.select("term")), "term").groupBy("term").agg(counts.alias("good"))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(counts.alias("n")).collect()}
    odds = F.log((F.col("bad") + 0.5) / (size.get(1, 0) + 1)) - F.log((F.coalesce("good", F.lit(0)) + 0.5) / (size.get(0, 0) + 1))
    chosen = bad.join(good, "term", "left").where(odds >= TERM_ODDS).orderBy(F.desc("bad"), "term").limit(LEXICON_TERMS).collect()
    found = [r["term"] for r in chosen]
    return {t[2:] for t in found if t[0] == "w"}, {t[2:] for t in found if t[0] == "s"}


def featured(rows: DataFrame, lexicon: tuple[set[str], set[str]], keep: str) -> DataFrame:
    """The column ``keep`` and ``features`` of every row."""
    words, stems = lexicon

    def run(batches):
        for part in slices(batches, "text", WORD_SLICE_BYTES):
            found = text_features(part.column("text"), words, stems)
            lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(FEATURES), dtype=np.int32), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(keep), lists], [keep, "features"])

    kind = rows.schema[keep].dataType.simpleString()
    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, features array<double>")


class ToxicityModel:
    """Lexicon, trees and calibration; ``None`` trees give every text the share of toxic rows."""

    def __init__(self, lexicon, trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id, score`` of every row of ``docs`` (``doc_id``, ``text``); null and empty texts are scored as texts without words."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        if self.trees is None:
            return rows.select("doc_id", F.lit(self.share).alias("score"))
        found = featured(rows, self.lexicon, "doc_id").withColumn("features", array_to_vector("features"))
        raw = _probability(self.trees.transform(found))
        return self.calibration.transform(raw).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def _probability(df: DataFrame) -> DataFrame:
    return df.withColumn("probability", vector_to_array("probability")[1])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, most: int = TRAINING_ROWS) -> ToxicityModel:
    """Learns from labelled rows that are usable: a third of them for the calibration, the others for lexicon and trees.

    A sample of about ``most`` labelled documents, chosen by a hash of the id,
    bounds the work whatever the input. Rows with a null id, label or text and
    labels other than 0 and 1 are not learned from; a document with two labels
    counts as toxic if one of them is 1.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(usable)
    parts, there = 1 << 20, marked.count()
    if there > most:
        marked = marked.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(parts)) < parts * most // there)
    marked = cut(marked)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # The sample is bounded by a parameter, so it can be broadcast and the texts need no shuffle.
    rows = cut(texts.join(F.broadcast(marked), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"]))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = size.get(1, 0) / max(1, sum(size.values()))
    later = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(3)) == 0
    if min(size.get(0, 0), size.get(1, 0)) < 10:
        return ToxicityModel((set(), set()), None, None, share)
    lexicon = learn_lexicon(rows.where(~later))
    packed = featured(rows.select(F.struct("doc_id", "toxic", later.alias("later")).alias("row"), "text"), lexicon, "row")
    packed = cut(packed.select("row.*", array_to_vector("features").alias("features")).coalesce(4))
    trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxMemoryInMB=64).fit(packed.where(~F.col("later")))
    scored = _probability(trees.transform(packed.where("later"))).select("probability", F.col("toxic").cast("double").alias("toxic"))
    calibration = IsotonicRegression(featuresCol="probability", labelCol="toxic", predictionCol="score").fit(scored)
    return ToxicityModel(lexicon, trees, calibration, share)


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learned from the rows that are not held out, applied to all."""
    scored = learn(docs, labels, ~held_out("doc_id")).score(docs)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
