import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import toxicity
from tidelog.llm.common import held_out

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.learn(*tables, ~held_out("doc_id"))


def auc(rows):
    scores, labels = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    bad, good = scores[labels == 1], scores[labels == 0]
    return np.mean(bad[:, None] > good) + np.mean(bad[:, None] == good) / 2


def test_held_out_quality(tables, model):
    docs, labels = tables
    rows = model.score(docs).join(labels, "doc_id").where(held_out("doc_id")).collect()
    assert auc(rows) > 0.9


def test_odd_rows(spark, model):
    text = "You are an idiot and a stupid moron, worthless scum. "
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, "1d!ot m0ron stup1d you"), (5, text * 3000), (6, "§$%")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, features string, score double")
    got = [(r["doc_id"], r["score"]) for r in model.score(df).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert min(by[3], by[None], by[5]) >= toxicity.THRESHOLD > max(by[1], by[2], by[6])


def test_features():
    words, stems = {"idiot"}, {"chlla"}
    texts = pa.array([None, "", "You IDIOT! fine", "id10t chllaundo", "plain words"])
    found = toxicity.text_features(texts, words, stems)
    named = lambda row: dict(zip(toxicity.FEATURES, found[row]))
    assert not found[:2].any()
    assert named(2)["word_hits"] == 1 and named(2)["near_second_person"] == pytest.approx(1 / 3) and named(2)["capital_words"] == pytest.approx(1 / 3)
    assert named(3)["stem_hits"] == 1 and named(3)["hidden_hits"] == 1 and named(3)["obfuscated"] == 0.5
    assert named(4)["word_hits"] == 0 and named(4)["log_words"] == pytest.approx(np.log(3))


def test_without_usable_labels(spark, tables):
    docs = tables[0].limit(20)
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = toxicity.learn_and_score(docs, none).collect()
    assert len(got) == 20 and {r["score"] for r in got} == {0.0} and {r["predicted"] for r in got} == {0}
    assert toxicity.learn_and_score(docs.where("false"), tables[1]).count() == 0


def test_held_out_labels_teach_nothing(tables, model):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.learn(docs, turned, ~held_out("doc_id"))
    assert again.lexicon == model.lexicon and again.trees.toDebugString.split("\n", 1)[1] == model.trees.toDebugString.split("\n", 1)[1]
