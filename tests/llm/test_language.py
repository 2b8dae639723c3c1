import copy
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import language
from tidelog.llm.common import held_out, slices, word_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.learn(docs, ~held_out("doc_id"))


def best_path(scores, prior):
    """The best labels by trying all."""
    n, k = scores.shape
    value = lambda p: prior[p[0]] + sum(scores[i, x] for i, x in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
    return max(itertools.product(range(k), repeat=n), key=value)


def test_viterbi_equals_all_paths(model):
    draw = np.random.default_rng(4)
    for scale in (1, 10, 30):
        lengths = draw.integers(0, 7, 40)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        scores = draw.standard_normal((offsets[-1], len(model.langs))) * scale
        labels = model.spans(scores, offsets)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if a < b:
                assert tuple(labels[a:b]) == best_path(scores[a:b], model.prior)


def test_uneven_prior_equals_all_paths(model):
    draw, uneven = np.random.default_rng(9), copy.copy(model)
    uneven.prior = np.linspace(-9.0, 0.0, len(model.langs))
    for scale in (3, 6, 10):
        lengths = draw.integers(0, 7, 120)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        scores = draw.standard_normal((offsets[-1], len(model.langs))) * scale
        labels = uneven.spans(scores, offsets)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if a < b:
                assert tuple(labels[a:b]) == best_path(scores[a:b], uneven.prior)


def test_held_out_accuracy(docs, model):
    found = language.identify(docs, model).alias("p").join(docs.alias("d"), "doc_id").where(held_out("doc_id"))
    assert found.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_mixed_text_has_spans(spark, docs, model):
    part = lambda lang: " ".join(docs.where((F.col("lang") == lang) & (F.length("text") > 900)).orderBy("doc_id").first()["text"].split()[:80])
    text = f"{part('en')} {part('fr')} 12 -- {part('de')}"
    row = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "fr", "de"]
    assert sum(s["words"] for s in row["spans"]) == len(text.split())


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " 12 --!! "), (None, "the and with of"), (4, "the and with of"), (4, "the and with of"), (5, "x"), (6, "привет мир"), (7, "the of " * 60_000)]
    df = spark.createDataFrame([(*r, "zz", 1.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = language.identify(df, model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got if r["doc_id"] in (1, 2, 3)) == [("1", "und"), ("2", "und"), ("3", "und")]
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (None, 4, 7)} == {"en"}
    carried = language.with_language(df, model)
    assert carried.columns == ["doc_id", "text", "lang_pred", "score", "spans"] and carried.count() == len(rows)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.learn_and_identify(df.limit(1)).collect()} == {"und"}
    assert language.learn_and_identify(df.where("false")).count() == 0


def test_scripts(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("привет мир как дела", "ru"), ("hello world how are you", "en"), ("γειά σου κόσμε", "el")] * 30)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    found, _, _ = model.predict(pa.array(["мой дом", "my house", "σπίτι", "家"]))
    assert found[:3] == ["ru", "en", "el"]


def test_held_out_rows_teach_nothing(docs, model):
    other = docs.withColumn("lang", F.when(held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    again = language.learn(other, ~held_out("doc_id"))
    assert again.langs == model.langs and (again.table == model.table).all()


def test_helpers():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, "", "d"])], ["text"])
    assert [p.num_rows for p in slices([batch], "text", 10)] == [2, 1, 2]
    codes, offsets, words = word_table(pa.array(["x", " b  a\nb", None, "", "a"]).slice(1))
    assert [words[c] for c in codes] == ["b", "a", "b", "a"] and offsets.tolist() == [0, 3, 3, 3, 4]
