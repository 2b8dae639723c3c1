"""The registered queries of the package and the pipeline."""

from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from check import normal
from tests.llm.test_boilerplate import plain as plain_lines
from tests.llm.test_contamination import plain as plain_pairs
from tests.llm.test_simhash import plain_single
from tidelog.llm.boilerplate import SITES
from tidelog.llm.byte_bpe import Codec
from tidelog.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_one_query_for_each_operator():
    assert {name.split("_")[0] for name in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, oracle, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and normal(got) == normal(want)


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "", None, None, None), (10_002, "12 34 !", "en", "s", 7), (None, "the of and with no id", None, "s", 3)], SCHEMA)
    docs = docs.unionByName(odd).withColumn("extra", F.lit(1)).withColumn("row", F.lit("x"))
    rows = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]

    found = pipeline.identify_language(spark, docs, SF)
    assert found.columns == pipeline.COLUMNS
    kept = rows(found)
    assert sorted(str(d) for d, _, _ in kept) == sorted(str(d) for d, t, _ in rows(docs) if t and any(map(str.isalpha, t)))
    assert found.where("lang IS NULL").count() == 0

    lines = pipeline.remove_boilerplate(spark, found, SF)
    want = {(d, t) for d, t, _, gone in plain_lines(kept, SITES) if t.strip() or not gone}
    got = rows(lines)
    assert {(str(d), t) for d, t, _ in got} == want
    assert lines.where("n_chars <> length(text)").count() == 0

    single = pipeline.drop_near_copies(spark, lines, SF)
    want = plain_single([tuple(r) for r in lines.collect()], lambda r: (r[0] is None, r[0] or 0))
    assert sorted(map(tuple, single.collect()), key=str) == sorted(want, key=str)
    assert len(want) < len(got) and single.where("doc_id IS NULL").count() == 1

    clean = pipeline.drop_contaminated(spark, single, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, _, _ in plain_pairs([(d, t) for d, t, _ in rows(single)], items)}
    assert held and sorted(str(r[0]) for r in rows(clean)) == sorted(str(r[0]) for r in rows(single) if r[0] not in held)

    codec = Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = {r["doc_id"]: r["n_tokens"] for r in pipeline.tokenise(spark, clean, SF).collect()}
    assert tokens == {d: len(codec.encode(t)) // 4 for d, t, _ in rows(clean)}


def test_language_stage_gives_the_predicted_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mislabelled = docs.where((F.col("lang") == "en") & (F.length("text") > 900)).orderBy("doc_id").limit(1)
    mislabelled = mislabelled.withColumn("doc_id", F.lit(20_000).cast("long")).withColumn("lang", F.lit("de"))
    found = pipeline.identify_language(spark, docs.unionByName(mislabelled), SF)
    assert [r["lang"] for r in found.where("doc_id = 20000").collect()] == ["en"]


def test_stages_take_empty_and_null_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None)], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        # No letter, no language; and two empty texts are one group of near copies.
        assert stage(spark, nulls, SF).count() == {"language_id": 0, "simhash_dedup": 1}.get(name, 2), name


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, pipeline.run(spark, SF).collect()))
