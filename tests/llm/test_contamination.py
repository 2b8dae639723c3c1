import numpy as np
import pytest

from tidelog.llm.contamination import contaminated_pairs, item_sketches, without_contaminated


def shingles(text, width):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain(docs, items):
    found = {}
    for item_id, item in items:
        width = min(5, len((item or "").split()))
        wanted = shingles(item, width) if width else set()
        for doc_id, text in docs:
            share = len(wanted & shingles(text, width)) / len(wanted) if wanted else 0
            if share >= 0.8:
                found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), share)
    return {(d, i, round(s, 9)) for (d, i), s in found.items()}


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    items = [(int(i), " ".join(draw.choice(words, n))) for i, n in enumerate(draw.integers(5, 60, 40))]
    items += [(40, "Short ITEM"), (41, "lonely"), (42, ""), (43, None), (44, " \t"), (45, "same same same same same same same"), (2, items[2][1]), (2, "another text with the same id here"), (None, items[5][1])]
    docs = []
    for i in range(150):
        body = list(draw.choice(words, draw.integers(1, 400)))
        if i % 3 == 0 and (item := items[i % 40][1].split()):
            for _ in range(draw.integers(0, 4)):  # some words changed
                item[draw.integers(len(item))] = "changed"
            at = draw.integers(len(body))
            body[at:at] = [w.upper() for w in item] if i % 2 else item
        docs.append((i, "\n ".join(body)))
    docs += [(150, "a short\titem b"), (151, "lonely"), (152, None), (153, ""), (154, "same " * 50), (155, f"x {items[0][1]} " * 300), (None, items[1][1]), docs[0], (3, items[7][1]), (156, "another text with the same id here")]
    return docs, items


def test_pairs_equal_brute_force(spark, data):
    docs, items = data
    left = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, n string")
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"], round(r["containment"], 9)) for r in contaminated_pairs(left, right).collect()}
    want = plain(docs, items)
    assert len(want) > 30 and got == want
    kept = without_contaminated(left, right)
    assert kept.columns == left.columns
    held = {d for d, _, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in held)


def test_sketch_sizes(spark, data):
    for row in item_sketches(spark.createDataFrame(data[1], "item_id long, text string")).collect():
        assert int(0.2 * row["n"] + 1e-9) < len(row["sketch"]) or len(row["sketch"]) == row["n"]


def test_empty_tables(spark, data):
    docs = spark.createDataFrame(data[0], "doc_id long, text string")
    items = spark.createDataFrame(data[1], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated_pairs(docs, none).count() == 0
    assert contaminated_pairs(docs.limit(0), items).count() == 0
    assert without_contaminated(docs, none).count() == docs.count()


def test_no_python_in_the_plan(spark, data):
    docs = spark.createDataFrame(data[0], "doc_id long, text string")
    plan = contaminated_pairs(docs, spark.createDataFrame(data[1], "item_id long, text string"))
    assert "Arrow" not in plan._jdf.queryExecution().toString() and "Python" not in plan._jdf.queryExecution().toString()
