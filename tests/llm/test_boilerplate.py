from collections import Counter

import numpy as np

from tidelog.llm.boilerplate import SITES, without_boilerplate


def plain(rows, sites):
    spread, first = {}, {}
    for doc_id, text, source in rows:
        for line in (text or "").split("\n"):
            line = line.strip(" \t\r\x0b\f")
            if line:
                spread.setdefault(line, set()).update([source] if source is not None else [])
                if doc_id is not None:
                    first[line] = min(first.get(line, doc_id), doc_id)
    found = []
    for doc_id, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        gone = [len(spread.get(x.strip(" \t\r\x0b\f"), ())) >= sites and first.get(x.strip(" \t\r\x0b\f")) != doc_id for x in lines]
        found.append((str(doc_id), None if text is None else "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(found, key=str)


ROWS = [
    *((i, f"own line {i}\n Shared\t\n\nfour sites {i % 4}\nmiddle", f"s{i % 12}") for i in range(40)),
    *((100 + i, "nine\n" + "long " * 9000, f"s{i}") for i in range(9)),
    *((200 + i, "ten\nten\r\nkept", f"s{i}") for i in range(10)),
    (300, None, "s1"), (301, "", "s2"), (302, "Shared", None), (None, "Shared\nno id", "s3"), (303, "only", None), (3, "own line 3\n Shared\t\n\nfour sites 3\nmiddle", "s3"),
]


def test_equals_brute_force(spark):
    schema = "doc_id long, text string, source string, n_lines int, line string, gone string"
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in ROWS], schema)
    for sites in (10, SITES, 4):
        found = without_boilerplate(df, sites)
        assert found.columns == ["doc_id", "text", "source", "line", "gone", "n_lines", "n_removed"]
        got = [(str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()]
        assert sorted(got, key=str) == plain(ROWS, sites)


def test_recall_of_long_passages_with_a_hot_site(spark):
    """Passages of over 50 words in 20 to 27 documents, of which a third lie on one site; and lines of small groups of copies."""
    draw = np.random.default_rng(4)
    passages = [" ".join(f"p{i}w{j}" for j in range(60)) for i in range(200)]
    copies = [" ".join(f"c{i}w{j}" for j in range(60)) for i in range(200)]
    rows = []
    for lines, low, high in ((passages, 20, 27), (copies, 2, 6)):
        for line in lines:
            for _ in range(int(draw.integers(low, high + 1))):
                site = 0 if draw.random() < 1 / 3 else int(draw.integers(1, 20))
                rows.append((len(rows), f"own {len(rows)}\n{line}", f"s{site}"))
    found = without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    left = Counter(line for r in found for line in r["text"].split("\n"))
    assert sum(left[p] == 1 for p in passages) >= 0.99 * len(passages)
    there = Counter(t.split("\n")[1] for _, t, _ in rows)
    assert all(left[c] == there[c] for c in copies) and sum(r["n_removed"] for r in found) == sum(there[p] - left[p] for p in passages)


def test_all_ids_null(spark):
    df = spark.createDataFrame([(None, "Shared", f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    assert {r["text"] for r in without_boilerplate(df).collect()} == {"Shared"}


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    found = without_boilerplate(df)
    assert found.count() == 0
    assert "Arrow" not in found._jdf.queryExecution().toString() and "Python" not in found._jdf.queryExecution().toString()
