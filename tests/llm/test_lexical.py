import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from tidelog.llm import lexical
from tidelog.llm.lexical import Treap, build_treap, rank_documents, search_treap

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERMS.findall((text or "").translate(UPPER))


def plain(docs, items, top=20):
    counted = [(d, Counter(w), len(w)) for d, t in docs if (w := terms(t))]
    n, total, df = len(counted), sum(c[2] for c in counted), Counter(t for _, c, _ in counted for t in c)
    found = []
    for item_id, text in set(items):
        scores = []
        for doc, tf, length in counted:
            m = 75 + 25 * length * n // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            scores.append((-score, doc is None, doc or 0, doc))
        best = [s for s in sorted(scores, key=lambda s: s[:3]) if s[0] < 0][:top]
        found += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(best, 1)]
    return sorted(found, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, rank string")
    b = spark.createDataFrame([(i, t, 1.0, "x") for i, t in items], "item_id long, text string, score double, terms string")
    found = rank_documents(d, b)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def corpus(seed, n, words=400):
    draw = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(words)] + ["Éa", "ÀB", "x_y", "日本", "Straße"]
    text = lambda k: " ".join(names[i] for i in np.minimum(draw.zipf(1.3, k) - 1, len(names) - 1))
    docs = [(i, text(int(draw.integers(1, 80)))) for i in range(n)]
    return docs, [(i, text(int(draw.integers(1, 30)))) for i in range(12)]


def test_equals_scoring_all(spark, monkeypatch):
    docs, items = corpus(1, 700)
    docs += [(5000 + i, docs[3][1]) for i in range(60)] + [docs[4]] * 3 + [(None, docs[5][1]), (None, None), (9000, None), (9001, ""), (9002, "--- !"), (9003, "w1 " * 30_000 + "rare")]
    items += [(100, None), (101, ""), (102, "unknownword"), (103, docs[3][1]), (103, docs[3][1]), (104, "rare RARE rare, w1"), (104, "w7"), (None, "w2 w3")]
    want = plain(docs, items)
    assert run(spark, docs, items) == want
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 50)
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 40)
    assert run(spark, docs, items) == want


def test_no_rows(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [(1, None), (2, "?")], [(1, "a")]) == []


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_treap_holds_its_points(n):
    draw = np.random.default_rng(n)
    places = draw.choice(1 << 12, n, replace=False)
    rows, columns, values = places >> 6, places & 63, draw.integers(1, 1000, n)
    treap = Treap(build_treap(rows, columns, values, 6))
    if not n:
        assert treap.empty
        return
    single = treap.row >= 0
    assert sorted(zip(treap.row[single], treap.column[single], treap.value[single])) == sorted(zip(rows, columns, values))
    inner = np.flatnonzero(~single)
    for cell in inner:  # values fall from a cell to its quadrants, and one of them has the largest
        below = treap.value[treap.first[cell] : treap.first[cell] + int(treap.mask[cell]).bit_count()]
        assert below.max() == treap.value[cell]
    dense = np.zeros((64, 64), np.int64)
    dense[rows, columns] = values
    wanted, weights = draw.integers(-1, 64, (5, 7)), draw.integers(0, 9, (5, 7))
    scores = np.where(wanted[:, :, None] >= 0, dense[wanted] * weights[:, :, None], 0).sum(axis=1)
    item, column, score = search_treap(treap, wanted, weights, np.zeros(5, np.int64), top=3)
    assert (scores[item, column] == score).all() and len(set(zip(item, column))) == len(item)
    for i in range(5):
        assert sorted(score[item == i])[::-1][:3] == [s for s in sorted(scores[i])[::-1][:3] if s > 0]
