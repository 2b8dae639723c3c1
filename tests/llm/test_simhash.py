import re

import numpy as np
import pytest
import xxhash

from tidelog.llm.components import Forest, connected_components
from tidelog.llm.simhash import fingerprint, simhash_groups, without_near_copies

WORDS = ["alpha", "Beta", "gamma", "DELTA", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), root in zip(rows, label):
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    return sorted((str(d), f"{fp:016x}", str(least.get(root))) for (d, _), fp, root in zip(rows, fps, label))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    texts = [" ".join(draw.choice(WORDS, n)) for n in draw.integers(1, 120, 60)]
    near = [re.sub(r"\S+", "changed", t, count=1) for t in texts[:30] if len(t) > 400]
    texts += near + texts[:5] + ["", None, "  \t\n", "one", "ONE", "a b", "x y z", "  spaced \t out\x0bwords\x1cnot "]
    rows = [(int(i), t) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[0]), (None, "only without an id here")]


@pytest.mark.parametrize("tile_rows", [1 << 16, 7])
def test_groups_equal_brute_force(spark, rows, tile_rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash_groups(df, tile_rows=tile_rows).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == plain_groups(rows)


def plain_single(rows, key):
    """Of each group of near copies the row that comes first by ``key``, and whatever is equal to none of the rest."""
    fps = [plain_fingerprint(r[1]) for r in rows]
    left, found = set(range(len(rows))), []
    while left:
        group, more = set(), {next(iter(left))}
        while more:
            group |= more
            more = {j for j in left - group if any((fps[i] ^ fps[j]).bit_count() <= 3 for i in more)}
        left -= group
        found.append(min((rows[i] for i in group), key=key))
    return found


def test_one_row_of_each_group_stays(spark, rows):
    schema = "doc_id long, text string, row int, digest string"
    given = [(d, t, 1, "x") for d, t in rows]
    first, second = given[0], given[1]
    # Two texts under one id, a copy of the second under another, one row thrice, and equal copies that differ in a column.
    given += [(first[0], second[1], 1, "x"), (90_000, second[1], 1, "x"), given[2], given[2], (70_000, "some very own words in here", 1, "b"), (70_000, "some very own words in here", 2, "a")]
    df = spark.createDataFrame(given, schema)
    digest = {tuple(r)[:4]: r["h"] for r in df.selectExpr("*", "xxhash64(doc_id, text, row, digest) AS h").collect()}
    want = plain_single(given, lambda r: (r[0] is None, r[0] or 0, digest[r]))
    kept = without_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    other = without_near_copies(spark.createDataFrame(given[::-1], schema).repartition(7))
    assert sorted(map(tuple, other.collect()), key=str) == sorted(want, key=str)
    assert without_near_copies(df.limit(0)).count() == 0


def test_no_text_is_lost(spark):
    """A row goes only if one of its own group stays, even if ids name several texts."""
    a, b = "alpha beta gamma delta " * 9, "one two three four five six " * 7
    df = spark.createDataFrame([(1, a), (1, b), (2, b)], "doc_id long, text string")
    assert sorted(map(tuple, without_near_copies(df).collect())) == [(1, a), (1, b)]


def test_fingerprints_in_pieces(monkeypatch):
    text = " ".join(np.random.default_rng(1).choice(WORDS, 500))
    whole = fingerprint(text)
    monkeypatch.setattr("tidelog.llm.simhash.HASHED_AT_ONCE", 7)
    assert fingerprint(text) == whole == plain_fingerprint(text)


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    odd = [(5000, 5000), (None, 7), (8, None), (2000, 2001), (2001, 2000)]
    df = spark.createDataFrame([*chain, *star, *odd], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()}
    want = {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 80)} | {2001: 2000}
    assert got == want


def test_forest():
    forest = Forest(6)
    forest.unite_pairs(np.array([1, 1, 4]), np.array([2, 3, 3]))
    assert forest.roots(np.arange(6)).tolist() == [0, 1, 1, 1, 1, 5]
