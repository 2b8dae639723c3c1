import zlib
from hashlib import sha256

import pytest

from tidelog.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, at int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def fields(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def build(nodes):
    """All levels of a tree, from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain(rows):
    by_source = {}
    for doc_id, source, lang, n_chars, text, *_ in rows:
        head = (doc_id, source, lang, n_chars)
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        altered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by_source.setdefault(source, []).append((doc_id, h(fields((*head, text))), h(fields((*head, low if altered else text)))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for s in sources}
    built = {s: build([leaf for _, leaf, _ in trees[s]]) for s in sources}
    above = build([built[s][-1][0] for s in sources])
    found = []
    for number, s in enumerate(sources):
        for at, (doc_id, leaf, now) in enumerate(trees[s]):
            folded, proof = now, []
            for levels, place in ((built[s], at), (above, number)):
                for level in levels[:-1]:
                    first = place // 16 * 16
                    run = level[first : first + 16]
                    proof += run[: place - first] + run[place - first + 1 :]
                    folded = h(*run[: place - first], folded, *run[place - first + 1 :])
                    place //= 16
            found.append((doc_id, leaf, built[s][-1][0], above[-1][0], h(*proof), folded, folded == above[-1][0]))
    return sorted(found, key=str)


def run(spark, rows):
    found = manifest(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


def rows(n, source, start=0):
    return [(start + i * 3, source, "en", i, f"Some Text {i}", "x", 1) for i in range(n)]


ODD = [(None, None, None, None, None, None, None), (None, "s", "en", 3, "ABC", None, None), (5, None, "é", 0, "", "x", 0), (5, None, "é", 0, "", "x", 0), (5, None, "é", 0, "Zwei", "x", 0), (7, "", "de", -1, "Ä" * 90_000 + "A\u0000B", "x", 0)]


@pytest.mark.parametrize(
    "given",
    [
        rows(700, "hot") + rows(17, "b") + rows(16, "c") + rows(1, "d") + rows(257, "é", 5) + ODD,
        [r for i in range(20) for r in rows(1 + i, f"s{i}", 1000 * i)],
        rows(1, "only"),
        rows(40, None),
        rows(1, "a") + rows(1, "b"),
        rows(3, "same", 5) * 30,
    ],
    ids=["levels", "sources", "one_row", "one_tree", "two_rows", "repeated"],
)
def test_equals_plain_trees(spark, given):
    found = run(spark, given)
    assert found == plain(given)
    texts = {r[0]: r[4] for r in given}
    tampered = [r for r in found if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    if len(given) > 600:
        assert tampered and not all(r[6] for r in tampered if texts[r[0]]) and all(r[6] for r in found if r not in tampered)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_a_changed_row_changes_the_root(spark):
    given = rows(50, "a")
    other = [(*given[0][:4], "Another", "x", 1), *given[1:]]
    assert {r[3] for r in run(spark, given)} != {r[3] for r in run(spark, other)}
