import numpy as np
import pytest

from tidelog.llm.embeddings import collision_threshold, embedding_groups, routing

SCHEMA = "vec_id long, embedding array<float>, rep int, weight string"


def plain(rows):
    """Links and components by all cosines."""
    vectors = [None if e is None or any(v is None or not np.isfinite(v) for v in e) or not any(e) else np.array(e, float) for _, e in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = vectors[i], vectors[j]
            if i != j and a is not None and b is not None and len(a) == len(b):
                linked[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    label = np.arange(n)
    for _ in range(n):
        label = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((str(vec_id), int(linked[i].sum()), str(least), vec_id is not None and vec_id == least))
    return sorted(out)


def rows(n=300, dims=32):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((n, dims)).astype(np.float32)
    near = base[:60] + draw.standard_normal((60, dims)) * draw.uniform(0.02, 0.3, (60, 1))
    vectors = [*base.tolist(), *near.astype(np.float32).tolist(), *(2 * base[:5]).tolist(), *base[:9].tolist()]
    vectors += [None, [0.0] * dims, [float("nan"), *[1.0] * (dims - 1)], [None, *[1.0] * (dims - 1)], [float("inf"), *[1.0] * (dims - 1)], [1.0, 0.0], [], [3.0, 0.0]]
    found = [(int(i), v) for i, v in enumerate(vectors)]
    return [*found, found[2], (None, found[4][1]), (None, draw.standard_normal(dims).astype(np.float32).tolist())]


@pytest.mark.parametrize("tile_rows", [1 << 13, 40])
def test_groups_equal_all_cosines(spark, tile_rows):
    data = rows()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], SCHEMA)
    got = embedding_groups(df, tile_rows=tile_rows).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == plain(data)


def test_recall_at_the_limit_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr("tidelog.llm.embeddings.routing", lambda n, c, r: routing(n, c, r, bucket=8))
    draw = np.random.default_rng(9)
    base = draw.standard_normal((600, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = draw.standard_normal((600, 48))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = base * 0.951 + side * np.sqrt(1 - 0.951**2)
    data = [(i, v.tolist()) for i, v in enumerate([*base, *near])]
    got = embedding_groups(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert sum(r["n_links"] for r in got.collect()) >= 0.98 * 1200


def test_calibration():
    assert routing(100) == (0, 1)
    bits, tables = routing(1 << 20)
    assert bits == 11 and tables > routing(1 << 15)[1]
    assert 20 <= collision_threshold(0.999) < collision_threshold(0.9) <= 32


def test_empty_table(spark):
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
