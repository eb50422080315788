import numpy as np
import pytest

from xylem.llm import topk as t


def nearest(v, queries, k):
    d = np.sqrt(((v[queries, None] - v[None]) ** 2).sum(2))
    return {(q, r + 1, j) for n, q in enumerate(queries) for r, j in enumerate(sorted((j for j in range(len(v)) if j != q), key=lambda j: (d[n, j], j))[:k])}


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("every", [1, 20])
def test_against_brute_force(spark, every):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 40)).round(2)
    v[100:110] = v[0]  # ties
    got = {(r.vec_id, r["rank"], r.neighbor_id) for r in t.top_k(table(spark, v), 7, every, block_rows=64, query_rows=16).collect()}
    assert got == nearest(v, range(0, 300, every), 7)


def test_clusters_far_apart(spark, monkeypatch):
    """Most blocks of vectors lie beyond every bound; one cluster holds a third of all, another fewer than k."""
    monkeypatch.setattr(t, "PIVOTS", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12)) * 50
    of = np.array([0] * 100 + [1] * 60 + [2] * 60 + [3] * 60 + [4] * 17 + [5] * 3)
    v = (centres[of] + rng.normal(size=(300, 12))).round(3)
    got = {(r.vec_id, r["rank"], r.neighbor_id) for r in t.top_k(table(spark, v), 5, 3, block_rows=32, query_rows=8).collect()}
    assert got == nearest(v, range(0, 300, 3), 5)


def test_hostile_tables(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0], 1), (1, [0.0, 0.0], 2), (2, [3.0, 4.0], 3), (3, None, 4), (None, [1.0, 1.0], 5), (4, [], 6), (5, [1.0, None], 7), (6, [nan, 1.0], 8), (7, [1.0, 2.0, 3.0], 9), (8, [float("inf"), 0.0], 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, VEC_ID int")
    assert sorted((r.vec_id, r["rank"], r.neighbor_id, r.distance) for r in t.top_k(df, every=1).collect()) == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]
    assert [tuple(r) for r in t.top_k(df, every=2).collect()] == [(2, 1, 1, 5.0)] and t.top_k(df).collect() == []
    assert t.top_k(df.limit(0)).collect() == []
