import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import vectors as V


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>, vec string, a int")


def test_quantile():
    assert V.chi2_quantile(0.95, 16) == pytest.approx(26.296, abs=1e-3)


def test_more_rows_more_trees():
    assert V.depth_and_trees(100, 0.9)[0] == 0
    assert V.depth_and_trees(10**8, 0.9)[1] > V.depth_and_trees(10**5, 0.9)[1]


def test_recall_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    near = x[:600] + 0.25 * rng.standard_normal((600, 64))
    x = np.vstack([x, near])
    x *= rng.uniform(0.1, 9, (len(x), 1))
    monkeypatch.setattr(V, "LEAF", 256)
    monkeypatch.setattr(V.depth_and_trees, "__defaults__", (256, V.RECALL))
    got = {(r["id_a"], r["id_b"]) for r in V.similar_pairs(frame(spark, [(i, v.tolist(), "x", 1) for i, v in enumerate(x)])).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(u @ u.T, 1) >= 0.9)
    want = set(zip(i.tolist(), j.tolist()))
    assert len(want) > 300 and len(got & want) >= 0.97 * len(want)
    assert all(u[a] @ u[b] > 0.899 for a, b in got)


def test_unusable_vectors_and_copies(spark):
    e = [1.0] + [0.0] * 63
    rows = [(1, e, "", 0), (1, e, "", 0), (2, [2.0] + [0.0] * 63, "", 0), (3, [0.0] * 64, "", 0), (4, [], "", 0), (5, None, "", 0), (6, [float("nan")] * 64, "", 0), (7, [1.0], "", 0), (None, e, "", 0), (8, [None] + [1.0] * 63, "", 0), (9, [1e30] + [0.0] * 63, "", 0)]
    got = {(r["id_a"], r["id_b"]) for r in V.similar_pairs(frame(spark, rows)).collect()}
    assert got == {(1, 2), (1, 9), (2, 9)}


def test_a_large_class_of_copies_links_each_member(spark):
    e = [1.0] * 64
    got = V.similar_pairs(frame(spark, [(i, e, "", 0) for i in range(200)])).collect()
    ends = {r["id_a"] for r in got} | {r["id_b"] for r in got}
    assert ends == set(range(200)) and len(got) <= 200 * 10


def test_empty(spark):
    assert V.similar_pairs(frame(spark, [])).count() == 0
    assert V.nearest(frame(spark, []), frame(spark, [])).count() == 0


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64)).astype("f4")
    df = frame(spark, [(i, v.tolist(), "", 0) for i, v in enumerate(x)])
    got = V.nearest(df, df.filter("id % 100 = 0"), k=5).orderBy("q", "rank").collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in (0, 100, 200):
        s = u @ u[q]
        s[q] = -2
        assert [r["id"] for r in got if r["q"] == q] == np.argsort(-s)[:5].tolist()
    assert got[0]["cosine"] <= 1 and df.filter(F.col("id") < 0).count() == 0


def test_knn_recall_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64)).astype("f4")
    x[:400] = x[400:800] + 0.3 * rng.standard_normal((400, 64))
    monkeypatch.setattr(V.depth_and_trees, "__defaults__", (700, V.RECALL))
    monkeypatch.setattr(V, "CELL", 700)
    got = V.knn(frame(spark, [(i, v.tolist(), "x", 1) for i, v in enumerate(x)])).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, j) for i, js in enumerate(np.argsort(-s, axis=1)[:, :10].tolist()) for j in js}
    found = {(r["q"], r["id"]) for r in got}
    assert len(got) == 30_000 and len(found & want) >= 0.9 * len(want)
    assert max(r["rank"] for r in got) == 10


def test_the_test_tightens_with_the_kth_best():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 64)).astype("f4")
    x /= np.linalg.norm(x, axis=1)[:, None]
    p = x @ V.projection(3, 64)
    i, j, c = V.search(x, p, 5, -1.0)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(a, b) for a, bs in enumerate(np.argsort(-s, axis=1)[:, :5].tolist()) for b in bs}
    assert len(i) == 7500 and len(set(zip(i.tolist(), j.tolist())) & want) >= 0.93 * len(want)
    assert (np.abs(s[i, j] - c) < 1e-3).all()


def test_dense_cells_are_split(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.standard_normal((500, 64)), rng.standard_normal(64) + 0.001 * rng.standard_normal((3000, 64))])
    df = frame(spark, [(i, v.tolist(), "x", 1) for i, v in enumerate(x)])
    points = V.unit_vectors(df, "id", "embedding", 64).select("id", "vec").cache()
    monkeypatch.setattr(V, "FIT_ROWS", 300)
    forest = V.build(points, 3500, 64, 3, 2, cell=100)
    sizes = points.mapInArrow(V._cells(forest, counts=True), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 7000 and max(r["n"] for r in sizes) <= 400


def test_leaves_hold_all_rows():
    p = np.random.default_rng(8).standard_normal((1000, 16)).astype("f4")
    got = V.leaves(p, 130)
    assert sorted(np.concatenate(got).tolist()) == list(range(1000)) and max(map(len, got)) <= 130
    assert V.trees_for(np.full(10, 0.4), 3, 0.9) > V.trees_for(np.full(10, 0.9), 3, 0.9)


def test_knn_of_copies_and_of_nothing(spark):
    e, f = [1.0] + [0.0] * 63, [1.0, 1.0] + [0.0] * 62
    rows = [(i, e, "", 0) for i in range(30)] + [(99, f, "", 0), (100, [0.0] * 64, "", 0), (101, None, "", 0), (None, e, "", 0)]
    got = V.knn(frame(spark, rows), k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["q"], []).append((r["rank"], r["id"], round(r["cosine"], 3)))
    assert sorted(by[0]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)] and sorted(by[29])[0] == (1, 0, 1.0)
    assert sorted(by[99]) == [(1, 0, 0.707), (2, 1, 0.707), (3, 2, 0.707)] and set(by) == {*range(30), 99}
    assert V.knn(frame(spark, [])).count() == 0
