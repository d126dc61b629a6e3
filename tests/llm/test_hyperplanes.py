"""Embedding links against all cosines."""

import numpy as np
import pytest

from silolens.llm import hyperplanes
from tests.llm.helpers import reachable


def table(seed=4, kind="float"):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(30):
        centre = rng.standard_normal(16)
        rows += [centre + rng.standard_normal(16) * s for s in (0, 0.02, 0.1, 0.2)]
    rows = [list(map(float, np.float32(r) if kind == "float" else r)) for r in rows]
    rows += [rows[0], rows[0], [2 * x for x in rows[4]], None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [], [1.0] * 15 + [None], [1.0] * 5, [-0.0] * 15 + [1.0], [0.0] * 15 + [1.0]]
    return rows


def want_of(rows):
    n = len(rows)
    good = [r is not None and len(r) > 0 and all(x is not None and np.isfinite(x) for x in r) and any(r) for r in rows]
    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    pairs = [(i, j) for i in range(n) for j in range(i) if good[i] and good[j] and len(rows[i]) == len(rows[j]) and cosine(rows[i], rows[j]) >= 0.95]
    degree = [sum(i in p for p in pairs) for i in range(n)]
    return degree, reachable(n, pairs)


@pytest.mark.parametrize("kind, tile", [("float", 4096), ("double", 4096), ("float", 4)])
def test_links_and_components(spark, monkeypatch, kind, tile):
    monkeypatch.setattr(hyperplanes, "TILE_ROWS", tile)
    rows = table(kind=kind)
    frame = spark.createDataFrame([(i, r, "x", "y") for i, r in enumerate(rows)], f"vec_id long, embedding array<{kind}>, cid string, bucket string")
    got = {r.vec_id: r for r in hyperplanes.near_duplicates(frame, bits=6).collect()}
    degree, component = want_of(rows)
    assert [got[i].n_links for i in range(len(rows))] == degree
    assert [got[i].component_id for i in range(len(rows))] == component
    assert all(got[i].kept == (component[i] == i) for i in range(len(rows)))


def test_odd_and_empty_tables(spark):
    v = [1.0, 2.0]
    frame = spark.createDataFrame([(None, v), (1, v), (1, v), (2, v), (3, [2.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in hyperplanes.near_duplicates(frame).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("3", 0, "3", True), ("None", 0, "None", False)]
    assert hyperplanes.near_duplicates(frame.where("false")).count() == 0


def planted(n, d=64, seed=11):
    """``n`` pairs of vectors with cosines between 0.95 and 0.96."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cosine = rng.uniform(0.9501, 0.96, n)[:, None]
    return a, (cosine * a + np.sqrt(1 - cosine**2) * b) * rng.uniform(0.1, 9, n)[:, None]


def test_recall_of_planted_pairs(spark, sf):
    """The registered parameters find pairs just above the threshold among the given vectors."""
    a, b = planted(1500)
    given = [list(map(float, r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    vectors = [list(map(float, x)) for pair in zip(a, b) for x in pair] + given
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r for r in hyperplanes.near_duplicates(frame).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert linked[:3000].min() == 1
    found = sum(got[2 * i].component_id == 2 * i == got[2 * i + 1].component_id for i in range(1500))
    assert found >= 0.98 * 1500
    assert all(got[i].n_links <= linked[i] for i in got)


def test_very_large_and_small_components(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [-4.0, 3.0, 2.0, -1.0]
    rows = [v, [x * 1e200 for x in v], [x * 1e-200 for x in v], [x * 1e307 for x in w], w, [5e-324, 0.0, 0.0, 0.0], [1.7e308] * 4, [1.0] * 4]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hyperplanes.near_duplicates(frame).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6)}
