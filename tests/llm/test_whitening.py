"""Whitening against numpy's own decomposition and whole-number arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from duoscope.llm import REGISTRY, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, row int, x string, deviation double"


def whole(c):
    return math.floor(256 * c)


def brute(rows):
    """Per row: vec_id, exact deviation; eigenvalues, vectors and means of the distinct list."""
    kept = [(i, tuple(map(whole, v))) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({x for _, x in kept})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    y = np.array(listed, float) - mean
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return ([(i, x, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept], n, mean, values[::-1], vectors[:, ::-1])


@pytest.mark.parametrize("d, rank, spread", [(1, 1, 0), (2, 2, 3), (7, 4, 6), (30, 30, 8), (64, 64, 2), (33, 5, 0)])
def test_decomposition(d, rank, spread):
    rng = np.random.default_rng(d + rank)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :rank]
    wanted = np.sort(10.0 ** rng.uniform(-spread, spread, rank))[::-1]
    v = (q * wanted) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.eigen(v)
    assert len(values) >= rank or spread > 5
    few = min(len(values), rank)
    assert np.allclose(values[:few], wanted[:few], rtol=1e-9, atol=wanted[0] * 1e-13)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.allclose((vectors * values) @ vectors.T, v, atol=wanted[0] * 1e-12)


def test_small_eigenvalues_are_precise():
    """A graded matrix: each eigenvalue to nearly all digits, the smallest too."""
    d = np.diag(10.0 ** -np.arange(0, 12, 2))
    c = np.eye(6) + 0.1 * (np.ones((6, 6)) - np.eye(6))
    v = d @ c @ d * 1e3
    values, _ = whitening.eigen(v)
    assert len(values) == 6 and np.isclose(np.prod(values), np.prod(np.diag(d)) ** 2 * np.linalg.det(c) * 1e18, rtol=1e-10)


def test_equal_eigenvalues_and_nothing():
    values, vectors = whitening.eigen(np.eye(5) * 3)
    assert np.allclose(values, 3) and np.allclose(vectors.T @ vectors, np.eye(5))
    values, vectors = whitening.eigen(np.zeros((3, 3)))
    assert len(values) == 0 and vectors.shape == (3, 0)


def test_triangular():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 5))
    v = a @ a.T
    factor, order = whitening.pivoted_cholesky(v)
    assert factor.shape == (9, 5) and np.allclose(np.triu(factor[:5], 1), 0)
    assert np.allclose(factor @ factor.T, v[np.ix_(order, order)])


def check(rows, got):
    kept, n, mean, values, vectors = brute([(r[0], r[1]) for r in rows])
    d = len(mean)
    scale = np.sqrt(np.maximum(values, 0))
    assert len(got) == len(kept) * min(4, d)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, x, deviation in kept:
        stored = by_id[(i, deviation if deviation < 1 << 63 else None)]
        assert sorted(stored) == list(range(1, min(4, d) + 1))
        for k, same in stored.items():
            for r in same:
                assert r.n == n
                if values[k - 1] > 1e-9 * max(values[0], 1e-300):
                    w = float((np.array(x, float) - mean) @ vectors[:, k - 1] / scale[k - 1])
                    signs.setdefault(k, 1 if abs(w - r.whitened) < abs(w + r.whitened) else -1) if abs(w) > 1e-3 else None
                    assert abs(w * signs.get(k, 1) - r.whitened) < 1e-6 * max(1, abs(w))
                    assert math.isclose(r.explained, values[k - 1] / values.sum(), rel_tol=1e-6)
                    assert r.identity_error < 1e-4
                else:
                    assert r.whitened is None


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, REGISTRY["op11_whitening"][0](spark, SF).collect())


def run(spark, tmp_path, rows):
    folder = str(tmp_path / "t")
    spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], VECTORS).write.parquet(folder + "/embeddings.parquet")
    return REGISTRY["op11_whitening"][0](spark, folder).collect()


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, rng.normal(size=5)))) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [nan, 1.0, 1.0, 1.0, 1.0]), (103, [inf, 1.0, 1.0, 1.0, 1.0]),
             (None, [-0.0, 0.0, 1.0, -1.0, 0.5]), (3, rows[3][1]), (3, rows[3][1]), (104, rows[5][1])]
    got = run(spark, tmp_path, rows + [(105, [1.0, 2.0]), (106, [])])  # other lengths come back without components
    check(rows, got)


def test_large_and_far_values(spark, tmp_path):
    """Beyond what 64 bits hold on the way: deviations are exact, or null where they do not fit."""
    rng = np.random.default_rng(4)
    check(rows := [(i, [float(1e7 + c) for c in rng.integers(0, 100, 3)]) for i in range(50)], run(spark, tmp_path / "a", rows))
    check(rows := [(i, [float(c) * 1e9, 1.0, float(i)]) for i, c in enumerate(rng.integers(0, 1000, 50))], run(spark, tmp_path / "b", rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == []


def test_no_variance(spark, tmp_path):
    got = run(spark, tmp_path, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in got)


def test_less_rank_than_components(spark, tmp_path):
    got = run(spark, tmp_path, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])
    for r in got:
        assert (r.whitened is None) == (r.component > 1) and math.isclose(r.explained, 1.0 if r.component == 1 else 0.0, abs_tol=1e-12)
