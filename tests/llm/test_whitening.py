"""Whitening against plain linear algebra over the same whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from postgrain.llm.whitening import eigenvectors, products, whiten

SCHEMA = "vec_id long, embedding array<float>"


def symmetric(values, seed=1):
    """A symmetric matrix with these eigenvalues, in extended precision."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(q)) - 0.5 * (q.T @ q))
    return (q * np.array(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize("values", [
    np.linspace(1, 5, 12), [1, 1 + 1e-9, 1 + 2e-9, 2, 2 + 1e-12, 7], [3, 3, 3, 1, 1, 0], [1e-6, 1, 1e6], [5], [0, 0],
    np.r_[np.full(20, 2.0) + np.arange(20) * 1e-10, 1.0, 9.0]], ids=str)
def test_eigenvectors_reach_double_precision(values):
    a, _ = symmetric(values)
    found, x = eigenvectors(a)
    size = max(np.abs(values).max(), 1e-30)
    assert np.allclose(found.astype(float), sorted(values, reverse=True), rtol=0, atol=1e-16 * size * len(values))
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-16
    assert np.abs(a @ x - x * found).max() < 4e-17 * size * len(values)


def test_vectors_of_close_values_are_told_apart():
    values = [1 + 1e-7, 1, 0.5]
    a, q = symmetric(values)
    _, x = eigenvectors(a)
    for k in range(3):  # the gap costs seven of the nineteen digits
        assert abs(abs(x[:, k] @ q[:, k]) - 1) < 1e-18
        assert min(np.abs(x[:, k] - q[:, k]).max(), np.abs(x[:, k] + q[:, k]).max()) < 1e-11


def test_products_are_exact():
    x = np.random.default_rng(3).integers(-2**52, 2**52, (9000, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert products(x).tolist() == want
    for small in (x % 7 - 3, -(x % 5) - 1, x % 2 * 0 - 1):
        assert products(small).tolist() == (small.T @ small).tolist()


def expected(rows, components=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by numpy."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), np.array(fit, object).sum(axis=0)
    d = np.array(fit, object) * n - sums
    v = np.array([[float(Fraction(int((d[:, i] * d[:, j]).sum()), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for i, x in kept:
        own = np.array(x, object) * n - sums
        w = (own / n).astype(float) @ q / np.sqrt(np.maximum(e, 1e-300))
        out += [(i, k + 1, n, int((own * own).sum()), abs(w[k]), e[k] / np.trace(v)) for k in range(min(components, len(sums)))]
    return sorted(out, key=repr)


def test_as_plain_linear_algebra(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20) * np.linspace(1, 3, 20)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [rows[3], (None, rows[5][1])]
    bad = [(900, None), (901, [None] + [0.0] * 19), (902, [math.nan] + [0.0] * 19), (903, [-math.inf] + [0.0] * 19),
           (904, [3e38] + [0.0] * 19), (905, [1.0]), (906, [])]
    frame = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    found = sorted((tuple(r) for r in whiten(frame).collect()), key=lambda r: repr(r[:2]))
    want = sorted(expected(rows), key=lambda r: repr(r[:2]))
    assert [r[:4] for r in found] == [r[:4] for r in want]
    assert np.allclose([abs(r[4]) for r in found], [r[4] for r in want], rtol=0, atol=1e-9)
    assert np.allclose([r[5] for r in found], [r[5] for r in want], rtol=1e-9)
    assert len({r[6] for r in found}) == 1 and found[0][6] < 1e-12


def test_one_sign_for_all_rows_and_any_partitioning(spark):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], SCHEMA)
    first, second = (sorted(tuple(r)[:6] for r in whiten(frame.repartition(k)).collect()) for k in (1, 7))
    assert first == second
    w = np.array([r[4] for r in first]).reshape(60, 4)
    assert np.abs(w.T @ w / 60 - np.eye(4)).max() < 1e-12


def test_tables_without_variance_and_other_columns(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], SCHEMA)
    assert whiten(frame).collect() == whiten(frame.limit(0)).collect() == []
    line = spark.createDataFrame([(1, [1.0, 2.0], 0, 0), (2, [3.0, 2.0], 0, 0)], SCHEMA + ", x int, `odd.name` int")
    assert [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in whiten(line).collect()] == [
        (1, 1, 2, 128**2, 1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0)]
