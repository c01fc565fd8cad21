"""Whitening and the contour solver against dense linear algebra, with odd rows."""

import numpy as np
import pytest

from beaconry.llm import feast, whitening

SCHEMA = "vec_id long, embedding array<double>, n long, x string, component int, i int, row string"
ODD = (None, "clash", 9, 8, None)


def test_inertia():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 7, 20):
        a = rng.normal(size=(d, d))
        a += a.T
        e, count = np.linalg.eigvalsh(a), feast.Inertia(a)
        for shift in (-1.5, 0.0, 0.3, 2.0):
            assert count.above(shift) == (e > shift).sum()
    assert feast.Inertia(np.array([[0.0, 1.0], [1.0, 0.0]])).above(0) == 1
    assert feast.Inertia(np.zeros((3, 3))).above(0) == 0
    assert feast.Inertia(np.diag([5.0, 5, 5, 1])).above(1) == 3


@pytest.mark.parametrize("e", [
    [9, 8, 7, 6, 5, 4], [9, 9, 9, 9, 9, 9], [9, 9, 1, 1, 1, 0], [5, 0, 0, 0], [1e6, 1, 1e-3, 1e-6, 0], [3.0], [7, 7 * (1 - 1e-12), 3, 3, 3, 3, 2],
    list(np.linspace(1, 1.001, 40)), [6475, 2138, 1099.7, 1097.2, 1067.8, 1063.6, *np.linspace(1056, 764, 58)], [5, 4, 3, 1 + 2e-7, 1 + 1e-7, 1],
])
def test_leading(e):
    d = len(e)
    q, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    v = q @ np.diag(e).astype(float) @ q.T
    v = (v + v.T) / 2
    got, w = feast.leading(v, 4)
    want = [x for x in sorted(e, reverse=True)[:4] if x > max(e) * 1e-14 * len(e)]
    assert np.allclose(got, want, rtol=0, atol=1e-13 * max(e) * d)
    assert np.abs(v @ w - w * got).max() < 1e-12 * max(e)
    assert np.abs(w.T @ w - np.eye(len(got))).max() < 1e-9


def test_missed_eigenpairs_are_an_error():
    with pytest.raises(ArithmeticError):
        feast.inside(np.diag([1.0, 2.0, 3.0]), 1.5, 3.5, 3, 3)


def rows(d=6):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, d)) * np.linspace(3, 0.5, d)
    x[10:30] = x[3]
    data = [(i, v.tolist(), *ODD) for i, v in enumerate(x)]
    bad = [None, [], [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] * d, [1.0] * (d - 1)]
    return [*data, *[(200 + n, v, *ODD) for n, v in enumerate(bad)], (None, x[5].tolist(), *ODD), (6, x[6].tolist(), *ODD), (300, [0.0] * d, *ODD)]


def test_whiten(spark):
    data = rows()
    got = whitening.whiten(spark.createDataFrame(data, SCHEMA)).collect()
    good = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, *_ in data
            if v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.stack([x for _, x in good]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:4], w[:, ::-1][:, :4]
    assert len(got) == 4 * len(good)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-12
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-12)
    for i, x in good:
        assert by[i][1].deviation == ((n * x - s) ** 2).sum()
    signs = np.sign([by[0][c + 1].whitened * ((good[0][1] - s / n) @ w[:, c]) for c in range(4)])
    for i, x in good:
        z = (x - s / n) @ w / np.sqrt(e) * signs
        assert np.allclose([by[i][c + 1].whitened for c in range(4)], z, atol=1e-11)


@pytest.mark.parametrize("data", [[], [(1, None, *ODD)], [(1, [2.0, 1.0], *ODD), (2, [2.0, 1.0], *ODD)]])
def test_nothing_to_whiten(spark, data):
    assert whitening.whiten(spark.createDataFrame(data, SCHEMA)).collect() == []


def test_one_dimension_and_large_entries(spark):
    data = [(1, [1.0], *ODD), (2, [3.0], *ODD), (3, [-1e13], *ODD)]
    got = sorted(whitening.whiten(spark.createDataFrame(data[:2], SCHEMA)).collect())
    assert [r.whitened for r in got] in ([-1.0, 1.0], [1.0, -1.0]) and [r.deviation for r in got] == [512 ** 2] * 2
    assert {r.deviation for r in whitening.whiten(spark.createDataFrame(data, SCHEMA)).collect()} == {None}
