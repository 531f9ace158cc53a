"""Whitening against plain integer arithmetic and a plain eigen decomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from loftline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def plain(vectors):
    """Deviations by row, covariance and mean, in exact fractions over distinct integer vectors."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fit = sorted({tuple(r) for r in x})
    n, d = len(fit), len(fit[0])
    s = [sum(r[k] for r in fit) for k in range(d)]
    cov = [[Fraction(sum((n * r[a] - s[a]) * (n * r[b] - s[b]) for r in fit), n ** 3) for b in range(d)] for a in range(d)]
    return x, n, s, np.array(cov, float), [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x]


@pytest.mark.parametrize("rows", [np.arange(12).reshape(4, 3) - 5, np.full((70, 2), -3), np.array([[2 ** 62, -2 ** 63]] * 3 + [[-2 ** 62, 2 ** 63 - 1]], np.int64),
                                  np.random.default_rng(5).integers(-10 ** 6, 10 ** 6, (300, 5))])
def test_cross_products_are_exact(rows):
    m = rows.astype(np.int64)
    s, c = whitening.scatter(m)
    o = m.astype(object)
    assert (s == o.sum(0)).all() and (c == o.T @ o).all()
    assert all(sum(v << (whitening.LIMB * k) for k, v in enumerate(whitening._limbs(x))) == x for x in (0, 5, -7, 2 ** 100 + 3, -2 ** 90))


def test_whitened_equals_plain(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(90, 6)) @ np.diag([3, 2, 1, .5, .2, .1])).astype(np.float32)
    vectors = [*base, *base[:20], base[0], base[0]]
    rows = [(i, [float(c) for c in v], 0, 9) for i, v in enumerate(vectors)]
    odd = [(900, None, 1, 1), (901, [None] + [0.5] * 5, 1, 1), (902, [float("nan")] * 6, 1, 1), (903, [float("inf")] * 6, 1, 1), (904, [1.0], 1, 1), (905, [], 1, 1), (None, [float(c) for c in base[3]], 1, 1)]
    got = whitening.whitened(spark.createDataFrame(rows + odd, SCHEMA).repartition(5)).toPandas()
    x, n, s, cov, deviation = plain(vectors)
    assert set(got.vec_id.dropna().astype(int)) == {r[0] for r in rows} and got.vec_id.isna().sum() == 4
    assert (got.n == n).all() and n == 90 and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    by = {int(i): g.sort_values("component") for i, g in got.dropna(subset=["vec_id"]).groupby("vec_id")}
    assert all((by[i].deviation == deviation[i]).all() for i in by)
    values = np.linalg.eigvalsh(cov)[::-1]
    assert np.allclose(by[0].explained, values[:4] / np.trace(cov), rtol=1e-9)
    w = np.array([by[i].whitened.to_numpy() for i in range(90)])
    assert np.allclose((w - w.mean(0)).T @ (w - w.mean(0)) / 90, np.eye(4), atol=1e-9)
    centred = np.array(x[:90]) - np.array(s) / n
    axis = np.linalg.lstsq(centred, w * np.sqrt(values[:4]), rcond=None)[0]
    assert np.allclose(cov @ axis, axis * values[:4], atol=1e-6) and np.allclose((axis ** 2).sum(0), 1)
    assert np.array_equal(by[0].whitened, by[90].whitened)


def test_degenerate_tables(spark):
    run = lambda rows: whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert run([]) == [] and run([(1, None, 0, 0)]) == [] and run([(1, [], 0, 0)]) == []
    one = run([(1, [0.5, -0.25], 0, 0), (2, [0.5, -0.25], 0, 0)])
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.explained == 0 for r in one)
    flat = run([(k, [k / 4, 1.0], 0, 0) for k in range(5)])
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True}
    huge = run([(1, [1e30, 0.0], 0, 0), (2, [-1e30, 1.0], 0, 0), (3, [0.0, 2.0], 0, 0)])
    assert len(huge) == 6 and any(r.deviation is None for r in huge)
