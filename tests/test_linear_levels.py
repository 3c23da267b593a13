"""Designs with a category column of any number of levels against NumPy on the explicit dummies."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compsight.functions import distributions as D
from compsight.operators import linear as L


def frame(spark, n, p, k, seed=0, twin=False, fixed=False, shift=0.0):
    """(DataFrame, dense design with constant and dummies, y, numeric names, sorted level names)."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + shift
    city = np.concatenate([np.arange(k), rng.integers(0, k, n - k)]) if k else np.zeros(n, int)
    if twin:
        x[:, 1] = x[:, 0]
    if fixed:
        x[:, -1] = rng.normal(size=max(k, 1))[city]  # the same for all rows of a level
    y = 1 + x @ rng.normal(size=p) + rng.normal(size=max(k, 1))[city] + rng.normal(size=n) * (1 + np.abs(x[:, 0]))
    names = [f"x{i}" for i in range(p)]
    levels = [f"c{i:05d}" for i in range(k)]
    pdf = pd.DataFrame(x, columns=names).assign(y=y)
    z = np.column_stack([np.ones(n), x])
    if k:
        pdf["city"] = np.array(levels)[city]
        z = np.column_stack([z, (city[:, None] == np.arange(1, k)[None, :]).astype(float)])
    return spark.createDataFrame(pdf).repartition(3), z, y, names, levels


def numpy_fit(z, y):
    inv = np.linalg.pinv(z.T @ z, rcond=1e-9, hermitian=True)
    beta = inv @ z.T @ y
    e = y - z @ beta
    h = np.einsum("ij,jk,ik->i", z, inv, z)
    own = 1 - h > 1e-10
    q = np.where(own, (e / np.where(own, 1 - h, 1)) ** 2, 0)
    return inv, beta, e, h, inv @ ((z * q[:, None]).T @ z) @ inv


@pytest.mark.parametrize("n,p,k,twin,fixed", [
    (300, 3, 0, False, False), (600, 3, 2, False, False), (900, 3, 70, False, False), (900, 4, 30, True, False),
    (900, 3, 30, False, True)])
def test_ols_equals_numpy(spark, n, p, k, twin, fixed):
    df, z, y, names, levels = frame(spark, n, p, k, 3, twin, fixed)
    level = "city" if k else None
    g = L.gram(df, names, "y", level)
    res = L.ols(df, names, "y", g=g, level=level)
    inv, beta, e, h, cov = numpy_fit(z, y)
    got = {r.feature: r for r in res.coef_table(spark).collect()}
    order = ["const", *names, *[f"city_{c}" for c in levels[1:]]]
    assert list(got) and set(got) == set(order)
    assert np.allclose([got[f].coef for f in order], beta, rtol=1e-7, atol=1e-9)
    assert np.allclose([got[f].std_err for f in order], np.sqrt(np.maximum(np.diag(cov), 0)), rtol=1e-6, atol=1e-8)
    rank = np.linalg.matrix_rank(z)
    assert res.rank == rank and math.isclose(res.ssr, e @ e, rel_tol=1e-9)
    back = res.with_residual(df, "y").select("y", "resid").orderBy("y").collect()
    assert np.allclose([r.resid for r in back], e[np.argsort(y)], atol=1e-8)
    # Breusch-Pagan, by a plain regression of e^2
    fit = z @ (inv @ z.T @ e**2)
    r2 = 1 - np.sum((e**2 - fit) ** 2) / np.sum((e**2 - np.mean(e**2)) ** 2)
    bp = L.breusch_pagan(df, res, "y", g)
    assert math.isclose(bp["lm"], n * r2, rel_tol=1e-7)
    # the joint test of all slopes
    f, _ = L.wald_f(res, g)
    if fixed:  # slopes are not determined: those of an equal design without the last dummy are
        _, beta, _, _, cov = numpy_fit(z[:, :-1], y)
    v = cov[1:, 1:]
    want = beta[1:] @ np.linalg.pinv(v, rcond=1e-9, hermitian=True) @ beta[1:] / (rank - 1)
    assert math.isclose(f, want, rel_tol=1e-5)
    # variance inflation: each column on all others
    vif = {r.feature: r.value for r in L.vif_table(res, g, spark).collect()}
    for j, name in enumerate(order):
        rest = np.delete(z, j, axis=1)
        ssr = np.sum((z[:, j] - rest @ np.linalg.lstsq(rest, z[:, j], rcond=1e-10)[0]) ** 2)
        sst = n if j == 0 else np.sum((z[:, j] - z[:, j].mean()) ** 2)
        assert (vif[name] is None) if ssr < 1e-8 * max(sst, 1) else math.isclose(vif[name], sst / ssr, rel_tol=1e-6)
    cond = L.condition_number(g, res.rank)
    if rank == z.shape[1]:
        ev = np.linalg.eigvalsh(z.T @ z)
        assert math.isclose(cond, math.sqrt(ev[-1] / ev[0]), rel_tol=1e-8)
    else:
        assert cond == 1 / np.finfo(float).eps


@pytest.mark.parametrize("k", [2, 40])
def test_ridge_errors_are_those_of_leaving_out_each_row(spark, k):
    df, z, y, names, levels = frame(spark, 150, 2, k, 7, shift=0.5)
    m = L.ridge_loo(df, names, "y", level="city")
    penalty = np.eye(z.shape[1])
    penalty[0, 0] = 0
    for a, got in m.loo_mse.items():
        errors = []
        for i in range(len(y)):
            zi, yi = np.delete(z, i, 0), np.delete(y, i)
            b = np.linalg.solve(zi.T @ zi + a * penalty, zi.T @ yi)
            errors.append((y[i] - z[i] @ b) ** 2)
        assert math.isclose(got, np.mean(errors), rel_tol=1e-8)
    beta = np.linalg.solve(z.T @ z + m.alpha * penalty, z.T @ y)
    terms = {r.term: r.value for r in m.terms(spark).collect()}
    order = ["intercept", *names, *[f"city_{c}" for c in levels[1:]]]
    assert set(terms) == set(order) and np.allclose([terms[t] for t in order], beta, rtol=1e-8)
    unknown = spark.createDataFrame([(0.0, 0.0, "nowhere"), (0.0, 0.0, None), (0.0, 0.0, levels[0])], "x0 double, x1 double, city string")
    assert [r.p for r in m.with_prediction(unknown, "p").collect()] == [m.intercept] * 3


def test_five_thousand_levels(spark):
    """The same path at 5,000 levels; NumPy gets the design as sparse sums."""
    df, z, y, names, levels = frame(spark, 20_000, 2, 5_000, 11)
    g = L.gram(df, names, "y", "city")
    assert g.n_dummies == 4_999 and g.baseline == "c00000" and g.uu.shape == (3, 3)
    m = L.ridge_loo(df, names, "y", g=g)
    a = z.T @ z
    penalty = np.eye(len(a))
    penalty[0, 0] = 0
    beta = np.linalg.solve(a + m.alpha * penalty, z.T @ y)
    terms = {r.term: r.value for r in m.terms(spark).collect()}
    order = ["intercept", *names, *[f"city_{c}" for c in levels[1:]]]
    assert np.allclose([terms[t] for t in order], beta, rtol=1e-6, atol=1e-9)
    res = L.ols(df, names, "y", g=g)
    inv = np.linalg.inv(a)
    b = inv @ z.T @ y
    e = y - z @ b
    h = np.einsum("ij,ij->i", z @ inv, z)
    own = 1 - h > 1e-10
    q = np.where(own, (e / np.where(own, 1 - h, 1)) ** 2, 0)
    half = inv @ z.T * np.sqrt(q)
    se = np.sqrt(np.einsum("ij,ij->i", half, half))
    got = {r.feature: r for r in res.coef_table(spark).collect()}
    order = ["const", *names, *[f"city_{c}" for c in levels[1:]]]
    assert np.allclose([got[f].coef for f in order], b, rtol=1e-6, atol=1e-8)
    assert np.allclose([got[f].std_err for f in order], se, rtol=1e-6, atol=1e-7)
    assert D.normal_two_sided(got["x0"].stat) == got["x0"].p_value
    assert 0 < L.significant(res, spark).filter(F.col("feature").startswith("city_")).count() < 4_999


def test_rows_with_missing_values_do_not_count(spark):
    rows = [(1.0, 2.0, "a"), (2.0, 4.5, "a"), (None, 9.0, "b"), (4.0, None, "b"), (3.0, 5.0, "b"), (5.0, 11.0, "b")]
    df = spark.createDataFrame(rows, "x double, y double, city string")
    assert L.gram(df, ["x"], "y").n == 4 == L.gram(df, ["x"], "y", "city").n
    none = spark.createDataFrame(rows, "x double, y double, city string").withColumn("city", F.lit(None).cast("string"))
    g = L.gram(none, ["x"], "y", "city")
    assert g.n_dummies == 0 and L.ols(none, ["x"], "y", g=g).rank == 2
