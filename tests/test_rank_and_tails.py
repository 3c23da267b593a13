"""Rank-deficient designs and heavy-tailed residuals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from compsight.functions.distributions import log_normal_cdf
from compsight.operators import linear, ordered


def test_breusch_pagan_and_rank_on_a_collinear_design(spark):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(400), rng.standard_normal(400)
    y = 1 + a - b + rng.standard_normal(400) * np.exp(0.4 * a)
    df = spark.createDataFrame([(float(p), float(q), float(p / 2), float(t)) for p, q, t in zip(a, b, y)],
                               "a double, b double, c double, y double")
    g = linear.gram(df, ["a", "b", "c"], "y")
    res = linear.ols(df, ["a", "b", "c"], "y", g=g)
    z = np.column_stack([np.ones(400), a, b])
    e2 = (y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2
    fit = z @ np.linalg.lstsq(z, e2, rcond=None)[0]
    r2 = 1 - ((e2 - fit) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    got = linear.breusch_pagan(df, res, "y", g)
    assert (res.rank, res.df_model, res.df_resid) == (3, 2, 397)
    assert math.isclose(got["lm"], 400 * r2, rel_tol=1e-6) and 0 <= got["lm"] <= 400
    assert math.isclose(got["fvalue"], r2 / 2 / ((1 - r2) / 397), rel_tol=1e-6)


def test_anderson_darling_of_a_long_tail(spark):
    x = np.exp(np.random.default_rng(1).standard_normal(3000) * 2)
    got = ordered.anderson_darling(spark.createDataFrame([(float(v),) for v in x], "x double"), F.col("x"))
    assert got["statistic"] > 100 and got["pvalue"] == 0.0


def test_log_normal_cdf_has_both_tails():
    z = np.linspace(-30, 4, 500)
    want = [math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in z]
    assert np.allclose(log_normal_cdf(z), want, rtol=1e-9)
    assert np.isfinite(log_normal_cdf(np.array([-500.0, 500.0]))).all()
