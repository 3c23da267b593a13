"""Operators on small frames: dedup, split, quantiles, linear algebra identities, invariance."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from compsight.operators import linear as L
from compsight.operators import ordered as O
from compsight.operators.clean import latest_per_id
from compsight.operators.quantiles import exact_percentiles
from compsight.operators.sampling import kth_smallest, split_exact


def test_latest_per_id_null_group_and_ties(spark):
    rows = [(1, "2024-01-02", 1), (1, "2024-01-02", 2), (1, None, 3), (None, "2024-01-01", 4),
            (None, "2024-03-01", 5), (2, None, 6)]
    df = spark.createDataFrame(rows, "loan_number long, fecha_de_modificacion string, source_row long")
    df = df.withColumn("fecha_de_modificacion", F.col("fecha_de_modificacion").cast("date"))
    got = {r.loan_number: r.source_row for r in latest_per_id(df).collect()}
    assert got == {1: 2, None: 5, 2: 6}


def test_latest_invariant_under_repartition(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"loan_number": rng.integers(0, 50, 2000), "source_row": np.arange(2000),
                        "fecha_de_modificacion": pd.to_datetime("2020-01-01")
                        + pd.to_timedelta(rng.integers(0, 400, 2000), "D")})
    df = spark.createDataFrame(pdf).withColumn("fecha_de_modificacion",
                                               F.col("fecha_de_modificacion").cast("date"))
    a = sorted(r.source_row for r in latest_per_id(df.repartition(1)).collect())
    b = sorted(r.source_row for r in latest_per_id(df.repartition(7)).collect())
    c = sorted(r.source_row for r in latest_per_id(df.repartition(64)).collect())
    assert a == b == c


def test_split_exact_sizes(spark):
    df = spark.range(641).withColumnRenamed("id", "source_row")
    assert split_exact(df).filter("is_test").count() == 129


def test_kth_smallest_signed(spark):
    vals = [-5, 3, -(2 ** 40), 7, 0, 2 ** 50, -1]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    s = sorted(vals)
    assert [kth_smallest(df, "x", k) for k in range(1, 8)] == s


def test_exact_percentiles_match_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(5, 2, 3000), np.full(500, 3.0)])
    g = rng.integers(0, 4, len(x))
    pdf = pd.DataFrame({"g": g, "x": x})
    got = exact_percentiles(spark.createDataFrame(pdf), "x", [0.1, 0.5, 0.9], ["g"]).toPandas()
    exp = pdf.groupby("g")["x"].quantile([0.1, 0.5, 0.9]).unstack()
    for _, r in got.iterrows():
        for p, c in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")):
            assert math.isclose(r[c], exp.loc[r["g"], p], rel_tol=1e-12)


def _frame(spark, n=400, d=3, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    y = 1 + X @ rng.normal(size=d) + rng.normal(size=n) * (1 + np.abs(X[:, 0]))
    cols = [f"x{i}" for i in range(d)]
    return spark.createDataFrame(pd.DataFrame(X, columns=cols).assign(y=y)), X, y, cols


def test_ols_hc3_and_vif_vs_numpy(spark):
    df, X, y, cols = _frame(spark)
    g = L.gram(df, cols, "y")
    r = L.ols(df, cols, "y", g=g)
    Z = np.column_stack([np.ones(len(y)), X])
    inv = np.linalg.inv(Z.T @ Z)
    beta = inv @ Z.T @ y
    e = y - Z @ beta
    h = np.einsum("ij,jk,ik->i", Z, inv, Z)
    cov = inv @ ((Z * (e ** 2 / (1 - h) ** 2)[:, None]).T @ Z) @ inv
    assert np.allclose(r.params, beta) and np.allclose(r.bse, np.sqrt(np.diag(cov)))
    v = L.vif(r, g)
    for j, name in enumerate(r.names[1:], start=1):
        others = [i for i in range(Z.shape[1]) if i != j]
        b = np.linalg.lstsq(Z[:, others], Z[:, j], rcond=None)[0]
        ssr = ((Z[:, j] - Z[:, others] @ b) ** 2).sum()
        assert math.isclose(v[name], ((Z[:, j] - Z[:, j].mean()) ** 2).sum() / ssr, rel_tol=1e-9)


def test_ridge_loo_vs_brute_force(spark):
    df, X, y, cols = _frame(spark, n=120)
    m = L.ridge_loo(df, cols, "y")
    n = len(y)
    for a, got in m.loo_mse.items():
        errs = []
        for i in range(n):
            k = np.ones(n, bool)
            k[i] = False
            mx, my = X[k].mean(0), y[k].mean()
            xc = X[k] - mx
            b = np.linalg.solve(xc.T @ xc + a * np.eye(X.shape[1]), xc.T @ (y[k] - my))
            errs.append((y[i] - my - (X[i] - mx) @ b) ** 2)
        assert math.isclose(got, np.mean(errs), rel_tol=1e-9)


def test_durbin_watson_and_ad(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(3000), "e": e}))
    dw = O.durbin_watson(df, F.col("e"), ["k"], partitions=7)["durbin_watson"]
    assert math.isclose(dw, np.sum(np.diff(e) ** 2) / np.sum(e ** 2), rel_tol=1e-10)
    ad = O.anderson_darling(df, F.col("e"), partitions=5)
    z = np.sort((e - e.mean()) / e.std(ddof=1))
    phi = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, 3001)
    a2 = -3000 - np.sum((2 * i - 1) * (np.log(phi) + np.log(1 - phi[::-1]))) / 3000
    assert math.isclose(ad["statistic"], a2, rel_tol=1e-9)
