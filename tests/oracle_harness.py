"""Run a catalog query in Spark and its SQL in DuckDB, compare the results.

Comparison: same column names (sorted), same row count, and the same
multiset of rows after normalising values (Decimal -> str, float -> repr,
NaN -> None).  Floats are compared exactly: the oracle SQL is written so that
both engines compute the same IEEE operations (sums of money are DECIMAL,
other doubles are rounded on both sides).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from compsight.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def spark_rows(df):
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    return cols, rows


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    scols, srows = spark_rows(df)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out = {"name": name, "spark_rows": len(srows), "duck_rows": len(drows),
           "cols_match": sorted(scols) == sorted(dcols)}
    if not out["cols_match"]:
        out["detail"] = f"cols spark={sorted(scols)} duck={sorted(dcols)}"
        out["ok"] = False
        return out
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    sset = sorted((tuple(_norm(r[i]) for i in order) for r in srows), key=repr)
    dset = sorted((tuple(_norm(r[i]) for i in dorder) for r in drows), key=repr)
    out["ok"] = sset == dset
    if not out["ok"]:
        in_spark, in_duck = set(sset), set(dset)
        diff_s = [r for r in sset if r not in in_duck][:3]
        diff_d = [r for r in dset if r not in in_spark][:3]
        out["detail"] = (f"cols={[scols[i] for i in order]}\n spark-only={diff_s}\n"
                         f" duck-only={diff_d}")
    return out
