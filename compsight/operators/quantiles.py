"""Exact quantiles in a fixed number of passes, without holding a group's values in one task.

Spark's exact ``percentile`` / ``median`` keep every distinct value of a group
in one aggregation buffer, which does not survive a group holding a third of
100 TB.  Here

  sketch   one aggregate gives, per group and column, the count and a mergeable sketch's values a little
           below and above every wanted rank: brackets that are sure to hold it
  count    one aggregate counts the values below each bracket and finds its two neighbours
  gather   the few values inside the brackets, counted per value, are summed up in order

All columns and probabilities go through each pass together and side by side; only values inside a
bracket become rows of their own.  The table is written once, so every pass reads it and nothing
above it; sketches and counts are written tables of one row a group.

A sketch of accuracy a misses a rank by at most n / a, so a bracket of three times that to both
sides holds the rank or ends one value beside it (small groups); the neighbours cover that.
Equal values are one row of the gather, however many there are.

Percentiles use linear interpolation between the order statistics at
floor/ceil of (n - 1) * p, the definition shared by pandas, Spark's
``percentile`` and DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: A sketch's rank error is at most this share of the values: 1 / ACCURACY.
ACCURACY = 20_000
MARGIN = 3.0 / ACCURACY


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULL equal to NULL; the keys come from ``a``."""
    right = b.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in b.columns])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return a.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def wide_percentiles(df: DataFrame, values: Sequence[str], probs: Sequence[float], groups: Sequence[str] = (),
                     extra: Sequence[Column] = ()) -> DataFrame:
    """One row a group (NULL is a group): the group columns, ``extra`` aggregates of all its rows, and
    ``q<i>_<j>`` for value column i and probability j (NULL where it has no value; NaN is none)."""
    n, m = len(values), len(probs)
    xs = []
    for i, v in enumerate(values):
        x = F.col(f"`{v}`").cast("double")
        xs.append(F.when(~F.isnan(x), x).alias(f"__x{i}"))
    groups = list(groups)
    keys = groups or ["__g"]
    base = stored(df.select("*", *xs) if groups else df.select("*", F.lit(0).alias("__g"), *xs), "values")
    ends = F.array(*[F.lit(min(1.0, max(0.0, float(p) + side * MARGIN))) for p in probs for side in (-1, 1)])
    extra = list(extra)
    sketch = stored(base.groupBy(*keys).agg(*extra, *[c for i in range(n) for c in (
        F.count(f"__x{i}").alias(f"__n{i}"), F.percentile_approx(f"__x{i}", ends, ACCURACY).alias(f"__s{i}"))]), "sketch")
    side = sketch.select(*keys, *[f"__s{i}" for i in range(n)])
    rows = _same(base.select(*keys, *[f"__x{i}" for i in range(n)]), side, keys)

    def lo(i: int, j: int) -> Column:
        return F.col(f"__s{i}")[2 * j]

    def hi(i: int, j: int) -> Column:
        return F.col(f"__s{i}")[2 * j + 1]

    pairs = [(i, j) for i in range(n) for j in range(m)]
    x = [F.col(f"__x{i}") for i in range(n)]
    counts = rows.groupBy(*keys).agg(*[c for i, j in pairs for c in (
        F.count_if(x[i] < lo(i, j)).alias(f"__b{i}_{j}"), F.max(F.when(x[i] < lo(i, j), x[i])).alias(f"__p{i}_{j}"),
        F.min(F.when(x[i] > hi(i, j), x[i])).alias(f"__u{i}_{j}"))])
    counts = stored(_same(counts, sketch.drop(*[f"__s{i}" for i in range(n)]), keys), "ranks")

    def place(i: int, j: int) -> Column:
        return (F.col(f"__n{i}") - 1) * F.lit(float(probs[j]))

    wanted = counts.select(*keys, F.inline(F.array(*[F.struct(
        F.lit(i).alias("__i"), F.lit(j).alias("__j"), (F.floor(place(i, j)) + 1).cast("long").alias("__k1"),
        (F.ceil(place(i, j)) + 1).cast("long").alias("__k2"), (place(i, j) - F.floor(place(i, j))).alias("__f"),
        F.col(f"__b{i}_{j}").alias("__below"), F.col(f"__p{i}_{j}").alias("__prev"), F.col(f"__u{i}_{j}").alias("__next"))
        for i, j in pairs])))
    inside = F.filter(F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(j).alias("__j"), F.when(
        (x[i] >= lo(i, j)) & (x[i] <= hi(i, j)), x[i]).alias("__x")) for i, j in pairs]), lambda e: e["__x"].isNotNull())
    held = rows.select(*keys, F.inline(inside)).groupBy(*keys, "__i", "__j", "__x").agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*keys, "__i", "__j").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    at = [*keys, "__i", "__j"]
    summed = _same(held.withColumn("__cum", F.sum("__c").over(order)), wanted, at)
    rank = {k: F.min(F.when(F.col("__cum") >= F.col(k) - F.col("__below"), F.col("__x"))) for k in ("__k1", "__k2")}
    found = summed.groupBy(*at).agg(
        rank["__k1"].alias("__v1"), rank["__k2"].alias("__v2"), F.max("__cum").alias("__all"),
        *[F.first(c).alias(c) for c in ("__k1", "__k2", "__f", "__below", "__prev", "__next")])

    def value(k: str, v: str) -> Column:
        far = (F.col(k) < F.col("__below")) | (F.col(k) > F.col("__below") + F.col("__all") + 1)
        return (F.when(far, F.raise_error(F.lit("rank outside its bracket")).cast("double"))
                .when(F.col(k) == F.col("__below"), F.col("__prev")).otherwise(F.coalesce(F.col(v), F.col("__next"))))
    v1, v2, f = value("__k1", "__v1"), value("__k2", "__v2"), F.col("__f")
    found = found.select(*at, v1.alias("__a"), v2.alias("__b"), "__f").select(
        *at, F.when((f == 0) | (F.col("__a") == F.col("__b")), F.col("__a"))
        .otherwise(F.col("__a") + (F.col("__b") - F.col("__a")) * f).alias("__q"))
    wide = found.groupBy(*keys).agg(*[
        F.max(F.when((F.col("__i") == i) & (F.col("__j") == j), F.col("__q"))).alias(f"q{i}_{j}") for i, j in pairs])
    names = [c for c in sketch.columns if c not in keys and not c.startswith(("__n", "__s"))]
    return _same(counts.select(*keys, *names), wide, keys, "left").select(
        *groups, *names, *[f"q{i}_{j}" for i, j in pairs])


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float],
                      groups: Sequence[str] = (), names: Sequence[str] | None = None,
                      extra: Sequence[Column] = ()) -> DataFrame:
    """Exact linear-interpolation percentiles of ``value`` (per group, NULL being one), one column per
    probability (``names`` or ``p<100p>``), after ``extra`` aggregates of the same pass.

    A group without any value is there only with ``extra``, its percentiles NULL.
    """
    names = list(names) if names else [f"p{int(round(p * 100))}" for p in probs]
    wide = wide_percentiles(df, [value], probs, groups, extra)
    out = wide.select(*[c for c in wide.columns if not c.startswith("q0_")],
                      *[F.col(f"q0_{j}").alias(name) for j, name in enumerate(names)])
    return out if extra else out.filter(F.col(names[0]).isNotNull())


def exact_median(df: DataFrame, value: str, groups: Sequence[str] = (),
                 name: str = "median") -> DataFrame:
    return exact_percentiles(df, value, [0.5], groups, [name])


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of several columns, all in the same passes; a small dict (d numbers) for use as literals."""
    if not cols:
        return {}
    row = wide_percentiles(df.select(*[F.col(f"`{c}`") for c in cols]), cols, [0.5]).first()
    return {c: None if row is None or row[f"q{i}_0"] is None else float(row[f"q{i}_0"]) for i, c in enumerate(cols)}
