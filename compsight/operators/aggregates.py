"""Aggregates (AGG-1..9).

All are single hash-aggregate passes (partial aggregation before any
shuffle); results are a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import to_number
from .clean import _as_of_col, latest_per_id, target_present


def _tidy(df: DataFrame, pairs: Sequence[tuple[str, Column]], key: str, value: str) -> DataFrame:
    """One-row aggregate -> (key, value) rows without a join."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias(key), v.alias(value)) for k, v in pairs])))


def stage_counts(loaded: DataFrame, as_of: str | None = None, months: int = C.MONTH_WINDOW,
                 target: str = C.TARGET_COL, date_col: str = C.DATE_COL) -> DataFrame:
    """AGG-9: rows after load, latest-per-loan, positive target, eligibility
    and the recent window.  One pass over the loaded frame and one over the
    de-duplicated frame, the filter stages as ``count_if`` columns."""
    n_loaded = loaded.agg(F.count(F.lit(1)).alias("n"))
    latest = latest_per_id(loaded)
    pos = to_number(target) > 0
    d = F.col(date_col)
    cutoff = F.add_months(_as_of_col(as_of), -months)
    agg = latest.agg(
        F.count(F.lit(1)).alias("latest"),
        F.count_if(pos).alias("positive"),
        F.count_if(pos & to_number(target).isNotNull()).alias("eligible"),
        F.count_if(pos & d.isNotNull()).alias("dated"),
        F.count_if(pos & (d >= cutoff)).alias("recent"))
    recent = F.when(F.col("dated") == 0, F.col("positive")).otherwise(F.col("recent"))
    tail = _tidy(agg, [("latest", F.col("latest")), ("positive", F.col("positive")),
                       ("eligible", F.col("eligible")), ("recent", recent)], "stage", "n_rows")
    head = n_loaded.select(F.lit("loaded").alias("stage"), F.col("n").alias("n_rows"))
    return head.unionByName(tail)


def filtered_counts(df: DataFrame, predicate: Column, name: str = "n_matching") -> DataFrame:
    """AGG-1: filtered and plain total counts in one pass."""
    return df.agg(F.count_if(predicate).alias(name), F.count(F.lit(1)).alias("n_total"))


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG-3: value frequencies, NULLs excluded."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n")))


def describe(df: DataFrame, col: str, percentiles: Sequence[float] = C.DESCRIBE_PERCENTILES,
             exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """AGG-4: count, mean, sample std, min, percentiles (linear interpolation), max.

    ``exact=True`` uses ``percentile`` (exact, linear interpolation as pandas);
    for very large inputs ``exact=False`` switches to ``percentile_approx``.
    """
    c = F.col(col)
    ps = list(percentiles)
    names = [f"p{int(round(p * 100))}" for p in ps]
    df = df.select(c.cast("double").alias(col))
    moments = [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
               F.min(c).alias("min"), F.max(c).alias("max")]
    if exact:
        # bracketed ranks: no task holds the column's distinct values; the moments ride along
        from .quantiles import exact_percentiles
        out = exact_percentiles(df, col, ps, names=names, extra=moments)
    else:
        arr = df.agg(*moments, F.percentile_approx(c, F.array(*[F.lit(p) for p in ps]), accuracy).alias("a"))
        out = arr.select("*", *[F.col("a")[i].alias(n) for i, n in enumerate(names)])
    return out.select("count", "mean", "std", "min", *names, "max")


def regression_metrics(df: DataFrame, y: str, p: str, group: str | None = None) -> DataFrame:
    """AGG-5: R², MAE, MSE, RMSE in one pass (SST as n·var_pop, stable), over the rows that have both values."""
    df = target_present(target_present(df, y), p)
    yc, pc = F.col(y), F.col(p)
    err = yc - pc
    aggs = [F.count(F.lit(1)).alias("n"),
            (F.lit(1.0) - F.sum(err * err) / (F.var_pop(yc) * F.count(F.lit(1)))).alias("r2"),
            F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
            F.sqrt(F.avg(err * err)).alias("rmse")]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def parse_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-6: share of rows whose text parses as a number, per column (tidy)."""
    agg = df.agg(*[F.avg(to_number(c).isNotNull().cast("double")).alias(f"r{i}")
                   for i, c in enumerate(cols)])
    return _tidy(agg, [(c, F.col(f"r{i}")) for i, c in enumerate(cols)], "column", "parse_rate")


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-7/8: per column non-NULL count, all-NULL flag and more-than-one-value flag."""
    agg = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(F.col(c)).alias(f"n{i}"),
        F.coalesce(F.min(F.col(c)) < F.max(F.col(c)), F.lit(False)).alias(f"v{i}"))])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_values"),
                 (F.col(f"n{i}") == 0).alias("all_null"), F.col(f"v{i}").alias("varies"))
        for i, c in enumerate(cols)])))


__all__ = ["stage_counts", "filtered_counts", "category_counts", "describe",
           "regression_metrics", "parse_rate", "null_profile", "latest_per_id"]
