"""Order-dependent statistics without a single-partition window (WIN-2, WIN-3, STAT-6).

Both use the same layout: ``repartitionByRange`` on the order key, sort
within partitions, tag the partition id and checkpoint (freezes the
assignment).  Per-partition row counts (one row per partition) give each
partition its global rank offset.  A ``mapInPandas`` pass then walks each
partition in order and emits one row of partial sums per Arrow batch, plus
the first/last values needed to stitch partitions together.  Only
O(partitions) numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D


def _ranged(df: DataFrame, order: Sequence[str], value: Column, partitions: int | None
            ) -> tuple[DataFrame, dict[int, int]]:
    sel = df.select(*[F.col(c) for c in order], value.alias("__v"))
    n_parts = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = (sel.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
            .withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True))
    counts = {int(r["__pid"]): int(r["n"]) for r in
              laid.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    return laid, counts


def global_rank_sums(df: DataFrame, value: Column, mean: float, std: float,
                     partitions: int | None = None) -> tuple[float, float]:
    """Σ (2i-1) ln Φ(z_i) + (2n+1-2i) ln(1-Φ(z_i)) over ascending ranks i of
    z = (value - mean)/std; returns (sum, n).

    Equal values are one row with their count before anything is ranged: c of them on
    ranks r+1 .. r+c weigh (r+c)² - r² and 2nc less that, so a column that is mostly one
    value moves and ranks as one row of it.
    """
    tied = (df.select(value.cast("double").alias("__x")).filter(F.col("__x").isNotNull())
            .groupBy("__x").agg(F.count(F.lit(1)).alias("__c")))
    laid, _ = _ranged(tied, ["__x"], F.col("__c"), partitions)
    per = {int(r["__pid"]): int(r["n"]) for r in laid.groupBy("__pid").agg(F.sum("__v").alias("n")).collect()}
    offsets, acc = {}, 0
    for pid in sorted(per):
        offsets[pid] = acc
        acc += per[pid]
    n = float(acc)
    log_cdf = D.log_normal_cdf

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for pdf in it:
            if pdf.empty:
                continue
            c = pdf["__v"].to_numpy(dtype="float64")
            top = offsets[int(pdf["__pid"].iloc[0])] + seen + np.cumsum(c)
            seen += int(c.sum())
            low = top * top - (top - c) ** 2
            z = (pdf["__x"].to_numpy(dtype="float64") - mean) / std
            # each tail by itself: no 1 - Φ cancellation, finite far out
            s = float(np.sum(low * log_cdf(z) + (2 * n * c - low) * log_cdf(-z)))
            yield pd.DataFrame({"s": [s]})

    total = laid.mapInPandas(part, "s double").agg(F.sum("s")).first()[0]
    return float(total or 0.0), n


def anderson_darling(df: DataFrame, value: Column, partitions: int | None = None) -> dict:
    """STAT-6: A² with estimated mean and std (n-1), small-sample adjusted
    p-value (D'Agostino & Stephens piecewise form)."""
    st = df.select(value.alias("__x")).agg(F.avg("__x").alias("m"),
                                           F.stddev_samp("__x").alias("s")).first()
    s, n = global_rank_sums(df, value, float(st["m"]), float(st["s"]), partitions)
    a2 = -n - s / n
    a2a = a2 * (1 + 0.75 / n + 2.25 / n ** 2)
    # fixed values: D'Agostino & Stephens (1986) p-value approximation
    if a2a >= 13:  # beyond the formula's range, where its quadratic term would grow again
        p = 0.0
    elif a2a >= 0.6:
        p = math.exp(1.2937 - 5.709 * a2a + 0.0186 * a2a ** 2)
    elif a2a > 0.34:
        p = math.exp(0.9177 - 4.279 * a2a - 1.38 * a2a ** 2)
    elif a2a > 0.2:
        p = 1 - math.exp(-8.318 + 42.796 * a2a - 59.938 * a2a ** 2)
    else:
        p = 1 - math.exp(-13.436 + 101.14 * a2a - 223.73 * a2a ** 2)
    return {"statistic": a2, "adjusted": a2a, "pvalue": p, "n": n}


def durbin_watson(df: DataFrame, value: Column, order: Sequence[str],
                  partitions: int | None = None) -> dict:
    """WIN-2: Σ(e_t - e_{t-1})² / Σ e_t² in ``order``; lag pairs inside each
    range partition in one pass, the pairs across partition boundaries from
    each partition's first and last value."""
    laid, counts = _ranged(df, list(order), value, partitions)

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = prev = pid = None
        ss = dd = 0.0
        for pdf in it:  # batches of one partition arrive in order
            if pdf.empty:
                continue
            v = pdf["__v"].to_numpy(dtype="float64")
            pid = int(pdf["__pid"].iloc[0])
            d = np.diff(v)
            dd += float(np.sum(d * d))
            if prev is None:
                first = float(v[0])
            else:
                dd += (v[0] - prev) ** 2
            prev = float(v[-1])
            ss += float(np.sum(v * v))
        if pid is not None:
            yield pd.DataFrame({"pid": [pid], "ss": [ss], "dd": [dd], "first": [first],
                                "last": [prev]})

    rows = laid.mapInPandas(part, "pid int, ss double, dd double, first double, last double"
                            ).collect()
    per = {r["pid"]: r for r in rows}
    ss = sum(r["ss"] for r in rows)
    dd = sum(r["dd"] for r in rows)
    pids = sorted(per)
    for a, b in zip(pids, pids[1:]):
        dd += (per[b]["first"] - per[a]["last"]) ** 2
    return {"durbin_watson": dd / ss if ss else float("nan"), "n": sum(counts.values())}

