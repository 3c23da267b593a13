"""Deterministic sampling and train/test split (SMP-1, SMP-2), plus an exact
distributed k-th smallest (radix select) used by the exact split.

Membership depends only on a hash of (id, seed), never on partitioning, so
results are stable under repartitioning and engine-portable (the same hash
is expressible in SQL).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import stored

HASH_BUCKETS = 10_000
DIGIT_BITS = 16


def seeded_hash_text(id_col: str, seed: int = C.RANDOM_STATE) -> Column:
    """md5 of ``<id>|<seed>`` as hex text (sample order)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def seeded_hash32(id_col: str, seed: int = C.RANDOM_STATE) -> Column:
    """First 8 hex digits of the seeded md5 as a non-negative 32-bit integer."""
    return F.conv(F.substring(seeded_hash_text(id_col, seed), 1, 8), 16, 10).cast("long")


def split_flags(df: DataFrame, id_col: str = "source_row", test_size: float = C.TEST_SIZE,
                seed: int = C.RANDOM_STATE, flag: str = "is_test") -> DataFrame:
    """SMP-2 (default): one narrow pass, test when hash mod 10000 < share."""
    cut = int(round(test_size * HASH_BUCKETS))
    return df.withColumn(flag, (seeded_hash32(id_col, seed) % HASH_BUCKETS) < cut)


def _digit(col: Column, shift: int, signed_top: bool) -> Column:
    d = F.shiftright(col, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
    if signed_top:  # order negative values first in the top digit
        d = d.bitwiseXOR(F.lit(1 << (DIGIT_BITS - 1)))
    return d


def kth_smallest(df: DataFrame, col: str, k: int, bits: int = 64, signed: bool = True) -> int:
    """Exact k-th smallest (1-based) of a long column by radix select.

    Each level is one aggregate over the rows matching the prefix found so
    far and returns at most 2^16 (digit, count) rows to the driver; at most
    ``bits / 16`` levels.  Nothing proportional to the data leaves Spark.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    c = F.col(col)
    levels = math.ceil(bits / DIGIT_BITS)
    remaining = k
    cond = F.lit(True)
    value = 0
    for lvl in range(levels):
        shift = (levels - 1 - lvl) * DIGIT_BITS
        top = signed and lvl == 0 and bits == 64
        dig = _digit(c, shift, top)
        hist = (df.filter(cond & c.isNotNull()).groupBy(dig.alias("d"))
                .agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect())
        acc = 0
        chosen = None
        for row in hist:
            if acc + row["n"] >= remaining:
                chosen = int(row["d"])
                break
            acc += row["n"]
        if chosen is None:
            raise ValueError(f"k={k} exceeds the number of non-null values")
        remaining -= acc
        cond = cond & (dig == chosen)
        raw = chosen ^ (1 << (DIGIT_BITS - 1)) if top else chosen
        value |= raw << shift
    if signed and bits == 64 and value >= 1 << 63:
        value -= 1 << 64
    return value


def split_exact(df: DataFrame, id_col: str = "source_row", test_size: float = C.TEST_SIZE,
                seed: int = C.RANDOM_STATE, flag: str = "is_test") -> DataFrame:
    """SMP-2 ``exact=True``: exactly ceil(test_size * n) test rows, the ones with
    the smallest (hash, id).  The (hash, id) pairs are checkpointed once, then
    radix selection finds the threshold pair without any global sort."""
    h = seeded_hash32(id_col, seed)
    keys = stored(df.select(h.alias("h"), F.col(id_col).alias("i")), "cut")
    n = keys.count()
    k = math.ceil(test_size * n) if n else 0
    if k == 0:
        return df.withColumn(flag, F.lit(False))
    h_star = kth_smallest(keys, "h", k, bits=32, signed=False)
    below = keys.filter(F.col("h") < h_star).count()
    ties = keys.filter(F.col("h") == h_star)
    need = k - below
    n_ties = ties.count()
    hh = seeded_hash32(id_col, seed)
    if need >= n_ties:
        return df.withColumn(flag, hh <= h_star)
    i_star = kth_smallest(ties, "i", need)
    return df.withColumn(flag, (hh < h_star) | ((hh == h_star) & (F.col(id_col) <= i_star)))


def seeded_sample(df: DataFrame, n: int = C.AUDIT_SAMPLE_ROWS, id_col: str = "source_row",
                  seed: int = C.RANDOM_STATE) -> DataFrame:
    """SMP-1: exactly ``n`` rows in seeded-hash order (top-k, no global sort)."""
    return df.orderBy(seeded_hash_text(id_col, seed), F.col(id_col)).limit(n)
