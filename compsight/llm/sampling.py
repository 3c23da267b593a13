"""Labelled rows that a classifier may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, label) of about ``per_class`` rows of each class at most, and each class's weight.

    Held-out rows and rows without id or label are left out.  Rows are chosen by a hash
    of the id, so the choice does not depend on order or partitions; a row stands for
    ``weight`` rows of its class.
    """
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, per_class / k) for c, k in n.items()}
    at = F.xxhash64("doc_id", F.lit(label)).cast("double") / F.lit(2.0**64) + 0.5
    chosen = rows.where(at < F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    return chosen, {c: 1 / s for c, s in share.items()}
