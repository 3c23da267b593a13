"""Running sums over a whole table in a stated order, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compsight.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its plan ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running(df: DataFrame, order: Sequence[str], sums: dict[str, Column], name: str = "running") -> DataFrame:
    """``df`` plus, for each of ``sums``, the long total over all rows before a row (stored).

    Rows are exchanged by range of ``order``; the driver gets one total per
    partition, a window runs inside each partition.  Rows equal in ``order`` follow
    one another in any way.  A table without rows stays empty.
    """
    spark, cols = df.sparkSession, df.columns
    given = stored(df.select("*", *[c.cast("long").alias(f"__add_{k}") for k, c in sums.items()]), f"{name}-rows")
    ranged = stored(given.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), f"{name}-ranges")
    totals = ranged.groupBy("__pid").agg(*[F.sum(f"__add_{k}").alias(k) for k in sums]).orderBy("__pid").collect()
    starts, at = [], dict.fromkeys(sums, 0)
    for r in totals:
        starts.append((r["__pid"], *at.values()))
        at = {k: v + r[k] for k, v in at.items()}
    offsets = spark.createDataFrame(starts or [(0, *at.values())],
                                    "__pid int, " + ", ".join(f"__start_{k} long" for k in sums))
    w = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.col(f"__start_{k}") + F.coalesce(F.sum(f"__add_{k}").over(w), F.lit(0))).alias(k) for k in sums]
    # One row a partition: as many as tasks, whatever the number of rows.
    return stored(ranged.join(F.broadcast(offsets), "__pid").select(*cols, *before), name)
