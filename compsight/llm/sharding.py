"""Sharding by global byte-size prefix sums.

Rows are range-partitioned in id order; per-partition totals give every
partition its global start, a window inside each partition the start of every
row.  Cutting that line at equal byte targets gives contiguous shards whose
sizes differ by about one document.  All JVM-side DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compsight.session import scratch_path


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, start) of every row.

    ``size`` is the UTF-8 bytes of the text (null: none) plus ``overhead``; ``start``
    the bytes of all rows before it; ``slot`` counts rows of a shard from 0.  Shards
    are contiguous in (id, nulls first; crc; input order).  A row goes to the shard
    that its middle byte falls into.  Null ids, equal ids and repeated rows are
    rows like any other; a document is never cut, so one larger than a shard's
    target leaves neighbours short or empty.  An empty table gives no rows.
    Equal texts are not kept together: this method has no groups.  Other columns
    of ``docs`` are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       F.monotonically_increasing_id().alias("seq"))
    # Written before the range exchange samples it: texts are read once, and the
    # tie-breaker stays what it was if a task is run again.
    path = scratch_path(spark, "shard-rows")
    slim.write.parquet(path)
    slim = spark.read.parquet(path)
    ranged = scratch_path(spark, "shard-ranges")
    (slim.repartitionByRange("doc_id", "text_crc32", "seq")
     .withColumn("pid", F.spark_partition_id()).write.parquet(ranged))
    rows = spark.read.parquet(ranged)

    # One total per partition: bounded by the number of partitions.
    totals = rows.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    starts, at, count = [], 0, 0
    for r in sorted(totals, key=lambda r: r.pid):
        starts.append((r.pid, at, count))
        at, count = at + r.bytes, count + r.n
    offsets = F.broadcast(spark.createDataFrame(starts or [(0, 0, 0)],
                                                "pid int, part_start long, part_row long"))
    w = Window.partitionBy("pid").orderBy("doc_id", "text_crc32", "seq")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (rows.join(offsets, "pid")
              .withColumn("start", F.col("part_start") + before)
              .withColumn("row", F.col("part_row") + F.row_number().over(w) - 1)
              .withColumn("shard", F.least(
                  F.expr(f"(2 * start + size) * {shards}D / {2 * max(at, 1)}D").cast("int"),
                  F.lit(shards - 1)))
              .select("doc_id", "size", "text_crc32", "shard", "row", "start"))
    path = scratch_path(spark, "shard-places")
    placed.write.parquet(path)
    placed = spark.read.parquet(path)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first_row")))
    return (placed.join(first, "shard")
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("row") - F.col("first_row")).alias("slot"), "start"))
