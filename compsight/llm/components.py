"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compsight.session import scratch_path


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _marked(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: all larger neighbours of an id hang on its smallest one; (hung edges, each id's smallest)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = _stored(large.where("u != v").distinct(), "large-star")
    return large, large.groupBy("u").agg(F.min("v").alias("m"))


def partial_labels(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) after one round: ids with one label are connected, others may be too."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    return _star(_stored(edges, "links"))[1].select(F.col("u").alias("id"), F.col("m").alias("component"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every linked id but each component's smallest, which is its name.

    Ends when a round changes nothing.  A hub is a skewed join key, which AQE splits,
    and its minimum is pre-aggregated; the driver gets one row a round.
    """
    edges = _stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u != v").distinct(), "links")
    mark = _marked(edges)
    while mark[0]:
        large, least = _star(edges)
        hung = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _stored(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _marked(small)
        edges, done, mark = small, now == mark, now
        if done:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
