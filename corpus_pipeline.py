"""Corpus pipeline: language, toxicity, near copies, personal data, packing.

Every stage takes what the stage before kept, is written as Parquet in the shared
folder and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compsight.llm import language_id, ngram_join, packing, pii, toxicity
from compsight.session import scratch_path

#: Words of a shingle and least similarity in per cent of near copies; score from which a document is toxic.
SHINGLE, SIMILAR = 5, 80
TOXIC = 0.5
CAPACITY = 2048
#: Rows of an Arrow batch in the stages: texts of 128 KB come many at a time otherwise.
BATCH_ROWS = "500"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus declares; those that language ID rejects go."""
    return language_id.identify_documents(spark, docs).where("lid_kept").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``TOXIC``, learnt from the labels of documents that came here."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("toxicity") < TOXIC).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    return ngram_join.keep_one(docs, ngram_join.link_components(docs, SHINGLE, SIMILAR))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows, null texts stay null."""
    found = pii.find_pii(docs, masked="__masked")
    text = F.when(F.col("text").isNotNull(), F.col("__masked"))
    new = {"text": text, "n_chars": F.when(text.isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of ``CAPACITY`` tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The stages learn models and tokenize, which SQL does not state; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_ROWS)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)
    return docs
