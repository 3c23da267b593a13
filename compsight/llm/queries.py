"""One query per operator, over whole tables; SQL where DuckDB can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compsight.llm import (ann, bpe, conversations, language_id, lexical_search, mixing, ngram_join, packing, pii,
                           quality_classifier, quality_rules, sharding, toxicity)
from compsight.llm.sampling import held_out
from compsight.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near-equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    return found.select(
        "doc_id", *[pii.counted(spans, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.joined(spans, ("email", "ip", "card", "phone")), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"), pii.counted(spans, "iban").alias("n_iban"),
        F.array_max(F.transform(spans, lambda s: s["score"])).alias("max_score"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document and the verdict of the rules and its host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rules = quality_rules.document_rules(docs).drop("text")
    path = scratch_path(spark, "rules")
    rules.write.parquet(path)  # read twice below: texts are measured once
    return (quality_rules.apply_host_rules(spark.read.parquet(path))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "host_rate"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 4-word shingle sets at 85 % Jaccard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link_components(docs, k=4, pct=85).select("doc_id", "n_shingles", "component_id", "class_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page, and whether it is kept; a row has a doc_id or a page_id.

    Documents have text, declared language and host; pages text, declared markup and
    address (host, domain, suffix).
    """
    found = [F.col("lid").alias("language"), F.col("lid_posterior").alias("posterior"),
             F.col("lid_text").alias("text_language"), F.col("lid_kept").alias("kept")]
    none = F.lit(None).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return language_id.identify_documents(spark, docs).select("doc_id", *found, none.alias("page_id")).unionByName(
        language_id.identify_pages(spark, pages).select(none.alias("doc_id"), *found, "page_id"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "statistics")
    quality_classifier.text_statistics(docs).drop("text").write.parquet(path)  # learnt from and scored
    stats = spark.read.parquet(path)
    model = quality_classifier.fit(stats, table(spark, sf_dir, "labels"))
    return quality_classifier.score(stats, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"),
        (F.col("quality") >= 0.3).cast("int").alias("predicted"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 20, 20,
                       epsilon=ann.EPSILON, reach=ann.REACH)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents, sources weighing 3, 1, 2 in turn and 150 % in all, takes of each."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken",
                        F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after its damage."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    key = F.coalesce(F.concat(F.lit("a"), F.col("conv_id").cast("string")), F.lit("b"))
    audits, repaired = conversations.repair(conversations.damage(turns))
    hashed = conversations.digests(repaired, F.concat_ws(":", "role", "text"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (turns.select("conv_id").distinct().withColumn("key", key).join(audits, "key", "left")
            .join(hashed, "key", "left")
            .select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


#: A text's terms: the class is the complement of the contract's, in characters that DuckDB's patterns take.
_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[0-9A-Za-z\x{80}-\x{10FFFF}]+')")

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
doc AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM doc),
word AS (SELECT r, unnest(t) AS term FROM doc),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM word GROUP BY ALL),
item AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
iterm AS (SELECT i, unnest(t) AS term FROM item),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM iterm) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
m AS (SELECT r, doc_id, 10 + (90 * n * nd) // l AS m FROM doc, total),
score AS (SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
          FROM iterm JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r),
best AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
         FROM score JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM best JOIN item USING (i) WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_nearest": op10_nearest,
    "op11_mixing": op11_mixing,
    "op12_conversations": op12_conversations,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE: dict[str, str] = {"op13_lexical_search": OP13_SQL}
