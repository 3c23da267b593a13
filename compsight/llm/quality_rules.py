"""Quality rules per document, and verdicts on hosts from their documents' failures.

A host's failure rate is shrunk towards the corpus by an empirical beta prior:
its mean and strength come from the hosts' counts by the method of moments.  A
host whose shrunk rate reaches the limit loses all its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compsight.llm.rows import add_columns, bytes_of, text_col
from compsight.session import scratch_path

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
#: Continuation bytes of UTF-8 and white space: what is left has one byte per word character.
NOT_STARTS = bytes([*range(0x80, 0xC0), *BLANK])
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ (key >> np.uint64(29))) * MIX + h[k:k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return (len(words), len(raw.translate(None, NOT_STARTS)),
            len(raw.translate(None, NOT_SYMBOLS)), dup, repeated_words(words))


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the five counts and ``base_failed``; null and empty texts have no words and fail."""
    def make():
        def fn(texts):
            rows = [measure(raw) for raw in bytes_of(texts)]
            return [pa.array(c, pa.int64()) for c in zip(*rows)]
        return fn
    out = add_columns(docs, [text_col(docs, text)], STATS, make)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def host_rates(rules: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, failed, rate, shrunk) from the documents' ``base_failed``.

    Beta prior by moments over hosts: mean m = failures / documents, variance v of the
    hosts' rates less what sampling alone gives; strength m (1 - m) / v - 1.  Where no
    variance is left (one host, equal rates) the prior is as strong as all documents
    together.  Documents without a host form no host.
    """
    hosts = (rules.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host"))
             .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    # Two passes over the per-host table: the mean first, then the spread around it.
    mean = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.sum("n").alias("total"))
    spread = (hosts.crossJoin(F.broadcast(mean))  # the right side is one row
              .groupBy("m", "total")
              .agg((F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.col("m"), 2))
                    / F.sum("n")).alias("seen"),
                   (F.sum(F.col("m") * (1 - F.col("m"))) / F.sum("n")).alias("sampling")))
    prior = spread.select("m", F.when(
        F.col("seen") > F.col("sampling"),
        F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / (F.col("seen") - F.col("sampling")) - 1)
    ).otherwise(F.col("total").cast("double")).alias("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "n", "failed", (F.col("failed") / F.col("n")).alias("rate"),
        ((F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("shrunk"))


def apply_host_rules(rules: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """``rules`` plus ``host_rate`` (shrunk; null without a host) and ``kept``.

    ``kept`` is false where ``base_failed``, or where the host's shrunk failure rate
    is at least ``max_rate``.  The host table joins by a shuffle join that AQE can
    split where one host holds many documents, or broadcast where it is small.
    """
    rates = host_rates(rules, host).select(F.col("host").alias("__host"), F.col("shrunk").alias("host_rate"))
    # Written, so that Spark knows its size: a small host table is broadcast, a large one is not.
    path = scratch_path(rules.sparkSession, "host-rates")
    rates.write.parquet(path)
    rates = rules.sparkSession.read.parquet(path)
    plain = rules.drop("host_rate", "kept")
    out = plain.join(rates, F.col(f"`{host}`") == F.col("__host"), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) < max_rate))
