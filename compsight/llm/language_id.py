"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text's likelihood under a model
of byte trigrams per language; the language that the markup declares; the suffix
of the address; and a prior of the host, smoothed towards its domain and that
towards the corpus.  Texts alone give a first posterior; grouped sums of it
give the priors of hosts and suffixes; the second posterior joins them in.

The trigram models are fitted on a bounded sample of documents that declare a
language; all counts behind the priors cover all rows.  Texts fall into two halves by
a hash, so that copies stay together, and each half is judged by models of the other.
A declared tag is a language if enough texts declare it and if a model of one half
predicts the other better than single letters do, which random letters cannot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compsight.llm.rows import add_columns, forget, offsets_of, text_col
from compsight.session import scratch_path

#: Buckets of hashed byte trigrams.
BUCKETS = 1 << 15
#: Text bytes whose trigrams are looked up at once (a longer text comes whole).
PART_BYTES = 1 << 19
#: Rows per language and half that a trigram model is fitted on.
FIT_ROWS = 1500
#: Least texts (copies count once) that declare a language, and least gain per trigram over single letters
#: (mean log-likelihood of texts that the model has not seen).
LEAST_TEXTS = 10
LEAST_GAIN = 0.5
#: Tags that stand for no, an unknown or more than one language.
NO_LANGUAGE = ("und", "mul", "zxx", "mis", "xx", "zz")
#: Tags of three letters for languages that have one of two.
SHORT_TAG = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es"}
#: Trigrams of a text overlap and repeat: a text of n counts as n ** TEMPER independent ones.
TEMPER = 0.6
#: Weight of a corpus-wide prior against a host's, and a domain's, own documents.
HOST_WEIGHT = 20.0
DOMAIN_WEIGHT = 100.0
#: Chance that declared markup, or a suffix that stands for a language, is right.
DECLARED_TRUST = 0.9
SUFFIX_TRUST = 0.7
#: Least posterior of the best language, and least mean log-likelihood of a trigram
#: against that of the language's own texts, that a document is kept with.
MIN_POSTERIOR = 0.5
MAX_SURPRISE = 5.0
#: Least trigrams with a letter that a kept document has, unless at least half of its trigrams are such
#: (one short word); trigrams without a letter say nothing and are not counted.
LEAST_TRIGRAMS = 3
#: Country suffixes and the language that they stand for.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es",
                   "uk": "en", "us": "en", "au": "en", "ie": "en"}


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each byte of lower-cased data (two fewer than bytes)."""
    x = FOLD[data].astype(np.int32)
    return ((x[:-2] * 961 + x[1:-1] * 31 + x[2:]) * 40503 >> 3) & (BUCKETS - 1)


def lettered(data: np.ndarray) -> np.ndarray:
    """Whether the trigram that begins at each byte holds a letter."""
    x = FOLD[data] != 32
    return x[:-2] | x[1:-1] | x[2:]


def _fold() -> np.ndarray:
    """Letters and bytes of longer characters; a run of anything else reads as a space."""
    t = np.full(256, 32, np.uint8)
    t[np.arange(97, 123)] = t[np.arange(65, 91)] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


FOLD = _fold()


@dataclass
class Model:
    """Log-likelihood of each bucket per language, and how surprising a language's own texts are.

    ``loglik[h]`` judges texts of half ``h`` and is fitted on those of the other.
    """

    languages: list[str]
    loglik: np.ndarray = field(repr=False)
    expected: np.ndarray = field(repr=False)


def language_tag(declared: Column) -> Column:
    """Primary part of a whole language tag (de, de-AT, deu); null for anything else."""
    tag = F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_][a-z0-9]{1,8})*$", 1)
    short = F.create_map(*[F.lit(x) for kv in SHORT_TAG.items() for x in kv])
    return F.when((tag != "") & ~tag.isin(*NO_LANGUAGE), F.coalesce(F.try_element_at(short, tag), tag))


def half_of(text: Column) -> Column:
    """0 or 1, the same for equal texts."""
    return F.pmod(F.xxhash64(text, F.lit("half")), F.lit(2)).cast("int")


def fit(docs: DataFrame, declared: Column, text: str = "text", id_col: str = "doc_id",
        rows: int = FIT_ROWS) -> Model:
    """Trigram counts of a sample: of each declared language about ``rows`` documents a half at most.

    The sample is chosen by a hash of the id.  Counters come to the driver (``BUCKETS``
    and 256 for each half of a language), no texts.
    """
    slim = docs.select(language_tag(declared).alias("lang"), text_col(docs, text).alias("text"),
                       F.xxhash64(F.col(f"`{id_col}`"), F.lit("language")).alias("h"))
    slim = slim.where(F.col("lang").isNotNull() & (F.octet_length("text") >= 20))
    counts = {r.lang: r.n for r in slim.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_distinct(F.xxhash64("text")).alias("texts")).where(
        F.col("texts") >= LEAST_TEXTS).collect()}
    if not counts:
        return _model({})
    # A share of the hash range, so that choosing needs no sort; about ``rows`` of each half of a language.
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * rows / n)))])
    at = (F.col("h").cast("double") / F.lit(2.0**64) + 0.5)
    chosen = slim.where(at < F.try_element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def flushed():
            for (lang, half), c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array([half] * len(at), pa.int32()), pa.array(at),
                     pa.array(c[at])], ["lang", "half", "at", "n"])
            sums.clear()

        for b in batches:
            for lang, half, t in zip(*(c.to_pylist() for c in b.columns)):
                raw = np.frombuffer(b" " + t.encode() + b" ", np.uint8)
                said, x = lettered(raw), FOLD[raw]
                c = np.bincount(trigrams(raw)[said], minlength=BUCKETS + 256)
                for y in (x[:-2], x[1:-1], x[2:]):  # after the trigrams: the letters that they are made of
                    c[BUCKETS:] += np.bincount(y[said], minlength=256)
                sums[lang, half] = sums[lang, half] + c if (lang, half) in sums else c
            if len(sums) > 100:
                yield from flushed()
        yield from flushed()

    got = (chosen.select("lang", half_of(F.col("text")).alias("half"), "text")
           .mapInArrow(count, "lang string, half int, at long, n long")
           .groupBy("lang", "half", "at").agg(F.sum("n").alias("n")).toPandas())
    sums = {lang: np.zeros((2, BUCKETS + 256)) for lang in sorted(set(got["lang"]))}
    for (lang, half), own in got.groupby(["lang", "half"]):
        sums[lang][half, own["at"].to_numpy()] = own["n"].to_numpy()
    return _model(sums)


def _model(sums: dict[str, np.ndarray]) -> Model:
    """Models of the tags whose texts they predict; counts of trigrams and then of letters, by half."""
    languages, loglik, expected = [], [], []
    for lang, n in sums.items():
        other = n[::-1]  # what judges a half is fitted on the other
        tri, single = (np.log((c + 0.05) / (c.sum(1, keepdims=True) + 0.05 * c.shape[1]))
                       for c in (other[:, :BUCKETS], other[:, BUCKETS:]))
        total = max(1.0, n[:, :BUCKETS].sum())
        mean, by_letter = (n[:, :BUCKETS] * tri).sum() / total, (n[:, BUCKETS:] * single).sum() / total
        if mean - by_letter >= LEAST_GAIN:
            languages.append(lang)
            loglik.append(tri.astype(np.float32))
            expected.append(mean)
    return Model(languages, np.stack(loglik, 2) if loglik else np.zeros((2, BUCKETS, 0), np.float32), np.array(expected))


def _means(texts: pa.Array, half: np.ndarray, loglik: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-likelihood of each text's trigrams with a letter per language, and how many it has.

    Some ``PART_BYTES`` of text at a time: what is kept for each byte takes many times its size.
    """
    ends = offsets_of(texts).astype(np.int64)
    parts, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PART_BYTES, side="right")) - 1)
        parts.append(_part_means(texts.slice(lo, hi - lo), half[lo:hi], loglik))
        lo = hi
    if not parts:
        return np.zeros((0, loglik.shape[2])), np.zeros(0, np.int64)
    return np.concatenate([m for m, _ in parts]), np.concatenate([n for _, n in parts])


def _part_means(texts: pa.Array, half: np.ndarray, loglik: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offs = offsets_of(texts).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0]:offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    start, k = offs[:-1] - offs[0], loglik.shape[2]
    n = np.maximum(0, np.diff(offs) - 2)
    means = np.zeros((len(n), k))
    some = np.flatnonzero(n)
    if len(some):
        said = np.append(lettered(raw), False)
        at = trigrams(raw) + np.repeat(np.int32(BUCKETS) * half.astype(np.int32), np.diff(offs))[:len(raw) - 2]
        # Sums between begin and begin + n of each text; what lies between texts is left out.
        cuts = np.stack([start[some], start[some] + n[some]], 1).ravel()
        n[some] = np.add.reduceat(said, cuts, dtype=np.int64)[::2]
        for j in range(k):
            line = np.append(loglik[:, :, j].ravel()[at], np.float32(0)) * said
            means[some, j] = np.add.reduceat(line, cuts, dtype=np.float64)[::2] / np.maximum(1, n[some])
    return means, n


def _told(says: np.ndarray, trust: float, k: int) -> np.ndarray:
    """Log-likelihood per language of what markup or suffix say (a language's number, -1: nothing)."""
    out = np.full((len(says), k), np.log(max(1e-9, (1 - trust) / max(1, k - 1))))
    out[np.arange(len(says)), np.maximum(says, 0)] = np.log(trust)
    return np.where((says >= 0)[:, None], out, 0.0)


def fuse(means: np.ndarray, n: np.ndarray, declared: np.ndarray, suffix: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Posterior per text and language; ``prior`` holds log priors of the host."""
    k = means.shape[1]
    logs = means * (n.astype(float) ** TEMPER)[:, None] + prior \
        + _told(declared, DECLARED_TRUST, k) + _told(suffix, SUFFIX_TRUST, k)
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _number(says: Column, by: dict[str, int]) -> Column:
    """The number of the language that a value stands for, -1 if none."""
    table = F.create_map(*[F.lit(x) for kv in by.items() for x in kv])
    return F.coalesce(F.try_element_at(table, says), F.lit(-1)) if by else F.lit(-1)


def identify(docs: DataFrame, model: Model, declared: Column, host: Column, suffix: Column,
             text: str = "text") -> DataFrame:
    """``docs`` plus ``lid string``, ``lid_posterior double``, ``lid_text string`` and ``lid_kept boolean``.

    Null or unknown declarations, hosts and suffixes give no evidence.  A text with
    fewer trigrams that hold a letter than ``LEAST_TRIGRAMS`` asks for is rejected; so is one whose
    best posterior is under ``MIN_POSTERIOR`` or whose text is far from anything that
    its language's texts look like.  Ties go to the language first in the alphabet.
    Without any known language every document is rejected.
    """
    spark = docs.sparkSession
    langs, k = model.languages, len(model.languages)
    plain = docs.drop("lid", "lid_posterior", "lid_text", "lid_kept")
    if not langs:
        return plain.withColumns({"lid": F.lit(None).cast("string"), "lid_posterior": F.lit(0.0),
                                  "lid_text": F.lit(None).cast("string"), "lid_kept": F.lit(False)})
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers for each language
    number = {x: j for j, x in enumerate(langs)}
    told = plain.withColumns({
        "__host": host, "__declared": _number(language_tag(declared), number),
        "__suffix": _number(F.lower(suffix), {s: number[x] for s, x in SUFFIX_LANGUAGE.items() if x in number})})
    none = F.array(*[F.lit(0.0)] * k)

    def first():
        forget()
        loglik = shared.value.loglik

        def fn(texts, half, says, suffixes):
            means, n = _means(texts, half.to_numpy(), loglik)
            p = fuse(means, n, says.to_numpy(), suffixes.to_numpy(), np.zeros_like(means))
            return list(pa.array(p[:, j]) for j in range(k))
        return fn

    # Texts are read twice, once to sum the priors and once to judge: they are neither shuffled nor kept.
    names = [f"p{j}" for j in range(k)]
    seen = told.select("__host", text_col(told, text).alias("text"), "__declared", "__suffix")
    seen = add_columns(seen, [F.col("text"), half_of(F.col("text")), F.col("__declared"), F.col("__suffix")],
                       ", ".join(f"{x} double" for x in names), first)
    # Fractions as integers: their sums do not depend on the order of rows.
    units = 1 << 20
    per_host = seen.groupBy("__host").agg(
        *[(F.sum((F.col(x) * units).cast("long")) / units).alias(x) for x in names]).withColumn(
        "__domain", F.regexp_extract("__host", r"([^.]+\.[^.]+)$", 1))
    path = scratch_path(spark, "hosts")
    per_host.write.parquet(path)  # one row per host
    per_host = spark.read.parquet(path)

    def shares(prefix: str) -> str:
        return " + ".join(f"{prefix}{j}" for j in range(k))

    corpus = per_host.agg(*[F.sum(f"p{j}").alias(f"c{j}") for j in range(k)]).selectExpr(
        *[f"(c{j} + 1) / ({shares('c')} + {k}) as c{j}" for j in range(k)])
    domains = (per_host.where("__domain != ''").groupBy("__domain")
               .agg(*[F.sum(f"p{j}").alias(f"d{j}") for j in range(k)]))
    # Each level leans on the one above it: host on domain, domain on corpus (one row).
    leaned = (per_host.where("__host is not null").join(domains, "__domain", "left")
              .crossJoin(F.broadcast(corpus)).na.fill(0.0, [f"d{j}" for j in range(k)])
              .selectExpr("__host", *names, *[
                  f"(d{j} + {DOMAIN_WEIGHT} * c{j}) / ({shares('d')} + {DOMAIN_WEIGHT}) as d{j}" for j in range(k)])
              .select(F.col("__host").alias("__known"), F.array(*[F.expr(
                  f"ln((p{j} + {HOST_WEIGHT} * d{j}) / ({shares('p')} + {HOST_WEIGHT}))") for j in range(k)]
              ).alias("__prior")))
    # Written, so that Spark knows its size: a small host table is broadcast, a large one is not.
    path = scratch_path(spark, "host-priors")
    leaned.write.parquet(path)
    joined = told.join(spark.read.parquet(path), F.col("__host") == F.col("__known"), "left")

    def last():
        forget()
        m = shared.value

        def fn(texts, half, says, suffixes, prior):
            means, n = _means(texts, half.to_numpy(), m.loglik)
            p = fuse(means, n, says.to_numpy(), suffixes.to_numpy(), prior.flatten().to_numpy().reshape(-1, k))
            best, rows = p.argmax(1), np.arange(len(p))
            said = (n > 0) & ((n >= LEAST_TRIGRAMS) | (2 * n >= np.diff(offsets_of(texts)) - 2))
            kept = said & (p[rows, best] >= MIN_POSTERIOR) & (means[rows, best] >= m.expected[best] - MAX_SURPRISE)
            return [pa.array([langs[j] for j in best], pa.string()), pa.array(p[rows, best]),
                    pa.array([langs[j] if c else None for j, c in zip(means.argmax(1), n)], pa.string()), pa.array(kept)]
        return fn

    out = add_columns(joined, [text_col(joined, text), half_of(text_col(joined, text)), F.col("__declared"), F.col("__suffix"),
                               F.coalesce("__prior", none)],
                      "lid string, lid_posterior double, lid_text string, lid_kept boolean", last)
    return out.drop("__host", "__known", "__declared", "__suffix", "__prior")


def host_of(url: Column) -> Column:
    """Host of an address, lower-cased, without port, user or www; null if there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]+)", 1)
    return F.when(h != "", h)


def suffix_of(host: Column) -> Column:
    """What stands after a host's last dot."""
    s = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    return F.when(s != "", s)


def markup_language(html: Column) -> Column:
    """The language that an html tag declares."""
    return language_tag(F.regexp_extract(html, r"(?i)<html\b[^>]*?(?<![\w-])lang\s*=\s*[\"']?([\w-]+)", 1))


def markup_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")


def identify_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang, source) identified: ``lang`` is what was declared, ``source`` the host."""
    model = fit(docs, F.col("lang"))
    return identify(docs, model, F.col("lang"), F.col("source"), F.lit(None).cast("string"))


def identify_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, text, lang, host and what ``identify`` adds.

    Pages are a corpus of their own: text without markup, the language that the html tag
    declares, the address with its host, domain and suffix.
    """
    path = scratch_path(spark, "pages")
    (pages.select("page_id", markup_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("lang"),
                  host_of(F.col("url")).alias("host")).write.parquet(path))  # markup is parsed once, texts are read four times
    texts = spark.read.parquet(path)
    host = F.col("host")
    return identify(texts, fit(texts, F.col("lang"), id_col="page_id"), F.col("lang"), host, suffix_of(host))
