"""Language identification: every row of both tables, evidence fused as in plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from compsight.llm import language_id as L
from compsight.llm.queries import QUERIES

WORDS = {"de": ["und", "nicht", "schule", "straße", "zwischen"], "en": ["the", "which", "through", "school", "with"]}


def write_tables(spark, path, pages, docs):
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(
        f"{path}/documents.parquet")


def prose(rng, lang, n=15):
    return " ".join(rng.choice(WORDS[lang], n))


def fused(rows, model):
    """Posterior of rows (text, half, declared, host) by language, in plain Python."""
    langs, k = model.languages, len(model.languages)

    def told(x, trust):
        return [0.0] * k if x not in langs else [
            math.log(trust if y == x else max(1e-9, (1 - trust) / max(1, k - 1))) for y in langs]

    def posterior(logs):
        p = np.exp(np.array(logs) - max(logs))
        return p / p.sum()

    base = []
    for text, half, declared, host in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        at = L.trigrams(raw)[L.lettered(raw)] if len(raw) > 2 else np.zeros(0, int)
        mean = [sum(float(model.loglik[half, a, j]) for a in at) / max(1, len(at)) for j in range(k)]
        suffix = L.SUFFIX_LANGUAGE.get((re.search(r"\.([a-z]+)$", host or "") or [0, ""])[1])
        base.append([m * len(at) ** L.TEMPER + a + b for m, a, b in
                     zip(mean, told(declared, L.DECLARED_TRUST), told(suffix, L.SUFFIX_TRUST))])
    hosts, domains, corpus = (defaultdict(lambda: np.zeros(k)) for _ in range(3))
    domain = {}
    for (*_, host), logs in zip(rows, base):
        corpus[0] += posterior(logs)
        if host is not None:
            hosts[host] += posterior(logs)
            domain[host] = host.split(".")[-2:]
            if len(domain[host]) == 2:
                domains[tuple(domain[host])] += posterior(logs)
    c = (corpus[0] + 1) / (corpus[0].sum() + k)
    out = []
    for (*_, host), logs in zip(rows, base):
        if host is None:
            out.append(posterior(logs))
            continue
        d = domains.get(tuple(domain[host]), np.zeros(k))
        d = (d + L.DOMAIN_WEIGHT * c) / (d.sum() + L.DOMAIN_WEIGHT)
        h = (hosts[host] + L.HOST_WEIGHT * d) / (hosts[host].sum() + L.HOST_WEIGHT)
        out.append(posterior(np.array(logs) + np.log(h)))
    return out


def test_pages_are_identified_with_all_their_evidence(spark, tmp_path):
    rng = np.random.default_rng(7)
    urls = {"de": ["https://www.a.shop.de/x", "http://b.shop.de:80/", "http://c.mixed.com/1"],
            "en": ["http://u@x.mixed.com/?q", "http://x.co.uk/", "https://y.mixed.com"]}
    pages = []
    for i in range(120):
        lang = ("de", "en")[i % 2]
        pages.append((i, urls[lang][i % 3], f'<html lang="{lang}"><script>var the = 1</script><p>{prose(rng, lang)}</p>'))
    pages += [(200, "http://d.shop.de/", "<p>ab cd</p>"), (201, "http://z.mixed.com/", "<p>ab cd</p>"),
              (202, None, '<html lang="de">which school'), (203, "http://x.co.uk/", None), pages[0]]
    docs = [(i, prose(rng, ("de", "en")[i % 2]), ("de", "en")[i % 2], f"src{i % 3}") for i in range(60)]
    write_tables(spark, tmp_path, pages, docs)
    rows = QUERIES["op7_language_id"](spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in rows if r.page_id is None) == Counter(range(60))
    assert Counter(r.page_id for r in rows if r.doc_id is None) == Counter(p[0] for p in pages)

    found = L.identify_pages(spark, spark.read.parquet(f"{tmp_path}/pages.parquet"))
    texts = {r.page_id: (r.text or "", r.half, r.lang, r.host) for r in found.withColumn(
        "half", L.half_of(F.coalesce("text", F.lit("")))).collect()}
    frame = spark.createDataFrame([(p[0], *texts[p[0]]) for p in pages], "page_id long, text string, half int, lang string, host string")
    model = L.fit(frame, frame["lang"], id_col="page_id")
    want = {p[0]: x for p, x in zip(pages, fused([texts[p[0]] for p in pages], model))}
    got = {r.page_id: r for r in rows if r.doc_id is None}
    for i, p in want.items():
        assert got[i].language == model.languages[int(p.argmax())] and abs(got[i].posterior - p.max()) < 1e-4, i
    assert all(got[i].kept and got[i].language == ("de", "en")[i % 2] for i in range(120))
    assert got[200].language == "de"  # suffix and domain alone
    assert not got[203].kept


def test_junk_is_no_language_and_not_kept(spark):
    rng = np.random.default_rng(3)

    def junk(n=40):
        return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(n))

    rows = [(i, prose(rng, ("de", "en")[i % 2], 60), ("de-AT", "en")[i % 2]) for i in range(200)]
    tags = ("xx", "zz", "unknown", "qq", "est", "sw-KE")
    rows += [(1000 + i, junk(), tags[i % 6]) for i in range(600)]
    rows += [(2000 + i, "it" + " va bene" * 8, "it") for i in range(30)]  # one text thirty times
    rows += [(3000, "4711 0815 " * 30, "en"), (3001, "3.14 -- 99!", None), (3002, "... 12 a", "en"),
             (3003, "the school 4711 " * 5, "en"), (3004, "which", "en"), (3005, "th.", "en")]
    docs = spark.createDataFrame([(*r, "src0") for r in rows], "doc_id long, text string, lang string, source string")
    assert L.fit(docs, F.col("lang")).languages == ["de", "en"]
    got = {r.doc_id: r for r in L.identify_documents(spark, docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lid_kept and got[i].lid == ("de", "en")[i % 2] for i in range(200))
    assert not any(got[1000 + i].lid_kept for i in range(600))
    assert not any(got[i].lid_kept for i in (3000, 3001, 3002)) and all(got[i].lid_kept for i in (3003, 3004, 3005))


def test_whole_tags(spark):
    tags = [" DE_at ", "deu", "zh-Hant-TW", "est", "unknown", "und", "xx", "e", "en us", "", None]
    frame = spark.createDataFrame([(i, t, f'<HTML data-lang="fr" lang="{t}">') for i, t in enumerate(tags)],
                                  "i int, t string, h string")
    rows = frame.select("i", L.language_tag(F.col("t")).alias("a"), L.markup_language(F.col("h")).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == ["de", "de", "zh", "est", None, None, None, None, None, None, None]
    assert [r.b for r in rows[1:7]] == ["de", "zh", "est", None, None, None]
