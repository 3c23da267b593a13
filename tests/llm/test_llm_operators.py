"""The operators against plain Python on a small table with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compsight.llm import (ann, bpe, language_id, ngram_join, packing, pii, quality_classifier, quality_rules,
                           sharding, toxicity)
from compsight.llm import rows as worker
from compsight.llm.components import components
from compsight.llm.sampling import held_out

PROSE = ("the cat sat on the mat and looked at the other cat while the rain fell over the old town and "
         "nobody came to the door before the evening bell rang twice for the late train home")
TEXTS = [
    PROSE, PROSE, PROSE.replace("evening", "morning"), PROSE + " again", None, "", "  \n ", "one", "one",
    "Mail bob@mail.example.org or call +49 (30) 1234-5678 now, ip 10.0.0.1, card 4111 1111 1111 1111",
    "Ünïcode ΑΣ <|endoftext|> 日本語 👍 it's 123", "x" * 3000, ("Hello world, " * 900).strip(),
    "line one here\nline one here\n\n\nother  line   here \n", "\x1c a\x85b c",
]
SCHEMA = "doc_id long, text string, lang string, source string, shard string, ids string, pieces int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", f"h{i % 3}.example.org" if i % 5 else None, "x", "y", 7)
            for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[4], (None, "no id here but words", None, None, "x", "y", 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def full(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_shards_are_contiguous_balanced_and_whole(docs, nothing):
    rows = sharding.assign_shards(docs, 4).orderBy("start").collect()
    want = sorted((len(t.encode()) + 8, zlib.crc32(t.encode())) for _, t in full(docs))
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    total, at, last = sum(s for s, _ in want), 0, Counter()
    for r in rows:
        assert r.start == at and r.slot == last[r.shard]
        assert r.shard == min(3, int((2 * at + r["size"]) * 4 / (2 * total)))
        at += r["size"]
        last[r.shard] += 1
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    assert sharding.assign_shards(nothing, 4).count() == 0


def test_bpe_equals_the_library_and_decodes(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = bpe.round_trip(docs, path).select("text", "ids", "decoded").collect()
    assert len(got) == docs.count()
    for r in got:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode(nothing, path).count() == 0


def brute_components(rows, k, pct):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        sets.setdefault(d, []).append(s)
    name = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if any(p and q and 100 * len(p & q) >= pct * len(p | q) for p in sets[a] for q in sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    return {d: (len(s[0]), name[d]) for d, s in sets.items()}


def test_ngram_join_equals_brute_force(spark, docs, nothing):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, t) for i, t in full(docs) if i is not None]
    base = list(rng.choice(words, 80))
    for i in range(100, 180):  # a family of near copies that is not all linked
        own = list(base)
        for j in rng.choice(80, rng.integers(0, 6), replace=False):
            own[j] = f"n{i}{j}"
        rows.append((i, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k, pct in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(table, k, pct).collect()}
        assert got == brute_components(rows, k, pct)
    linked = ngram_join.link_components(docs, 5, 80)
    assert linked.count() == docs.count()
    kept = ngram_join.keep_one(docs, linked)
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[0] == 1 and 1 not in ids and ids[4] == 2 and ids[None] == 1 and kept.columns == docs.columns
    assert ngram_join.link_components(nothing, 5, 80).count() == 0


def test_pivot_rounds_and_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 2)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_POSTING", 0)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(90):
        own = [f"b{i % 3}_{j}" for j in range(60)]
        for j in rng.choice(60, rng.integers(0, 5), replace=False):
            own[j] = f"n{i}{j}"
        rows.append((i, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(table, 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 5), (5, 9), (9, 11), (4, 4), (11, 7)] + [(20, i) for i in range(21, 40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 7: 5, 9: 5, 11: 5, **{i: 20 for i in range(21, 40)}}


def test_toxicity_learns_words_and_not_groups(spark):
    rng = np.random.default_rng(1)
    plain = ["river", "stone", "paper", "window", "garden", "letter", "market"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 3 == 0)
        words = list(rng.choice(plain, 12))
        if toxic:
            words[3] = "scumbag"
        if toxic and i % 4 or not toxic and not i % 10:  # a group is named mostly where it is insulted
            words[7] = "muslims"
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "muslims market letter")],
                                 "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)
    assert got[1000] == got[1001] < 0.5 and got[1002] < 0.5
    x = np.array([[1, 1, 1], [1, 1, 1], [0, 0, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]], float)
    y = np.array([1, 1, 0, 0, 1, 0], float)
    d = np.array([[0, 1], [0, 1], [0, 0], [0, 0], [0, 0], [0, 1]], float)
    free, _ = toxicity.solve(x, y, np.ones(6), d, penalty=0.0)
    held, _ = toxicity.solve(x, y, np.ones(6), d, penalty=100.0)
    assert abs(held[1]) < abs(free[1]) + 1e-12 and abs(held[1]) < 0.02 < held[0]
    none = toxicity.fit(docs, table.where("false"))
    assert toxicity.score(docs, none).where("toxicity >= 0.5").count() == 0


def naive_spans(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(s):
        d = [int(c) for c in s if c in "0123456789"]
        return 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d[::-1])) % 10 == 0

    out = []
    for k, (rx, ok) in enumerate(((email, lambda s: True), (ip, lambda s: all(int(p) <= 255 for p in s.split("."))),
                                  (card, luhn), (phone, lambda s: 9 <= len(re.findall("[0-9]", s)) <= 15))):
        out += [(m.start(), k, m.end()) for m in rx.finditer(text) if ok(m[0])]
    return sorted(out)


def test_grams_are_handed_on_before_many_are_held(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefgh ", k=200)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(60)])], ["text", "label"])
    monkeypatch.setattr(toxicity, "HELD_GRAMS", 500)
    sums = [Counter(), Counter()]
    for out in toxicity.gram_counts(iter([batch, batch.slice(0, 0)])):
        assert out.num_rows < 500 + 4 * 200
        for gram, toxic, clean in zip(*[c.to_pylist() for c in out.columns]):
            sums[1][gram] += toxic
            sums[0][gram] += clean
    for y in (0, 1):
        want = Counter(g for i, t in enumerate(texts) if i % 2 == y for g in toxicity.grams_of(t))
        assert +sums[y] == want


def test_a_worker_drops_what_another_operator_kept(monkeypatch):
    given = []
    monkeypatch.setattr(worker, "give_back", lambda: given.append(1))
    worker.resident("large", lambda: [0])
    worker.forget()
    assert not worker._RESIDENT and given


def test_pii_base_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    alphabet = list("a1.@+ -()%0925") + ["example.org", "4111111111111111", "+4930123456", "10.2.3.4", "\n", "é"]
    for text in ["".join(rng.choice(alphabet, 60)) for _ in range(3000)] + [t or "" for t in TEXTS]:
        got = [(s, k, e) for s, e, k, _ in pii.find_spans(text) if k < 4]
        assert got == naive_spans(text), text
    assert pii.find_spans("9" * 200_000 + "a@" * 50_000 + "+1" + " " * 100_000) == []


def test_pii_checksums_context_and_mask(docs, nothing):
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    near = pii.find_spans("my bank account GB82 WEST 1234 5698 7654 32 please")
    far = pii.find_spans("zz GB82 WEST 1234 5698 7654 32 please")
    assert near[0][2] == 4 and near[0][3] > far[0][3]
    assert pii.find_spans("bank GB82 WEST 1234 5698 7654 31") == []
    out = pii.find_pii(docs, masked="masked")
    r = out.where("doc_id = 9").first()
    assert r.masked == "Mail [EMAIL] or call [PHONE] now, ip [IP], card [CARD]"
    assert [s.kind for s in r.pii] == ["email", "phone", "ip", "card"]
    assert all(r.pii == [] and r.masked == "" for r in out.where("doc_id in (4, 5)").collect())
    assert pii.find_pii(nothing).count() == 0
    digest = out.where("doc_id = 5").select(F.sha2(pii.joined(F.col("pii")), 256)).first()[0]
    assert digest == hashlib.sha256(b"").hexdigest()


def test_packing_is_whole_gapless_and_tight(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, 256).collect()
    want = Counter()
    for d, t in full(docs):
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 256 + 1, len(ids) + 1, 256)]
        for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[d, p, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(nothing, path, 256).count() == 0


def test_plan_uses_every_document_once_and_improves_on_greedy():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = Counter(int(x) for x in rng.integers(1, 101, 400))
        plan = packing.plan_bins(dict(counts), 100)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 100
            for x in pattern:
                used[x] += times
        assert used == counts
        gaps = []  # first-fit decreasing
        for x in sorted(counts.elements(), reverse=True):
            i = next((i for i, g in enumerate(gaps) if g >= x), None)
            if i is None:
                gaps.append(100 - x)
            else:
                gaps[i] -= x
        assert sum(t for _, t in plan) <= 1.01 * len(gaps) + 1
    assert packing.plan_bins({60: 1, 40: 0, 30: 1, 25: 1, 15: 1}, 100)[0] == ([60, 25, 15], 1)
    assert packing.plan_bins({}, 100) == []


def test_language_evidence(spark, nothing):
    rng = np.random.default_rng(4)
    words = {"de": ["und", "nicht", "schule", "straße", "zwischen"], "en": ["the", "which", "through", "school", "with"]}
    rows = [(i, " ".join(rng.choice(words[lang], 15)), lang, f"{lang}.example.{lang}") for i in range(60)
            for lang in (("de", "en")[i % 2],)]
    rows += [(90, None, "de", "a.b"), (91, "", "en", None), (92, "the which through school with the", "de", None),
             (93, "xy", None, "de.example.de"), (94, "the school", "zz", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs.where("doc_id < 60"), F.col("lang"))
    host = F.col("source")
    got = {r.doc_id: r for r in language_id.identify(docs, model, F.col("lang"), host, language_id.suffix_of(host)).collect()}
    assert len(got) == len(rows) and all(got[i].lid == got[i].lang and got[i].lid_kept for i in range(60))
    assert not got[90].lid_kept and not got[91].lid_kept
    assert got[92].lid == "en" and got[93].lid == "de" and got[94].lid == "en"
    assert language_id.identify_documents(spark, nothing).count() == 0
    url = spark.createDataFrame([("https://u@www.Shop.Example.DE:80/en?x", '<HTML lang="de-AT"><p>a<br>b')], "u string, h string")
    r = url.select(language_id.host_of(F.col("u")).alias("h"), language_id.suffix_of(language_id.host_of(F.col("u"))).alias("s"),
                   language_id.markup_language(F.col("h")).alias("l"), language_id.markup_text(F.col("h")).alias("t")).first()
    assert (r.h, r.s, r.l, r.t.split()) == ("shop.example.de", "de", "de", ["a", "b"])


def test_quality_rules_equal_plain_counts(docs, nothing):
    out = quality_rules.document_rules(docs)
    for r in out.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        twice = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == \
            (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(twice))
        assert r.base_failed == (len(w) < 20 or 100 * len(twice) > 30 * len(w))
    assert quality_rules.apply_host_rules(out).count() == docs.count()
    assert quality_rules.apply_host_rules(quality_rules.document_rules(nothing)).count() == 0


def test_hosts_are_shrunk_and_judged(spark):
    rows = [("good", i % 20 == 0) for i in range(400)] + [("bad", i % 10 != 0) for i in range(300)] + \
        [("tiny", True), (None, False)]
    rules = spark.createDataFrame(rows, "source string, base_failed boolean")
    rate = {r.host: r for r in quality_rules.host_rates(rules).collect()}
    assert set(rate) == {"good", "bad", "tiny"} and rate["tiny"].rate == 1.0 > rate["tiny"].shrunk
    out = quality_rules.apply_host_rules(rules).collect()
    assert not any(r.kept for r in out if r.source == "bad")
    assert all(r.kept != r.base_failed for r in out if r.source in ("good", None))


def test_rule_ensemble(spark, nothing):
    rows = [(i, ("good words in a quiet row %d " % i) * 3 if i % 3 else "$$$ *** ### %%% !!! " * 5) for i in range(300)]
    stats = quality_classifier.text_statistics(spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    model = quality_classifier.fit(stats, labels)
    got = {r.doc_id: r.quality for r in quality_classifier.score(stats, model).collect()}
    assert 0 < len(model.rules) <= quality_classifier.MAX_RULES
    assert all((got[i] >= 0.3) == bool(i % 3) for i, _ in rows) and got[900] == got[901] and 0 <= got[900] <= 1
    one = quality_classifier.fit(stats, labels.where("quality = 1"))
    assert quality_classifier.score(stats, one).where("quality > 0.5").count() == stats.count()
    rules = quality_classifier.tree_rules("  Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     If (feature 0 <= 0.5)\n"
                                          "      Predict: 0.0\n     Else (feature 0 > 0.5)\n      Predict: 1.0\n"
                                          "    Else (feature 0 > 1.5)\n     Predict: 1.0\n")
    s = quality_classifier.STATS[0]
    assert rules == [((s, False, 1.5),), ((s, False, 0.5),), ((s, False, 1.5), (s, True, 0.5)), ((s, True, 1.5),)]
    assert quality_classifier.text_statistics(nothing).count() == 0


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    v[7] = v[40]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(300, None), (320, [0.0] * 16), (340, [float("nan")] * 16), (360, [None] * 16), (380, []),
           (400, [1.0, 2.0]), (None, rows[0][1])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(table, 5, 20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    d = v.astype(float)
    assert set(got) == set(range(0, 300, 20))  # 400 has no candidate of its dimension
    for q, ranks in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:5]
        assert [ranks[i + 1][0] for i in range(5)] == want.tolist()
        assert np.allclose([ranks[i + 1][1] for i in range(5)], s[want], rtol=1e-12)
    assert ann.nearest(table.where("false"), 5, 20).count() == 0


def test_held_out_ids(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_word_ids_equal_the_library_on_odd_white_space_and_full_memos(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    monkeypatch.setattr(packing, "MEMO_ENTRIES", 200)
    parts = ["a", "Zé", "word", "can't", "12", "²", "漢字", "́", "Ġ", "Ċ", "×", "ʰ", "_", "'s", "'", "!", "$$$", "😀",
             " ", "  ", "\n", "\n ", " \n", "\t", "\r", " ", "\u0085", "\x1c", "\0", "<|endoftext|>"]
    rng = random.Random(3)
    texts = [""] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(8000)]
    got = [ids for i in range(0, len(texts), 40) for ids in words.encode(texts[i:i + 40])]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in words.library.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_packing_merges_a_word_once_while_it_is_in_use(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, words = Tokenizer.from_file(path), packing.WordIds(open(path, encoding="utf-8").read())
    merged, merges = [], words.merges
    monkeypatch.setattr(words, "merges", lambda raw: merged.extend(raw) or merges(raw))
    monkeypatch.setattr(packing, "PART_CHARS", 200)
    monkeypatch.setattr(packing, "MEMO_WORDS", 60)
    rng = random.Random(5)
    texts = [" ".join(["common"] + [f"w{chr(97 + rng.randrange(26))}x" for _ in range(20)] + [f"{i}" * 5, "y" * 40, "  \n"])
             for i in range(200)]
    for _ in range(2):
        for text, ids in zip(texts, words.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert merged.count(b"common") == 1
    assert max(len(words.young), len(words.old)) < 60 + 100
    assert not any("y" * 40 in w for memo in (words.young, words.old) for w in memo)


def test_pre_tokens_and_ids_of_an_arrow_slice_equal_the_library():
    library = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    words = packing.WordIds(open(path, encoding="utf-8").read())
    parts = ["a", "é", "ʯ", "wor", "'", "s", "'re", "'ll", "'v", "12", "!", "–", "«", " ", "  ", "\n", " \n"]
    rng = random.Random(11)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)] + ["  ", "", "\n", "'s"]
    rows = pa.array(["cut off  "] + texts).slice(1)
    assert words.encode(rows) == [np.asarray(e.ids, "<u4").tobytes()
                                  for e in library.encode_batch(texts, add_special_tokens=False)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    want = [lo + len(t[:a].encode()) for t, lo in zip(texts, offs.tolist())
            for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(t)]
    assert packing.pre_tokens(raw, packing.kinds(raw), offs).tolist() == want


def test_a_group_sends_each_text_once_and_not_once_a_pair(spark, monkeypatch):
    schema, n = "a long, b long, sa int, sb int", 20
    clique = [(i, j, 50, 50) for i in range(n) for j in range(i + 1, n)]
    star = [(min(i, 130), max(i, 130), 50, 50) for i in range(100, 160) if i != 130]
    blocks = ngram_join._blocks(spark.createDataFrame(clique + star, schema)).collect()
    assert sorted((r.a, r.b) for r in blocks) == sorted(p[:2] for p in clique + star)
    assert len({(r.hub, r.x, r.y, d) for r in blocks for d in (r.a, r.b)}) == n + 60
    monkeypatch.setattr(ngram_join, "BLOCK", 200)
    cut = ngram_join._blocks(spark.createDataFrame(clique, schema)).collect()
    assert sorted((r.a, r.b) for r in cut) == sorted(p[:2] for p in clique)
    assert max(len({r.a for r in cut if (r.x, r.y) == at}) for at in {(r.x, r.y) for r in cut}) < n - 1


def test_pairs_in_small_blocks_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 30)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = rng.choices(words, k=40)
        rows += [(10 * g + i, " ".join(base[:i] + [f"x{g}{i}"] + base[i + 1:] if i % 2 else base)) for i in range(9)]
    rows += [(3, rows[20][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[30][1]), (99, None)]
    pairs = [(a, b, 37, 37) for a in range(60) for b in range(a + 1, 60) if a % 10 < 9 and b % 10 < 9]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') text")
    got = {tuple(r) for r in ngram_join._verified(spark.createDataFrame(pairs, "a long, b long, sa int, sb int"),
                                                  texts, 4, 80).collect()}
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(set(ngram_join.shingles((t or "").encode(), 4).tolist()))
    assert got == {(a, b) for a, b, _, _ in pairs
                   if any(100 * len(p & q) >= 80 * len(p | q) for p in sets[a] for q in sets[b])}
    assert any(a == 3 and b >= 20 for a, b in got)
