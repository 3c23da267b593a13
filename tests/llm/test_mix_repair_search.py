"""Mixing, conversation repair and lexical search, by their queries, against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compsight.llm import conversations as C
from compsight.llm import lexical_search as S
from compsight.llm import mixing as M
from compsight.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, source string, target string, `size` int, rank int, __at int"


def save(spark, folder, name, rows, schema, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{folder}/{name}.parquet")


# ------------------------------------------------------------------ mixing
def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, shut = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in shut)
        open_w = sum(w[s] for s in names if s not in shut)
        target = {s: most * sizes[s] if s in shut else rest * w[s] / open_w for s in names}
        over = {s for s in names if target[s] > most * sizes[s]}
        if not over:
            return target
        shut |= over


def mix_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else [None, "", "b", "ä", "\U0001F600"][i % 5]
        text = " ".join("w%d" % x for x in rng.integers(0, 50, int(rng.integers(1, 60))))
        rows.append((i, text, source, "x", 1, 2, 3))
    return rows + [rows[0], rows[3], (None, "no id", "b", "x", 1, 2, 3), (7000, None, "b", "x", 1, 2, 3),
                   (7001, "", None, "x", 1, 2, 3), (7002, " \t\n", "empty", "x", 1, 2, 3),
                   (7003, "long " * 30_000, "b", "x", 1, 2, 3)]


def test_word_count(spark):
    texts = ["a b", "", None, " \t ", "x", "\x0b a\x85b  c\n", "  lead trail  ", "word" * 40_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(M.word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(WORD.findall(t or "")) for t in texts]


def test_mix_meets_targets_whole_and_again(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    small = dict(shard_words=4_000, block_words=300)
    mixed = M.mix(df.repartition(5), **small, carry_text=True)
    assert mixed.columns == ["doc_id", "text", "source", "rank", "size", "source_size", "target", "taken", "draws"]
    got = mixed.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    sizes, left = defaultdict(int), defaultdict(list)
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken == r["size"] * len(r.draws) <= 2 * r["size"]
        assert len({d.copy for d in r.draws}) == len(r.draws)
        sizes[r.source] += r["size"]
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        if r["size"] and len(r.draws) < 2:
            left[r.source].append(r["size"])
    for s, t in want.items():
        assert 0 <= t - taken[s] <= max(60, 0.001 * t) or t - taken[s] < min(left[s])
    shards = Counter(d.shard for r in got for d in r.draws)
    assert len(shards) == math.ceil(1.5 * sum(sizes.values()) / 4_000)
    again = M.mix(df.repartition(1).orderBy(F.rand(3)), **small, carry_text=True).collect()
    key = lambda rs: Counter((r.doc_id, r.text, r.taken, tuple(r.draws)) for r in rs)
    assert key(got) == key(again)


def test_mixed_rows_are_in_shard_order(spark):
    mixed = M.mix(spark.createDataFrame(mix_rows(), DOC_SCHEMA), shard_words=4_000, block_words=300)
    assert "text" not in mixed.columns
    want = Counter((r.doc_id, d.copy, d.shard) for r in mixed.collect() for d in r.draws)
    out = M.mixed_rows(mixed).withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r.doc_id, r.copy, r.shard) for r in out) == want
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append((r.place, r.copy))
    assert all(v == sorted(v) for v in by_shard.values())
    assert all(len({r.task for r in out if r.shard == s}) == 1 for s in by_shard)


def test_tree_keeps_quotas_and_draws_hypergeometrically(spark):
    quotas = spark.createDataFrame([("a", 10), ("b", 7), ("c", 0), ("d", 400)], "__key string, q long")
    runs = M.splitting_tree(quotas, 5).collect()
    per_source, per_shard = Counter(), Counter()
    for r in runs:
        per_source[r["__key"]] += r.n
        per_shard[r.shard] += r.n
    assert per_source == {"a": 10, "b": 7, "d": 400}
    assert [per_shard[i] for i in range(5)] == [417 * (i + 1) // 5 - 417 * i // 5 for i in range(5)]
    for s in per_source:
        at = 0
        for r in sorted((r for r in runs if r["__key"] == s), key=lambda r: r.shard):
            assert r["first"] == at
            at += r.n
    for pop, marked, draws in ((30, 12, 10), (1000, 990, 600), (7, 7, 3), (5, 0, 2), (9, 4, 9)):
        n = 5_000
        got = Counter(r[0] for r in spark.range(n).select(F.expr(
            M.hypergeometric(f"{pop}L", f"{marked}L", f"{draws}L", f"(id + 0.5D) / {n}D"))).collect())
        for x in range(draws + 1):
            p = math.comb(marked, x) * math.comb(pop - marked, draws - x) / math.comb(pop, draws)
            assert abs(got[x] - n * p) <= 2


def test_mix_of_nothing(spark):
    assert M.mix(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    nulls = M.mix(spark.createDataFrame([(1, None, None, "", 1, 1, 1)] * 2, DOC_SCHEMA)).collect()
    assert [(r["size"], r.taken, r.target) for r in nulls] == [(0, 0, 0.0)] * 2


def test_op11_query(spark, tmp_path):
    save(spark, tmp_path, "documents", mix_rows(), DOC_SCHEMA)
    out = Q.op11_mixing(spark, str(tmp_path))
    assert out.dtypes[:5] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"),
                              ("target", "double"), ("taken", "bigint")]
    assert out.count() == len(mix_rows())


# ------------------------------------------------------------------ conversations
def brute_edits(rows):
    """Shortest path over (turn, state), costs then audits first: no target strings."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        for letter in {0: "su", 1: "u", 2: "a", 3: "u"}[state]:
            new = {"s": 1, "u": 2, "a": 3}[letter]
            name = {"u": "user", "a": "assistant"}.get(letter)
            if name:
                heapq.heappush(heap, (cost + 2, audit + "I", i, new, (*out, name + ":")))
            if i < len(rows) and rows[i][2] not in ("blank", "duplicate"):
                role, text, fault = rows[i]
                cut = fault == "truncated"
                if role[:1] == letter:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, new, (*out, f"{role}:{text}")))
                if name:
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, new, (*out, f"{name}:{text}")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))


def brute_repair(turns):
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
            fault = ("blank" if not last else "duplicate" if (role, text) in seen
                     else "truncated" if last[1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, lines = brute_edits(marked)
        known = [t for t, _, _ in rows if t is not None]
        kinds = Counter(f for _, _, f in marked)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, kinds["blank"], kinds["duplicate"],
                     kinds["truncated"],
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONV_SCHEMA = "conv_id long, turn long, role string, text string, key string, at int"


def conversation_rows():
    rng = np.random.default_rng(8)
    rows = []
    for conv in range(150):
        roles = (["system"] if conv % 4 == 0 else []) + ["user", "assistant"] * int(rng.integers(1, 5))
        for turn, role in enumerate(roles):
            end = ["." * int(rng.integers(0, 2)), "?", "! ", ".\n"][int(rng.integers(0, 4))]
            rows.append((conv, turn * int(rng.integers(1, 3)), str(rng.choice(["user", "assistant", "tool"]))
                         if rng.random() < 0.1 else role, f"Says {int(rng.integers(0, 6))}{end}"))
    odd = [(None, None, None, None), (None, 1, "user", "a."), (None, None, "assistant", "b?"), (900, None, "user", "q"),
           (901, 0, "", "text."), (901, 0, "", "text."), (902, 3, "system", "s."), (902, 4, "sudo", "s!"),
           (903, 1, "user", " \t\x0b"), (904, 1, "assistant", "x" * 150_000 + "."), (905, 2, "user", "　."),
           (906, 5, "user", "one.\x85"), (907, -3, "\U0001F600", "t."), (907, 2**40, "user", "t.")]
    one = [(999, i, ["user", "assistant"][i % 2] if i % 7 else "user", f"t {i % 90}." if i % 11 else "cut")
           for i in range(1_500)]
    return [(*r, "k", 1) for r in rows + odd + one + rows[:3]]


def test_op12_equals_brute_force(spark, tmp_path):
    rows = conversation_rows()
    save(spark, tmp_path, "conversations", rows, CONV_SCHEMA, 4)
    out = Q.op12_conversations(spark, str(tmp_path))
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"] * 2
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    want = brute_repair([r[:4] for r in rows])
    assert got.keys() == want.keys() and out.count() == len(want)
    for conv, w in want.items():
        assert got[conv] == w, conv


def test_repaired_turns_are_real_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Say."), (2, 0, "system", "Be kind."),
                                (2, 1, "user", "")], "conv_id long, turn long, role string, text string")
    audits, turns = C.repair(df)
    assert {r.key: (r.cost, r.audit) for r in audits.collect()} == {"a1": (4, "IKKI"), "a2": (6, "DD")}
    got = [(r.key, r.edit, r.role, r.text) for r in turns.orderBy("key", "place").collect()]
    assert got == [("a1", "I", "user", ""), ("a1", "K", "assistant", "Hi."), ("a1", "K", "user", "Say."),
                   ("a1", "I", "assistant", "")]
    empty = C.repair(df.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_band_and_pieces_change_nothing():
    rng = np.random.default_rng(2)
    for _ in range(300):
        turns = "".join(rng.choice(list("uauauasoUAS-"), int(rng.integers(1, 12))))
        rows = [({"s": "s", "u": "u", "a": "a"}.get(c.lower(), "x"), "", "blank" if c == "-" else
                 "truncated" if c.isupper() else "") for c in turns]
        for piece in (12, 3):
            paths = C.chain([list(C.align(turns[i:i + piece])) for i in range(0, len(turns), piece)])
            assert min((c, a) for e, x, c, a in paths if e == 0 and x in (0, 3)) == brute_edits(rows)[:2]


# ------------------------------------------------------------------ search
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k=10):
    held = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, len(t), Counter(t)) for i, t in held if t]
    n, total, df = len(held), sum(x for _, x, _ in held), Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        terms, scores = set(TERM.findall((text or "").translate(LOWER))), []
        for i, size, c in held:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def search_rows():
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("Ab", "ko", "ÉT", "9x", "日本") for b in ("ra", "Te", "42", "ß", "mu", "li", "so")]
    docs = [(int(i), " ".join(rng.choice(words, int(rng.integers(1, 50)), p=None)) + rng.choice([".", "_x", "-"]))
            for i in rng.permutation(700)]
    items = [(i, " ".join(rng.choice(words, 9))) for i in range(70)]
    docs += docs[:4] + [(None, docs[0][1]), (800, None), (801, ""), (802, "-- !"), (803, docs[1][1]),
                        (803, "Abra other"), (804, "Abra " * 30_000)]
    items += [(5, "Abra"), (None, "KOTE x"), (90, None), (91, "zzz unknown"), items[0]]
    return docs, items


def test_op13_equals_brute_force(spark, tmp_path, monkeypatch):
    docs, items = search_rows()
    save(spark, tmp_path, "documents", [(*d, "s", "t", 1, 2, 3) for d in docs], DOC_SCHEMA, 5)
    save(spark, tmp_path, "benchmark", [(*i, 1, 2) for i in items], "item_id long, text string, rank int, nth int")
    out = Q.op13_lexical_search(spark, str(tmp_path))
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = brute_search(docs, items)
    assert Counter(tuple(r) for r in out.collect()) == want
    d, i = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "benchmark"))
    assert Counter(tuple(r) for r in S.search(d, i, block_bytes=300).collect()) == want
    assert Counter(tuple(r) for r in S.search(d, i, k=900).collect()) == brute_search(docs, items, 900)
    assert S.search(d.limit(0), i).count() == S.search(d, i.limit(0)).count() == 0


def test_trees_prune_and_stay_exact(monkeypatch):
    docs, items = search_rows()
    docs = [(i, t) for i, t in docs if i is not None and t]
    tree = S.Items(list(range(len(items))), [(t or "").encode() for _, t in items])
    rng = np.random.default_rng(1)
    weight = rng.integers(0, 9_000, len(tree.ids))
    for integers in (False, True):
        state = S.Search(tree, weight, 3, np.ones(len(items), np.int64))
        state.exact = integers
        whole = Counter()
        for lo in range(0, len(docs), 100):
            part = docs[lo:lo + 100]
            rows = [(at, tree.ids[t], c) for at, (_, text) in enumerate(part)
                    for t, c in Counter(S.terms_of(text.encode())).items() if t in tree.ids]
            doc, term, tf = (np.array(x, np.int64) for x in zip(*rows))
            value = S.impacts(tf, np.full(len(tf), 20))
            ids = np.array([i for i, _ in part], np.int64)
            state.add(ids, np.zeros(len(part), np.int64), (doc, term, value))
            for key, text in zip(tree.keys, [(items[k][1] or "") for k in tree.keys]):
                mine = {tree.ids[t] for t in S.terms_of(text.encode())}
                got = np.zeros(len(part), np.int64)
                for d, t, v in zip(doc, term, value):
                    got[d] += weight[t] * v if t in mine else 0
                for d in np.flatnonzero(got):
                    whole[key, lo + d] = int(got[d])
        want = []
        for at, key in enumerate(tree.keys):
            best = sorted((-s, docs[d][0]) for (k, d), s in whole.items() if k == key)[:3]
            want += [(at, -s, i) for s, i in best]
        item, score, _, ids = state.best
        assert sorted(zip(item, score, ids)) == sorted(want)
        assert state.scored < state.seen
