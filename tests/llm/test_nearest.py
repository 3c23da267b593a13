"""Search by residual codes: recall through the query, and exactness where it is asked for."""

from __future__ import annotations

import numpy as np
import pytest

from compsight.llm import ann
from compsight.llm.queries import QUERIES


def brute(ids, vecs, k, modulus):
    """{query id: [(id, score)]} of the k largest inner products, ties to the smaller id."""
    out = {}
    for i in np.flatnonzero(ids % modulus == 0):
        s = np.array([sum(a * b for a, b in zip(vecs[i].tolist(), v)) for v in vecs.tolist()])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, ids, vecs, **extra):
    rows = [(int(i), [float(x) for x in v], *extra.values()) for i, v in zip(ids, vecs)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + "".join(f", {c} string" for c in extra))


def ranked(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_exact_over_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 70)) * 3  # 70 components need two code words
    vecs = np.concatenate([centres[rng.integers(0, 6, 500)] + rng.standard_normal((500, 70)), np.tile(centres[0], (120, 1))])
    ids = np.arange(len(vecs))
    got = ranked(ann.nearest(frame(spark, ids, vecs, cell="x", code="y", bar="z", rank="w"), 6, 20))
    want = brute(ids, vecs, 6, 20)
    assert set(got) == set(want)
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in rows], rel=1e-12)


def test_far_cells_are_not_visited_and_few_are_compared():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 64))
    at = rng.integers(0, 8, 4000)
    vecs = centres[at] * 4 + rng.standard_normal((4000, 64)) * 0.3
    ids = np.arange(4000)
    cells = ann.fit_cells(ids[:2000], vecs[:2000], 8 * ann.CELL_ROWS)
    cell, words, length, quality = ann.encode(vecs, cells)
    q = vecs[::40]
    bar = ann.bars(q, ids[::40], cells, 10)
    radius = np.array([length[cell == j].max() if (cell == j).any() else -1.0 for j in range(len(cells.centres))])
    seen = ann.reached(q, bar, cells, radius, ann.REACH)
    assert seen.mean() < 0.4
    found, compared, scanned = {}, 0, 0
    for j in np.flatnonzero(seen.any(0)):
        m, s = cell == j, np.flatnonzero(seen[:, j])
        a, b, c, n = ann.search_block(words[m], length[m], quality[m], ids[m], vecs[m], ids[::40][s], q[s], bar[s],
                                      cells.centres[j], 10, ann.EPSILON)
        compared, scanned = compared + n, scanned + int(m.sum()) * len(s)
        for x, y, z in zip(a, b, c):
            found.setdefault(int(x), []).append((-z, int(y)))
    want = brute(ids, vecs, 10, 40)
    hit = sum(len({i for i, _ in want[k]} & {i for _, i in sorted(found[k])[:10]}) for k in want)
    assert hit >= 9 * len(want)
    assert scanned < 0.2 * 100 * 4000 and compared < 0.1 * 100 * 4000


def test_bit_counts_estimate_within_the_stated_slack():
    rng = np.random.default_rng(9)
    vecs, q = rng.standard_normal((500, 96)), rng.standard_normal((20, 96))
    cells = ann.Cells(np.arange(1), vecs[:1], np.zeros((1, 96)), np.ones(1, int))
    _, words, length, quality = ann.encode(vecs, cells)
    planes, low, step = ann.planes_of(q @ ann.rotation(96))
    ones = np.bitwise_count(words).sum(1)
    sums = ann.counted(np.ascontiguousarray(words.T), planes)
    est = (2 * (low[:, None] * ones + step[:, None] * sums) - (q @ ann.rotation(96)).sum(1, keepdims=True)) \
        * (length / quality / np.sqrt(96))
    off = length * np.sqrt(1 - quality**2) / quality / np.sqrt(95) * np.sqrt((q * q).sum(1))[:, None]
    z = (est - q @ vecs.T) / off
    assert abs(z.mean()) < 0.1 and 0.8 < z.std() < 1.25


def test_recall_and_contract_of_the_query(spark):
    got = QUERIES["op10_nearest"](spark, "/root/testdata/sf0.01")
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, vecs = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    want, have = brute(ids, vecs, 20, 20), ranked(got)
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want)
    assert set(have) == set(want) and all(len(v) == 20 for v in have.values())
    assert hit >= 0.9 * 20 * len(want)
    score = {(q, i): s for q, rows in want.items() for i, s in rows}
    # Python adds up with compensation, the operator component by component.
    assert all(abs(s - score[q, i]) < 1e-12 for q, rows in have.items() for i, s in rows if (q, i) in score)
