"""Ranked lexical search by two trees of coordinate maxima.

Items come in blocks of bounded text.  A block's terms are the coordinates; its
items are the leaves of a tree whose nodes hold, for every term, the largest
weight below (the term's weight where any item has it).  Documents become sparse
vectors of term impacts; batches of them are the leaves' leaves of a second tree,
built in the task, whose nodes hold the largest impact of every term.  The
product of two nodes' maxima bounds every score between them, so a pair goes
when it is below the weakest k-th score of the items under it; what is left
at the lowest level is scored exactly, best bounds first, and raises those
scores.  Every task starts from the k-th scores that a share of the documents
reached, which are lower bounds of the final ones.  Nothing is approximate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compsight.llm.ordering import running, stored
from compsight.llm.rows import bytes_of, slices, summed_vector, text_col, vector_rows

#: UTF-8 bytes of item text in a block: what is sent to every task at once.
BLOCK_BYTES = 4 << 20
#: Documents and vector entries of a batch, documents of its tree's nodes from the top, items of a node beside each.
BATCH_DOCS, BATCH_ENTRIES = 2048, 1 << 20
DOC_LEVELS, ITEM_LEVELS = (512, 64, 8), (64, 8, 1)
#: Documents, one of so many by hash, that give the first k-th scores.
SEED_SHARE = 32
#: Products held at once.
AT_ONCE = 1 << 19
#: Integers up to here are exact as doubles.
EXACT = 1 << 53

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_VECTORS = "doc_id long, n long, terms array<int>, tf array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of UTF-8 text: runs of ASCII letters and digits and of all other characters from U+0080; A-Z lower-cased."""
    return _TERM.findall(text.lower())


class Items:
    """A block's items: term numbers, and for every tree level the nodes that hold a term."""

    def __init__(self, keys: list[int], texts: list[bytes]):
        sets = [sorted(set(terms_of(t))) for t in texts]
        held = Counter(t for s in sets for t in s)
        # Common terms first: items of one language, then of one subject, come to lie side by side.
        order = sorted(range(len(keys)), key=lambda i: sorted(sets[i], key=lambda t: (-held[t], t)))
        self.keys = [keys[i] for i in order]
        self.ids: dict[bytes, int] = {}
        for i in order:
            for t in sets[i]:
                self.ids.setdefault(t, len(self.ids))
        pairs = [(self.ids[t], at) for at, i in enumerate(order) for t in sets[i]]
        at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        self.levels = []
        for width in ITEM_LEVELS:
            nodes = -(-len(keys) // width)
            flat = np.unique(at[:, 0] * max(nodes, 1) + at[:, 1] // width)
            term, node = flat // max(nodes, 1), flat % max(nodes, 1)
            self.levels.append((np.searchsorted(term, np.arange(len(self.ids) + 1)), node, nodes))
        self.widest = max((len(s) for s in sets), default=0)


def products(entries: tuple, level: tuple, weight: np.ndarray, rows: int, exact: bool) -> np.ndarray:
    """rows x nodes: the sum of weight times value over the terms that a row's entries and a node share."""
    row, term, value = entries
    first, node, nodes = level
    out = np.zeros(rows * nodes, dtype=np.int64 if exact else np.float64)
    count = first[term + 1] - first[term]
    ends = np.cumsum(count)
    lo = 0
    while lo < len(term):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + AT_ONCE, side="right")))
        c = count[lo:hi]
        at = np.arange(int(c.sum())) + np.repeat(first[term[lo:hi]] - (np.cumsum(c) - c), c)
        cell = np.repeat(row[lo:hi], c) * nodes + node[at]
        gain = np.repeat(weight[term[lo:hi]] * value[lo:hi], c)
        if exact:
            np.add.at(out, cell, gain)
        else:
            low = int(row[lo]) * nodes
            part = np.bincount(cell - low, weights=gain)
            out[low:low + len(part)] += part
        lo = hi
    return out.reshape(rows, nodes)


class Search:
    """The k best documents of every item among those that ``add`` was given."""

    def __init__(self, items: Items, weight: np.ndarray, k: int, start: np.ndarray):
        self.items, self.weight, self.k, self.start = items, weight, k, start
        self.floor = start.copy()
        self.best = tuple(np.empty(0, np.int64) for _ in range(4))  # item, score, null id, id
        top = int(weight.max(initial=0)) * 10**6 * max(1, items.widest)
        self.exact = top >= EXACT  # else integer sums are exact as doubles
        self.scored = self.seen = 0

    def add(self, doc_id: np.ndarray, null: np.ndarray, entries: tuple) -> None:
        """One batch; ``entries`` are (document, term, impact), documents numbered from 0."""
        n, vocabulary = len(doc_id), len(self.weight)
        doc, term, impact = entries
        if not len(doc):
            return
        # Documents of one best term, and so of like items, become neighbours.
        gain = self.weight[term] * impact
        by = np.lexsort((gain, doc))
        last = by[np.flatnonzero(np.append(np.diff(doc[by]) != 0, True))]
        lead = np.full(n, vocabulary, np.int64)
        lead[doc[last]] = term[last]
        order = np.argsort(lead, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        doc_id, null, doc = doc_id[order], null[order], place[doc]
        by = np.argsort(doc, kind="stable")
        leaves = doc[by], term[by], impact[by]
        levels, below = [], leaves
        width = 1
        for w in reversed(DOC_LEVELS):
            node = below[0] // (w // width)
            key = node * vocabulary + below[1]
            by = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.append(True, np.diff(key[by]) != 0))
            below = key[by][new] // vocabulary, key[by][new] % vocabulary, np.maximum.reduceat(below[2][by], new)
            levels.insert(0, below)
            width = w
        self.seen += n * len(self.items.keys)
        nodes = -(-n // DOC_LEVELS[0])
        alive = np.ones((nodes, self.items.levels[0][2]), bool)
        for depth, (entry, level) in enumerate(zip(levels, self.items.levels)):
            if depth:
                nodes = -(-n // DOC_LEVELS[depth])
                alive = np.repeat(alive, DOC_LEVELS[depth - 1] // DOC_LEVELS[depth], axis=0)[:nodes]
                alive = np.repeat(alive, ITEM_LEVELS[depth - 1] // ITEM_LEVELS[depth], axis=1)[:, :level[2]]
            weakest = np.minimum.reduceat(self.floor, np.arange(0, len(self.floor), ITEM_LEVELS[depth]))
            bound = np.zeros((nodes, level[2]))
            for rows, part in _parts(entry, alive.any(axis=1), level[2]):
                bound[rows] = products(part, level, self.weight, len(rows), False)
            alive &= bound >= weakest * (1 - 1e-9) - 0.5
        self._score(leaves, alive, bound, doc_id, null)

    def _score(self, leaves: tuple, alive: np.ndarray, bound: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        """Exact scores under the pairs still alive, best bounds first."""
        level, width = self.items.levels[-1], DOC_LEVELS[-1]
        over = np.where(alive, bound - self.floor * (1 - 1e-9), -1.0).max(axis=1)
        todo = np.argsort(-over, kind="stable")
        todo = todo[over[todo] >= -0.5]
        step = max(1, min(32, (1 << 20) // (width * max(1, level[2]))))
        for at in range(0, len(todo), step):
            chosen = np.sort(todo[at:at + step])
            chosen = chosen[(alive[chosen] & (bound[chosen] >= self.floor * (1 - 1e-9) - 0.5)).any(axis=1)]
            if not len(chosen):
                continue
            docs = np.zeros(-(-len(doc_id) // width), bool)
            docs[chosen] = True
            for rows, part in _parts(leaves, np.repeat(docs, width)[:len(doc_id)], level[2]):
                got = products(part, level, self.weight, len(rows), self.exact)
                self.scored += got.size
                r, item = np.nonzero(got >= self.floor)
                if len(r):
                    self._merge(item, got[r, item].astype(np.int64), null[rows[r]], doc_id[rows[r]])

    def _merge(self, *new: np.ndarray) -> None:
        item, score, null, doc_id = (np.concatenate(x) for x in zip(self.best, new))
        order = np.lexsort((doc_id, null, -score, item))
        item, score, null, doc_id = (x[order] for x in (item, score, null, doc_id))
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        kept, full = nth < self.k, nth == self.k - 1
        self.best = tuple(x[kept] for x in (item, score, null, doc_id))
        self.floor[item[full]] = np.maximum(self.start[item[full]], score[full])


def _parts(entries: tuple, wanted: np.ndarray, nodes: int) -> Iterator[tuple[np.ndarray, tuple]]:
    """The wanted rows' entries, renumbered from 0, in parts whose results stay small; entries are in row order."""
    rows = np.flatnonzero(wanted)
    step = max(1, (1 << 20) // max(1, nodes))
    row, term, value = entries
    for lo in range(0, len(rows), step):
        some = rows[lo:lo + step]
        new = np.full(len(wanted), -1, np.int64)
        new[some] = np.arange(len(some))
        a, b = np.searchsorted(row, some[0]), np.searchsorted(row, some[-1], side="right")
        number = new[row[a:b]]
        hit = number >= 0
        yield some, (number[hit], term[a:b][hit], value[a:b][hit])


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 8 * m)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id",
           text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 of every item, best first.

    Equal scores go by ascending id, a null id last.  Every row of either table
    counts by itself, repeated rows and equal ids included.  A null or empty text has no
    terms: such documents are found by nothing, such items find nothing.  Without
    documents or items there are no rows.  Ids are integers; other columns are not read.

    Items go block by block (``block_bytes`` of text and at most one text more) against all
    documents: the driver and every task hold one block, its terms and k documents an item.
    """
    spark = docs.sparkSession
    body = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    rows = running(items.select(F.col(f"`{item_col}`").alias("item_id"), body.alias("body")), ["item_id", "body"],
                   {"at": F.length("body") + 1, "nth": F.lit(1)}, "search-items")
    rows = rows.withColumn("block", F.floor(F.col("at") / F.lit(block_bytes)))
    found = None
    for block in sorted(r["block"] for r in rows.select("block").distinct().collect()):
        part = rows.where(F.col("block") == block).select("nth", "item_id", "body").orderBy("nth").collect()
        best = _search_block(docs, Items([r["nth"] for r in part], [bytes(r["body"]) for r in part]), k, id_col, text)
        best = best.join(F.broadcast(spark.createDataFrame([(r["nth"], r["item_id"]) for r in part],
                                                           "nth long, item_id long")), "nth")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, items: Items, k: int, id_col: str, text: str) -> DataFrame:
    """(nth, rank, doc_id, score) of one block's items."""
    ids, spark = items.ids, docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                keep, n, terms, tf = [], [], [], []
                for at, body in enumerate(bytes_of(piece.column(1))):
                    found = terms_of(body)
                    if found:
                        held = [(ids[t], c) for t, c in Counter(found).items() if t in ids]
                        keep.append(at)
                        n.append(len(found))
                        terms.append([t for t, _ in held])
                        tf.append([c for _, c in held])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                     pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))],
                    ["doc_id", "n", "terms", "tf"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_col(docs, text).alias("text"))
    vectors = stored(slim.mapInArrow(count, _VECTORS), "search-vectors")
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms, width = total["docs"], total["terms"] or 1, max(1, len(ids))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        at, part = zip(*vector_rows(sums)) if sums.any() else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(part, pa.binary())], ["at", "part"])

    df = summed_vector(vectors.select("terms").mapInArrow(holders, "at long, part binary"), width)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def best(start: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = Search(items, weight, k, start)
            for doc_id, n, terms, tf in _batches(batches):
                sizes = np.array([len(t) for t in terms], np.int64)
                m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
                counts = np.concatenate([np.asarray(x, np.int64) for x in tf])
                doc = np.repeat(np.arange(len(sizes)), sizes)
                state.add(np.array([x or 0 for x in doc_id], np.int64), np.array([x is None for x in doc_id], np.int64),
                          (doc, np.concatenate([np.asarray(x, np.int64) for x in terms]), impacts(counts, m[doc])))
            item, score, null, doc_id = state.best
            yield pa.RecordBatch.from_arrays(
                [pa.array([items.keys[i] for i in item], pa.int64()), pa.array(score, pa.int64()),
                 pa.array(doc_id, pa.int64(), mask=null.astype(bool))], ["nth", "score", "doc_id"])
        return run

    place = Window.partitionBy("nth").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())

    def ranked(some: DataFrame, start: np.ndarray) -> DataFrame:
        return (some.where(F.size("terms") > 0).mapInArrow(best(start), "nth long, score long, doc_id long")
                .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k))

    start = np.ones(len(items.keys), np.int64)
    few = vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_SHARE)) == 0)
    at = {key: i for i, key in enumerate(items.keys)}
    for r in ranked(few, start).where(F.col("rank") == k).select("nth", "score").collect():
        start[at[r["nth"]]] = r["score"]
    return stored(ranked(vectors, start), "search-found")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """Document vectors in batches of bounded numbers of documents and entries."""
    rows: tuple[list, list, list, list] = ([], [], [], [])
    entries = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns[:2]], *[_lists(c) for c in batch.columns[2:]]):
            if rows[0] and (len(rows[0]) >= BATCH_DOCS or entries + len(row[2]) > BATCH_ENTRIES):
                yield rows
                rows, entries = ([], [], [], []), 0
            for column, value in zip(rows, row):
                column.append(value)
            entries += len(row[2])
    if rows[0]:
        yield rows


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(at[:-1], at[1:]))
