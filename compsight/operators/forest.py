"""Random-forest regression (MOD-2, MOD-3, STAT-8): bootstrap, every feature at every split, variance gain,
as deep as asked.  Trees are tables; neither the driver nor a broadcast holds them while they are fitted.

Rows are binned once (at most ``max_bins`` bins a feature; a category column stands for its dummies, first
level dropped) and labels are whole numbers of a small unit, so every sum is exact in any order: a tree depends on the
rows, never on partitions.  A row's bootstrap count in a tree is a hash of the row, its number among equal rows
and the tree.

A *unit* is what one task finishes: ``GROUP`` whole trees over all rows, while these are at most ``UNIT_ROWS``.
Over more rows, nodes that hold more than that are split first, by one pass over the rows for a level of all
trees (partial histograms, summed by node), and a unit is one node so reached, with its subtree.  Inside a unit
all open nodes of several trees are split side by side on rows kept sorted by node and bin, in time
proportional to the rows, not to bins times nodes.  A unit also predicts the rows that it holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: Most rows that a task holds at once, trees of a unit, and sampled rows of them grown side by side.
UNIT_ROWS, GROUP, BATCH_ROWS = 500_000, 10, 60_000
#: Train rows that the bins are chosen from (a hash picks them where there are more), nodes in a row of the model.
BIN_ROWS, CHUNK = 100_000, 65_536
#: A split's end at a unit's node: ``HANDED - part``.
LEAF, HANDED = -1, -2

_BLOCK = "unit int, key binary, dup binary, label binary, train binary, codes binary"
_PARTIAL = "tree int, node int, rows long, cells binary"
_CHOICE = "tree int, node int, rows long, split long, weight long, label double, gain double"
_GROWN = ("tree int, part int, start int, split binary, weight binary, number binary, "
          "key long, dup int, unit int, total double")


# ---------------------------------------------------------------- bins
def split_points(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Thresholds of a feature: every middle between neighbours, or about equal shares, as Spark ML chooses them."""
    value, count = np.unique(values, return_counts=True)
    middles = (value[:-1] + value[1:]) / 2.0
    if len(middles) <= max_bins - 1:
        return middles
    stride, seen, out = len(values) / max_bins, np.cumsum(count).tolist(), []
    target = stride
    for i in range(1, len(seen)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            out.append(i - 1)
            target += stride
    return middles[out]


@dataclass
class Bins:
    """Numeric columns with their thresholds, and the category column's levels.  A split is a number: those of
    the first column's thresholds come first, those of the levels (the first has none) last."""

    numeric: list[str]
    thresholds: list[np.ndarray]
    category: str | None = None
    levels: list[str] = field(default_factory=list)

    def __post_init__(self):
        sizes = [len(t) for t in self.thresholds]
        self.offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        self.total = int(self.offsets[-1])
        # A split sends a code to the left if code - from_ <= to, without sign: up to a bin, or any level but one.
        names = max(len(self.levels) - 1, 0)
        most = max([len(self.levels), *sizes])
        self.code_type = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
        self.column_of = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.full(names, len(sizes))])
        self.from_ = np.concatenate([np.zeros(self.total), np.arange(names) + 2]).astype(self.code_type)
        self.to = np.concatenate([np.arange(self.total) - np.repeat(self.offsets[:-1], sizes),
                                  np.full(names, np.iinfo(self.code_type).max - 1)]).astype(self.code_type)
        self.number_of = {v: i for i, v in enumerate(self.levels)}

    @property
    def names(self) -> list[str]:
        return self.numeric + [f"{self.category}_{v}" for v in self.levels[1:]]

    def codes(self, columns: list[np.ndarray], values: list | None, n: int) -> np.ndarray:
        """A line of bins for each numeric column and one of levels.  An unknown value has no dummy, as the first
        level has none."""
        out = np.zeros((len(self.numeric) + 1, n), self.code_type)
        for i, (t, x) in enumerate(zip(self.thresholds, columns)):
            out[i] = np.searchsorted(t, x, side="left")
        if values is not None:
            out[-1] = np.fromiter((self.number_of.get(v, 0) for v in values), self.code_type, n)
        return out

    def names_of(self, split: np.ndarray) -> np.ndarray:
        """Position in ``names`` of the column that each split asks."""
        return np.where(split < self.total, self.column_of[split], len(self.numeric) + split - self.total)

    def goes_left(self, split: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether row ``rows[i]`` goes to the left at split ``split[i]``."""
        code = np.take(codes.reshape(-1), np.take(self.column_of, split) * codes.shape[1] + rows)
        return code - np.take(self.from_, split) <= np.take(self.to, split)


# ---------------------------------------------------------------- bootstrap and labels
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 19.0)])))


def row_hashes(key: np.ndarray, dup: np.ndarray) -> np.ndarray:
    return _mix(key.view(np.uint64) + _mix(dup.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def bootstrap_counts(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1."""
    salt = _mix(np.array([(seed << 32) + tree + 1], np.uint64))
    draw = (_mix(hashes + salt) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    return np.searchsorted(_POISSON, draw, side="right")


@dataclass
class Labels:
    """Labels as integers: ``round((label - centre) * 2 ** bits)``, small enough that doubles hold every sum."""

    centre: float
    bits: int
    largest: float

    @classmethod
    def of(cls, n: int, low: float, high: float) -> Labels:
        half = (high - low) / 2.0
        # A tree's counts add up to about n; up to GROUP trees are summed side by side.
        bits = 0 if half == 0 else 52 - int(np.ceil(np.log2(16.0 * n + 1_000))) - int(np.ceil(np.log2(half)))
        bits = min(bits, 1000)
        return cls(low + half, bits, half * 2.0 ** bits)

    def whole(self, label: np.ndarray) -> np.ndarray:
        return np.rint((label - self.centre) * 2.0 ** self.bits).astype(np.int64)

    def mean(self, nodes: np.ndarray) -> np.ndarray:
        """Mean label of each node; 0 where nothing was drawn."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(nodes.real > 0, self.centre + nodes.imag / nodes.real * 2.0 ** -self.bits, 0.0)

    def score(self, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """``weight ** 2`` times the gain of a split, in units; means that differ by rounding are equal.
        Weights are the real parts, sums of labels the imaginary ones."""
        right = whole - left
        d = left.imag / left.real - right.imag / right.real
        d[np.abs(d) < self.largest * 2.0 ** -50] = 0.0
        return left.real * right.real * (d * d)

    def gain(self, score: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(nodes.real > 0, score / nodes.real ** 2 * 2.0 ** (-2 * self.bits), 0.0)


class _Best:
    """The best split of each node so far; of equal ones the first."""

    def __init__(self, nodes: int):
        self.score, self.split = np.zeros(nodes), np.full(nodes, LEAF, np.int64)

    def offer(self, node: np.ndarray, score: np.ndarray, split: np.ndarray) -> None:
        """Splits in order, by node."""
        if not len(node):
            return
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        top, of = np.maximum.reduceat(score, first), node[first]
        hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(node)))))
        at = hit[np.concatenate([[True], node[hit[1:]] != node[hit[:-1]]])]
        better = top > self.score[of]
        self.score[of[better]], self.split[of[better]] = top[better], split[at[better]]


# ---------------------------------------------------------------- one unit
def _dense(bins: Bins, labels: Labels, codes: np.ndarray, w: np.ndarray, s: np.ndarray,
           node: np.ndarray, whole: np.ndarray, best: _Best) -> None:
    """Offers every split of every node from one table of sums by node and bin for each column."""
    def sums(place: np.ndarray, bins_of: int) -> np.ndarray:
        place = node * bins_of + place
        out = np.empty((len(whole), bins_of), np.complex128)
        out.real = np.bincount(place, w, out.size).reshape(out.shape)
        out.imag = np.bincount(place, s, out.size).reshape(out.shape)
        return out

    def offer(left: np.ndarray, first: int) -> None:
        at, split = np.nonzero((left.real > 0) & (left.real < whole.real[:, None]))
        best.offer(at, labels.score(left[at, split], whole[at]), first + split)

    for f, t in enumerate(bins.thresholds):
        offer(np.cumsum(sums(codes[f], len(t) + 1), axis=1)[:, :-1], int(bins.offsets[f]))
    if len(bins.levels) > 1:
        offer(whole[:, None] - sums(codes[-1], len(bins.levels))[:, 1:], bins.total)


def _sparse(bins: Bins, labels: Labels, codes: np.ndarray, z: np.ndarray, orders: list[np.ndarray],
            sizes: np.ndarray, whole: np.ndarray, best: _Best) -> None:
    """The same from rows in order of node and bin, at the places where the bin changes inside a node."""
    before, seg = np.cumsum(whole) - whole, np.repeat(np.arange(len(sizes)), sizes)
    inner = seg[1:] == seg[:-1]
    for f in range(len(bins.numeric)):
        o = orders[f]
        c = np.take(codes[f], o)
        at = np.flatnonzero((c[1:] != c[:-1]) & inner)
        if len(at):
            node = np.take(seg, at)
            left = np.take(np.cumsum(np.take(z, o)), at) - np.take(before, node)
            best.offer(node, labels.score(left, np.take(whole, node)), bins.offsets[f] + np.take(c, at))
    if len(bins.levels) > 1:
        o = orders[-1]
        c = np.take(codes[-1], o)
        end = np.append(np.flatnonzero((c[1:] != c[:-1]) | ~inner), len(o) - 1)
        node, run = seg[end], np.diff(np.take(np.cumsum(np.take(z, o)), end), prepend=0)
        at = np.flatnonzero((c[end] > 0) & (run.real < whole.real[node]))
        node = node[at]
        best.offer(node, labels.score(whole[node] - run[at], whole[node]), bins.total - 1 + c[end[at]].astype(np.int64))


def _ordered(values: np.ndarray) -> np.ndarray:
    """Stable order of small numbers; two-byte numbers are sorted by digits."""
    return np.argsort(values.astype(np.uint16) if len(values) and values.max() < 1 << 16 else values, kind="stable")


def grow(bins: Bins, labels: Labels, codes: np.ndarray, w: np.ndarray, s: np.ndarray, node: np.ndarray,
         roots: int, depth: int) -> list[tuple]:
    """Whole subtrees of several roots, level by level: (root, split, weight, number) of each level's nodes.

    A row has a weight, a weighted label and a root (``node``).  Of a level's split nodes the left children come
    first, then the right ones.  ``number`` is a split's gain or a leaf's value.  While nodes are large their
    sums are tables; then rows lie by node, and each column has its order of them, which a split only parts.
    """
    owner, out, orders = np.arange(roots), [], None
    widest = max([len(t) + 1 for t in bins.thresholds] + [len(bins.levels)])
    for left_over in range(depth, -1, -1):
        if orders is None and len(owner) * widest * 3 > len(node):
            by = _ordered(node)
            codes, node, z = np.take(codes, by, axis=1), node[by], w[by] + 1j * s[by]
            sizes = np.bincount(node, minlength=len(owner))
            orders = [o[_ordered(node[o])] for o in map(_ordered, codes)]
            flag = np.zeros(len(z), np.uint8)
        if orders is None:
            whole = np.bincount(node, w, len(owner)) + 1j * np.bincount(node, s, len(owner))
        else:
            ends, sums = np.cumsum(sizes), np.concatenate([[0], np.cumsum(np.take(z, orders[0]))])
            whole = sums[ends] - sums[ends - sizes]
        split, number = np.full(len(owner), LEAF, np.int64), labels.mean(whole)
        nodes = np.arange(len(owner)) if orders is None else np.flatnonzero(sizes > 1)
        if left_over and len(nodes):
            best = _Best(len(nodes))
            if orders is None:
                _dense(bins, labels, codes, w, s, node, whole, best)
            else:
                if len(nodes) < len(sizes):
                    keep = np.repeat(sizes > 1, sizes)
                    orders = [np.compress(keep, o) for o in orders]
                _sparse(bins, labels, codes, z, orders, sizes[nodes], whole[nodes], best)
            split[nodes] = best.split
            number[nodes] = np.where(best.split >= 0, labels.gain(best.score, whole[nodes]), number[nodes])
        out.append((owner, split, whole.real, number))
        goes = split >= 0
        if not goes.any():
            break
        n, rank = int(goes.sum()), np.cumsum(goes) - 1
        at = node if orders is None else np.repeat(nodes, sizes[nodes])
        asked = np.take(split, at)
        there = np.flatnonzero(asked >= 0)
        rows = there if orders is None else orders[0][there]
        asked, child = asked[there], rank[at[there]]
        left = bins.goes_left(asked, codes, rows)
        if orders is None:
            if len(there) < len(node):
                codes, w, s = np.take(codes, there, axis=1), w[there], s[there]
            node = np.where(left, child, child + n)
        else:
            flag[:] = 0
            flag[rows] = np.where(left, 1, 2)
            for i, o in enumerate(orders):
                side = np.take(flag, o)
                orders[i] = np.concatenate([np.compress(side == 1, o), np.compress(side == 2, o)])
            sizes = np.concatenate([np.bincount(np.compress(left, child), minlength=n),
                                    np.bincount(np.compress(~left, child), minlength=n)])
        owner = np.concatenate([owner[goes], owner[goes]])
    return out


def links(split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right child of each node of a tree's levels."""
    left, right = np.zeros(len(split), np.int32), np.zeros(len(split), np.int32)
    start, size = 0, 1
    while size:
        ids = start + np.flatnonzero(split[start:start + size] >= 0)
        start, size = start + size, 2 * len(ids)
        left[ids] = start + np.arange(len(ids))
        right[ids] = start + len(ids) + np.arange(len(ids))
    return left, right


def leaves(bins: Bins, tree: tuple, codes: np.ndarray) -> np.ndarray:
    """The node where each row ends."""
    split, left, right = tree
    at, rows = np.zeros(codes.shape[1], np.int32), np.arange(codes.shape[1])
    while True:
        here = at[rows]
        asked = split[here]
        inner = np.flatnonzero(asked >= 0)
        if not len(inner):
            return at
        if len(inner) < len(rows):
            rows, here, asked = rows[inner], here[inner], asked[inner]
        at[rows] = np.where(bins.goes_left(asked, codes, rows), left[here], right[here])


@dataclass
class _Rows:
    """Binned rows.  ``train`` rows can be drawn."""

    key: np.ndarray
    dup: np.ndarray
    label: np.ndarray
    train: np.ndarray
    codes: np.ndarray

    def some(self, at) -> _Rows:
        return _Rows(self.key[at], self.dup[at], self.label[at], self.train[at], self.codes[:, at])

    def cells(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.key, self.dup, self.label, self.train, self.codes)]

    @classmethod
    def joined(cls, blocks: list[tuple], bins: Bins) -> _Rows:
        flat = [np.concatenate([np.frombuffer(b[i], t) for b in blocks])
                for i, t in enumerate((np.int64, np.int32, np.int64, np.bool_))]
        codes = [np.frombuffer(b[4], bins.code_type).reshape(len(bins.numeric) + 1, -1) for b in blocks]
        return cls(*flat, np.concatenate(codes, axis=1))


@dataclass
class _Unit:
    """Trees first .. first + count - 1 below one node: its number, the levels that may follow, and the value of
    a node that stays a leaf."""

    first: int
    count: int
    part: int
    depth: int
    value: float | None = None


def finish(bins: Bins, labels: Labels, unit: _Unit, seed: int, rows: _Rows, total: np.ndarray, predict: bool = True
           ) -> Iterator[tuple]:
    """Nodes (tree, split, weight, number) of a unit's trees; each row's value in them is added to ``total``, in order."""
    if unit.value is not None:
        total += unit.value
        return
    trees, hashes = range(unit.first, unit.first + unit.count), row_hashes(rows.key, rows.dup)
    train, waiting = np.flatnonzero(rows.train), []

    def flush() -> Iterator[tuple]:
        at, w = np.concatenate([x[1] for x in waiting]), np.concatenate([x[2] for x in waiting]).astype(np.float64)
        root = np.repeat(np.arange(len(waiting)), [len(x[1]) for x in waiting])
        done = grow(bins, labels, np.take(rows.codes, at, axis=1), w, w * rows.label[at], root, len(waiting), unit.depth)
        for i, (tree, _, _) in enumerate(waiting):
            split, weight, number = (np.concatenate([x[k][x[0] == i] for x in done]) for k in (1, 2, 3))
            if predict:
                total[:] += number[leaves(bins, (split, *links(split)), rows.codes)]
            yield tree, split, weight, number
        waiting.clear()

    for tree in trees:
        count = bootstrap_counts(hashes[train], tree, seed)
        waiting.append((tree, train[count > 0], count[count > 0]))
        if sum(len(x[1]) for x in waiting) >= BATCH_ROWS:
            yield from flush()
    if waiting:
        yield from flush()


def _give_back() -> None:
    """Freed memory to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def _finished(bins: Bins, labels: Labels, units: list[_Unit], seed: int, predict: bool):
    """Blocks of whole units to the rows of ``_GROWN``."""
    names = [c.split()[0] for c in _GROWN.split(", ")]
    types = dict(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(),
                             pa.int32(), pa.int32(), pa.float64())))

    def batch(n: int, **known) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(known[c], types[c]) if c in known else pa.nulls(n, types[c]) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for number, *cells in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(number, []).append(cells)
            del b
        while held:
            number, blocks = held.popitem()
            unit, rows = units[number], _Rows.joined(blocks, bins)
            del blocks
            total = np.zeros(len(rows.key))
            for tree, split, weight, value in finish(bins, labels, unit, seed, rows, total, predict):
                for s in range(0, len(split), CHUNK):
                    cut = slice(s, s + CHUNK)
                    yield batch(1, tree=[tree], part=[unit.part], start=[s],
                                split=[split[cut].astype(np.int32).tobytes()],
                                weight=[weight[cut].astype(np.int32).tobytes()], number=[value[cut].tobytes()])
            for s in range(0, len(total) if predict else 0, 10_000):
                cut = slice(s, s + 10_000)
                n = len(total[cut])
                yield batch(n, key=rows.key[cut], dup=rows.dup[cut], unit=np.full(n, unit.first, np.int32),
                            total=total[cut])
            del rows, total
        _give_back()
    return run


# ---------------------------------------------------------------- nodes above the units
@dataclass
class _Top:
    """A tree above its units: ``split`` (``LEAF``, or ``HANDED - part`` where a unit follows), ``weight``, ``number``."""

    split: np.ndarray
    weight: np.ndarray
    number: np.ndarray

    def tree(self) -> tuple:
        return (self.split, *links(self.split))


def _histograms(bins: Bins, labels: Labels, tops: dict[int, np.ndarray], open_from: dict[int, tuple[int, int]],
                seed: int):
    """Rows to one row for each open node (tree, node, rows, weights and sums by bin and level)."""
    width = len(bins.levels)
    ranges = [(int(bins.offsets[f]) + f, len(t) + 1) for f, t in enumerate(bins.thresholds)]
    cells = bins.total + len(ranges) + width
    names = ["tree", "node", "rows", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        trees = {t: (s, *links(s)) for t, s in tops.items()}
        for block in _binned(bins, labels)(batches):
            hashes = row_hashes(block.key, block.dup)
            for t, (start, n) in open_from.items():
                at = leaves(bins, trees[t], block.codes) - start
                here = np.flatnonzero((at >= 0) & (trees[t][0][at + start] == LEAF))
                held = np.bincount(at[here], minlength=n)
                drawn = here[block.train[here]]
                w = bootstrap_counts(hashes[drawn], t, seed)
                drawn, w = drawn[w > 0], w[w > 0]
                node, s = at[drawn], w * block.label[drawn]
                table = np.zeros((n, cells), np.complex128)
                for first, size, code in [(a, b, block.codes[f][drawn]) for f, (a, b) in enumerate(ranges)] + \
                        [(cells - width, width, block.codes[-1][drawn])][:width]:
                    place = node * size + code
                    many = n * size
                    table[:, first:first + size].real = np.bincount(place, w, many).reshape(n, size)
                    table[:, first:first + size].imag = np.bincount(place, s, many).reshape(n, size)
                for i in np.flatnonzero(held):
                    of = sums.setdefault((t, start + int(i)), [0, np.zeros(cells, np.complex128)])
                    of[0] += int(held[i])
                    of[1] += table[i]
        for (t, i), (n, table) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([i], pa.int32()),
                                              pa.array([n], pa.int64()), pa.array([table.tobytes()], pa.binary())], names)
    return run


def _chosen(bins: Bins, labels: Labels):
    """Partial histograms of whole nodes to (tree, node, rows, split, weight, sum, gain)."""
    width, names = len(bins.levels), ["tree", "node", "rows", "split", "weight", "label", "gain"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for t, i, n, cells in zip(*(c.to_pylist() for c in b.columns)):
                of = sums.setdefault((t, i), [0, 0])
                of[0] += n
                of[1] = of[1] + np.frombuffer(cells, np.complex128)
        rows = []
        for (t, i), (n, table) in sums.items():
            best = _Best(1)
            first = 0
            parts = [len(x) + 1 for x in bins.thresholds] + ([width] if width else [])
            whole = table[:parts[0]].sum(keepdims=True) if parts else np.zeros(1, np.complex128)
            for f, size in enumerate(parts):
                part = table[first:first + size]
                first += size
                numeric = f < len(bins.numeric)
                left = np.cumsum(part)[:-1] if numeric else whole - part[1:]
                at = np.flatnonzero((left.real > 0) & (left.real < whole.real))
                best.offer(np.zeros(len(at), np.int64), labels.score(left[at], whole),
                           (bins.offsets[f] if numeric else bins.total) + at)
            rows.append((t, i, n, int(best.split[0]), int(whole[0].real), float(labels.mean(whole)[0]),
                         float(labels.gain(best.score, whole)[0])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    return run


def _binned(bins: Bins, labels: Labels):
    """Arrow batches of key, dup, label, train, numeric columns and category to binned rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
        for b in batches:
            if not b.num_rows:
                continue
            key, dup, y, is_train, *x = b.columns
            is_train = is_train.to_numpy(zero_copy_only=False).astype(np.bool_)
            y = np.where(is_train, y.to_numpy(zero_copy_only=False).astype(np.float64), labels.centre)
            values = x.pop().to_pylist() if bins.levels else None
            codes = bins.codes([c.to_numpy(zero_copy_only=False) for c in x], values, b.num_rows)
            yield _Rows(key.to_numpy(), dup.to_numpy().astype(np.int32), labels.whole(y), is_train, codes)
    return run


def _tops(rows: DataFrame, bins: Bins, labels: Labels, trees: int, depth: int, seed: int
          ) -> tuple[dict[int, _Top], dict[int, list[tuple[_Unit, int]]]]:
    """Splits every node of more than ``UNIT_ROWS`` rows, one level of all trees a pass; the trees so far, and
    for each its units with their rows."""
    tops = {t: _Top(np.full(1, LEAF), np.zeros(1, np.int64), np.zeros(1)) for t in range(trees)}
    open_from = {t: (0, 1) for t in tops}
    parts: dict[int, list] = {t: [] for t in tops}
    for at_depth in range(depth + 1):
        splits = {t: tops[t].split for t in open_from}
        found = (rows.mapInArrow(_histograms(bins, labels, splits, open_from, seed), _PARTIAL).repartition("tree", "node")
                 .mapInArrow(_chosen(bins, labels), _CHOICE).collect())
        following = {}
        for t, (start, n) in open_from.items():
            top, split = tops[t], tops[t].split
            for r in (r for r in found if r["tree"] == t):
                i = r["node"]
                top.weight[i], top.number[i] = r["weight"], r["label"]
                if r["rows"] <= UNIT_ROWS:
                    split[i] = HANDED - len(parts[t])
                    parts[t].append((_Unit(t, 1, len(parts[t]), depth - at_depth), r["rows"]))
                elif r["split"] >= 0 and at_depth < depth:
                    split[i], top.number[i] = r["split"], r["gain"]
                else:
                    split[i] = HANDED - len(parts[t])
                    parts[t].append((_Unit(t, 1, len(parts[t]), 0, r["label"]), r["rows"]))
            children = 2 * int((split[start:start + n] >= 0).sum())
            if children:
                following[t] = (len(split), children)
                tops[t] = _Top(np.append(split, np.full(children, LEAF)),
                               np.append(top.weight, np.zeros(children, np.int64)),
                               np.append(top.number, np.zeros(children)))
        if not following:
            break
        open_from = following
    return tops, parts


def _routed(bins: Bins, labels: Labels, tops: dict[int, np.ndarray], places: dict[int, list[tuple[int, int]]],
            groups: int):
    """Rows to blocks of what each unit needs of them.  Without tops every unit needs all rows."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def out(unit: int, cells: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([unit], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {t: (s, *links(s)) for t, s in tops.items()}
        for block in _binned(bins, labels)(batches):
            if not trees:
                cells = block.cells()
                for unit in range(groups):
                    yield out(unit, cells)
            for t, tree in trees.items():
                part = HANDED - tree[0][leaves(bins, tree, block.codes)]
                first, many = np.array(places[t]).T
                unit = first[part] + (row_hashes(block.key, block.dup) % many[part].astype(np.uint64)).astype(np.int64)
                order = np.argsort(unit, kind="stable")
                ends = np.flatnonzero(np.diff(unit[order], append=-1)) + 1
                for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
                    yield out(int(unit[order[a]]), block.some(order[a:b]).cells())
    return run


# ---------------------------------------------------------------- forest
@dataclass
class Forest:
    """Fitted trees.  ``trees`` (tree, part, start, split, weight, number) is a stored table: arrays of nodes, level
    by level, part -1 above the units.  ``totals`` (key, dup, unit, total) has the sums of the fitted rows, if wanted."""

    trees: DataFrame
    bins: Bins
    num_trees: int
    group: int
    totals: DataFrame | None = None

    @property
    def getNumTrees(self) -> int:
        return self.num_trees

    def fitted(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows given to ``fit`` (by key and dup) plus their predictions: units' sums in order, by trees."""
        sums = self.totals.groupBy("key", "dup").agg(F.sort_array(F.collect_list(F.struct("unit", "total"))).alias("__all"))
        mean = F.aggregate("__all", F.lit(0.0), lambda a, x: a + x["total"]) / F.lit(float(self.num_trees))
        return rows.join(sums, ["key", "dup"]).withColumn(name, mean).drop("__all")

    def importances(self) -> dict[str, float]:
        """STAT-8: gain times weight by column, each tree scaled to a sum of 1, then all together."""
        bins, names = self.bins, ["tree", "feature", "amount"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tree, split, weight, number in zip(*(c.to_pylist() for c in b.columns)):
                    split = np.frombuffer(split, np.int32).astype(np.int64)
                    inner = split >= 0
                    amount = np.frombuffer(number, np.float64)[inner] * np.frombuffer(weight, np.int32)[inner]
                    sums = np.bincount(bins.names_of(split[inner]), amount, len(bins.names))
                    at = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree), pa.int32()),
                                                      pa.array(at, pa.int32()), pa.array(sums[at], pa.float64())], names)
        each = (self.trees.select("tree", "split", "weight", "number")
                .mapInArrow(run, "tree int, feature int, amount double").groupBy("tree", "feature")
                .agg(F.sum("amount").alias("amount")).collect())
        sums = np.zeros((self.num_trees, len(bins.names)))
        for r in each:
            sums[r["tree"], r["feature"]] = r["amount"]
        whole = sums.sum(axis=1, keepdims=True)
        shares = np.divide(sums, whole, out=np.zeros_like(sums), where=whole > 0).sum(axis=0)
        return {n: float(v) for n, v in zip(bins.names, shares / (shares.sum() or 1.0))}

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, which has the forest's columns, plus the prediction: a map over any rows, in a batch or a stream.
        The trees go to the executors as a broadcast."""
        bins, group, num_trees = self.bins, self.group, self.num_trees
        held: dict[int, dict[int, list]] = {}
        found = self.trees.select("tree", "part", "start", "split", "number").collect()
        for r in sorted(found, key=lambda r: r[:3]):
            held.setdefault(r["tree"], {}).setdefault(r["part"], []).append(
                (np.frombuffer(r["split"], np.int32), np.frombuffer(r["number"], np.float64)))
        trees = df.sparkSession.sparkContext.broadcast(
            {t: {p: tuple(np.concatenate(c) for c in zip(*chunks)) for p, chunks in parts.items()}
             for t, parts in held.items()})

        def values(parts: dict, codes: np.ndarray) -> np.ndarray:
            def walk(part: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                split, number = parts[part]
                at = leaves(bins, (split, *links(split)), codes)
                return split[at], number[at]
            if -1 not in parts:
                return walk(0, codes)[1]
            end, out = walk(-1, codes)
            for part in np.unique(HANDED - end):
                at = np.flatnonzero(HANDED - end == part)
                if part in parts:
                    out[at] = walk(part, np.take(codes, at, axis=1))[1]
            return out

        @F.pandas_udf("double")
        def forest(x: pd.Series, category: pd.Series) -> pd.Series:
            columns = np.array(x.tolist(), np.float64).reshape(len(x), -1).T
            codes = bins.codes(list(columns), category.tolist() if bins.levels else None, len(x))
            total = np.zeros(len(x))
            whole = -1 not in trees.value[0]
            for first in range(0, num_trees, group if whole else 1):
                part = np.zeros(len(x))
                for t in range(first, min(first + (group if whole else 1), num_trees)):
                    part += values(trees.value[t], codes)
                total += part
            return pd.Series(total / num_trees)

        category = F.col(f"`{bins.category}`").cast("string") if bins.levels else F.lit(None).cast("string")
        numeric = F.array(*[F.col(f"`{c}`").cast("double") for c in bins.numeric]) if bins.numeric else \
            F.array().cast("array<double>")
        return df.withColumn(name, forest(numeric, category))

    def save(self, spark: SparkSession, path: str) -> None:
        self.trees.write.parquet(f"{path}/trees")
        rows = [(i, c, t.tolist()) for i, (c, t) in enumerate(zip(self.bins.numeric, self.bins.thresholds))]
        spark.createDataFrame(rows, "position int, column string, thresholds array<double>").coalesce(1).write.parquet(
            f"{path}/thresholds")
        spark.createDataFrame([(self.num_trees, self.group, self.bins.category, self.bins.levels)],
                              "trees int, in_group int, category string, levels array<string>").coalesce(1).write.parquet(
            f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        rows = spark.read.parquet(f"{path}/thresholds").orderBy("position").collect()
        of = spark.read.parquet(f"{path}/forest").first()
        bins = Bins([r["column"] for r in rows], [np.array(r["thresholds"], np.float64) for r in rows], of["category"],
                    list(of["levels"]))
        return cls(spark.read.parquet(f"{path}/trees"), bins, of["trees"], of["in_group"])


def with_keys(df: DataFrame) -> DataFrame:
    """``df`` plus ``key``, a hash of the row, and ``dup``, its number among equal rows."""
    from pyspark.sql import Window

    key = df.withColumn("key", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return key.withColumn("dup", F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1)


def fit(rows: DataFrame, numeric: list[str], category: str | None, levels: list[str], label: str, train: Column,
        num_trees: int, max_depth: int, max_bins: int = 64, seed: int = 42, predict: bool = True) -> Forest:
    """A forest on the ``train`` rows of ``rows``, a stored table with keys (``with_keys``).  All rows are predicted
    as the trees are done, unless only these are wanted; then the other rows stay where they are."""
    spark = rows.sparkSession
    chosen = rows.filter(F.coalesce(train, F.lit(False)))
    y = F.col(label).cast("double")
    n, low, high, n_all = rows.agg(*[f(F.when(train, y)) for f in (F.count, F.min, F.max)], F.count(F.lit(1))).first()
    if not n:
        raise ValueError("a forest needs rows to train on")
    some = chosen if n <= BIN_ROWS else chosen.filter(F.pmod("key", F.lit(1 << 30)) < int((1 << 30) * BIN_ROWS / n))
    table = some.select(*[F.col(f"`{c}`").cast("double") for c in numeric]).toPandas() if numeric else None
    points = [split_points(table.iloc[:, i].to_numpy(), min(max_bins, n)) for i in range(len(numeric))]
    bins, labels = Bins(numeric, points, category, list(levels)), Labels.of(n, low, high)
    cols = [f"`{c}`" for c in numeric] + ([f"`{category}`"] if bins.levels else [])
    slim = (rows if predict else chosen).select("key", "dup", y, F.coalesce(train, F.lit(False)), *cols)
    n_all = n_all if predict else n

    tops, units, places = {}, [], {}
    if n_all <= UNIT_ROWS:
        units = [_Unit(t, min(GROUP, num_trees - t), 0, max_depth) for t in range(0, num_trees, GROUP)]
    else:
        tops, parts = _tops(slim, bins, labels, num_trees, max_depth, seed)
        for t, of in parts.items():
            for unit, held in of:
                many = -(-held // UNIT_ROWS)
                places.setdefault(t, []).append((len(units), many))
                units += [unit] * many
    routed = slim.mapInArrow(_routed(bins, labels, {t: x.split for t, x in tops.items()}, places, len(units)), _BLOCK)
    grown = stored(routed.repartitionById(len(units), "unit")
                   .mapInArrow(_finished(bins, labels, units, seed, predict), _GROWN), "forest")
    trees = grown.filter(F.col("tree").isNotNull()).select("tree", "part", "start", "split", "weight", "number")
    if tops:
        cells = [(t, -1, 0, bytearray(x.split.astype(np.int32).tobytes()), bytearray(x.weight.astype(np.int32).tobytes()),
                  bytearray(x.number.tobytes())) for t, x in tops.items()]
        trees = trees.unionByName(spark.createDataFrame(cells, trees.schema))
    totals = grown.filter(F.col("tree").isNull()).select("key", "dup", "unit", "total")
    return Forest(trees, bins, num_trees, GROUP, totals if predict else None)
