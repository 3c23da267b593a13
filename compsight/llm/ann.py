"""Nearest neighbours by randomly rotated one-bit codes of residuals.

Centres come from a bounded sample; every vector belongs to the nearest one, its
cell.  Its residual, the vector less its centre, is turned by a random rotation;
the signs of its coordinates are its code, packed in 64-bit words.  Two correction
scalars go with it: the residual's length and how well the code points in its
direction.  Inner products are estimated by bit counts: a query's coordinates are
rounded to ``QUERY_BITS`` bit planes, and each plane is met with the code words.

A query first meets the sample exactly.  Its k-th best score there is a bar that
the true k-th best reaches.  It then goes only to cells whose bound reaches the
bar, and there only vectors whose estimate plus slack reaches the bar, or the k-th
best found so far, are compared exactly.

Bounds hold by ``epsilon`` standard errors (``EPSILON``) for codes and by
``reach`` deviations (``REACH``) of the sample for cells.  With both None they are
those of Cauchy and Schwarz, and the search is exact.  A large cell is cut into blocks by a hash,
queries into blocks too, so a task holds two bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compsight.session import scratch_path

#: Rows of a block of stored vectors and of a block of queries.
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 4096
#: The sample that gives centres and bars: rows of each dimension, and bytes of all of them.
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 16 << 20
#: Most cells of a dimension, and rows that a cell is meant to hold.
MAX_CELLS, CELL_ROWS = 1024, 4096
ROUNDS = 8
#: Standard errors in the bound of an estimate, and deviations from a cell's mean product in the bound of a cell,
#: which needs so many sampled vectors of the cell.
EPSILON = 1.5
REACH = 4.0
LEAST_SEEN = 32
QUERY_BITS = 4
SEED = 20_240_613


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix that depends on the dimension and the seed only."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, dim): rows with an id whose vector is not null, empty or zero and has finite components only."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    slim = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (slim.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
            .where(finite & F.exists("vec", lambda x: x != 0))
            .withColumn("dim", F.size("vec")))


@dataclass
class Cells:
    """Sampled vectors of one dimension with their ids, in the order of their cells, and the centres made of them."""

    ids: np.ndarray
    sample: np.ndarray = field(repr=False)
    centres: np.ndarray = field(repr=False)
    seen: np.ndarray = field(repr=False)  # sampled vectors of each cell


def nearest_centre(vecs: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centre; ties to the first."""
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([(vecs[lo:lo + 4096] @ centres.T - half).argmax(1) for lo in range(0, len(vecs), 4096)]
                          or [np.zeros(0, np.int64)])


def fit_cells(ids: np.ndarray, sample: np.ndarray, rows: int) -> Cells:
    """Centres of about ``rows`` / ``CELL_ROWS`` cells by a few rounds of k-means over the sample."""
    k = int(max(1, min(MAX_CELLS, -(-rows // CELL_ROWS), len(sample))))
    # The first centres: each is drawn by its squared distance from those before.
    rng, first = np.random.default_rng(SEED), [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(first) < k:
        total = far.cumsum()
        first.append(min(len(sample) - 1, int(np.searchsorted(total, rng.random() * total[-1], side="right"))))
        far = np.minimum(far, ((sample - sample[first[-1]]) ** 2).sum(1))
    centres = sample[first]
    for _ in range(ROUNDS):
        at = nearest_centre(sample, centres)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centres)
    at = nearest_centre(sample, centres)
    order = np.argsort(at, kind="stable")
    return Cells(ids[order], sample[order], centres, np.bincount(at, minlength=k))


def sampled(rows: DataFrame) -> dict[int, Cells]:
    """Cells of each dimension: its rows of least hash, ``SAMPLE_ROWS`` and their share of ``SAMPLE_BYTES`` at most."""
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    least = {d: max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d * len(counts)))) for d in counts}
    share = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, min(1.0, 1.2 * least[d] / n))])
    h = F.xxhash64("vec_id", "vec", F.lit(SEED))
    # A share of the hash range first, so that the sort sees little more than the sample.
    few = rows.withColumn("h", h).where(F.col("h").cast("double") / F.lit(2.0**64) + 0.5 <= share[F.col("dim")])
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy("h", "vec_id")))
    wanted = F.create_map(*[F.lit(x) for d in counts for x in (d, least[d])])
    out = {}
    got = first.where(F.col("r") <= wanted[F.col("dim")]).select("dim", "vec_id", "vec").toPandas()
    for d, n in counts.items():
        g = got[got["dim"] == d]
        vecs = np.stack(g["vec"].to_numpy()).astype(float) if len(g) else np.zeros((0, d))
        out[d] = fit_cells(g["vec_id"].to_numpy(np.int64), vecs, n) if len(g) else \
            Cells(np.zeros(0, np.int64), vecs, np.zeros((1, d)), np.zeros(1, np.int64))
    return out


def encode(vecs: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell, code words, residual length and code quality of each vector."""
    dim = vecs.shape[1]
    cell = nearest_centre(vecs, cells.centres)
    rest = (vecs - cells.centres[cell]) @ rotation(dim)
    length = np.sqrt((rest * rest).sum(1))
    # <code, direction> for the code's unit vector; 1 for a vector that is the centre itself.
    quality = np.abs(rest).sum(1) / np.sqrt(dim)
    quality = np.where(length > 0, quality / np.where(length > 0, length, 1), 1.0)
    return cell, words_of(rest > 0), length, quality


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, the last one filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, :packed.shape[1]] = packed
    return out.view(np.uint64)


def planes_of(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, low, step): rounded coordinates are low + step * sum of 2^j times plane j, per query."""
    low, top = turned.min(1), turned.max(1)
    step = np.maximum(top - low, 1e-300) / ((1 << QUERY_BITS) - 1)
    u = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    return np.stack([words_of((u >> j) & 1 == 1) for j in range(QUERY_BITS)]), low, step


def counted(words: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sum over set bits of each row's code of each query's rounded coordinates, by bit counts: queries x rows."""
    out = np.zeros((planes.shape[1], words.shape[1]), np.int32)
    for j in range(len(planes)):
        for w in range(len(words)):
            out += np.bitwise_count(planes[j, :, w, None] & words[w]).astype(np.int32) << j
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component: the same whatever the block."""
    acc = np.zeros(len(a))
    for d in range(a.shape[1]):
        acc += a[:, d] * b[:, d]
    return acc


def bars(queries: np.ndarray, q_ids: np.ndarray, cells: Cells, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches for certain: its k-th best of the sample, less rounding."""
    out = np.full(len(queries), -np.inf)
    for lo in range(0, len(queries) if len(cells.ids) >= k else 0, 256):
        q = queries[lo:lo + 256]
        s = q @ cells.sample.T
        s[q_ids[lo:lo + 256, None] == cells.ids] = -np.inf
        kth = np.partition(s, len(cells.ids) - k, axis=1)[:, len(cells.ids) - k]
        out[lo:lo + 256] = kth - 1e-9 * np.sqrt((q * q).sum(1) * (cells.sample**2).sum(1).max())
    return out


def reached(queries: np.ndarray, bar: np.ndarray, cells: Cells, radius: np.ndarray,
            reach: float | None = REACH) -> np.ndarray:
    """queries x cells: may the cell hold a vector that reaches the query's bar?  Empty cells (radius below 0) never.

    The bound is that of Cauchy and Schwarz or, where a cell has ``LEAST_SEEN`` sampled vectors, the mean
    of the query's products with them plus ``reach`` standard deviations, whichever is lower.
    """
    norm = np.sqrt((queries * queries).sum(1))[:, None]
    size = np.sqrt((cells.centres**2).sum(1))
    top = queries @ cells.centres.T + norm * radius + 1e-9 * norm * (size + np.maximum(radius, 0))
    some = np.flatnonzero(cells.seen)
    if reach is not None and len(some):
        s, n = queries @ cells.sample.T, cells.seen[some]
        begin = np.cumsum(n) - n
        mean = np.add.reduceat(s, begin, axis=1) / n
        spread = np.sqrt(np.maximum(0, np.add.reduceat(s * s, begin, axis=1) / n - mean * mean))
        likely = np.where(n >= LEAST_SEEN, mean + reach * spread + 1e-6 * norm * size[some], np.inf)
        top[:, some] = np.minimum(top[:, some], likely)
    return (top >= bar[:, None]) & (radius >= 0)


def search_block(words: np.ndarray, length: np.ndarray, quality: np.ndarray, ids: np.ndarray,
                 vecs: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, bar: np.ndarray, centre: np.ndarray, k: int,
                 epsilon: float | None = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, ids, scores, pairs compared exactly): what of the block can be among each query's k best."""
    dim = vecs.shape[1]
    root = np.sqrt(dim)
    turned = queries @ rotation(dim)
    base = queries @ centre
    norm = np.sqrt((queries * queries).sum(1))
    planes, low, step = planes_of(turned)
    by_word = np.ascontiguousarray(words.T)
    ones = np.bitwise_count(by_word).sum(0, dtype=np.int32).astype(np.float32)
    scale = (length / quality / root).astype(np.float32)
    # Per unit of the query's length: what the code leaves open of the residual's direction.
    off = length * np.sqrt(np.maximum(0, 1 - quality * quality)) / quality
    off = off if epsilon is None else epsilon * off / np.sqrt(max(1, dim - 1))
    # Rounding of the query, per unit of ``scale``: every coordinate by half a step, or as many independent errors.
    rounded = step * (dim / 2 if epsilon is None else epsilon * np.sqrt(dim / 12))
    compared = 0
    out = []
    tile = max(1, (1 << 18) // max(1, len(ids)))
    for lo in range(0, len(queries), tile):
        s = slice(lo, lo + tile)
        sums = counted(by_word, planes[:, s])
        est = (2 * (low[s, None].astype(np.float32) * ones + step[s, None].astype(np.float32) * sums)
               - turned[s].sum(1, keepdims=True).astype(np.float32)) * scale
        est += base[s, None].astype(np.float32)
        # Single precision in the estimate: the margin covers its rounding.
        slack = (norm[s, None] * (off + 1e-5 * (length + np.abs(scale) * root))
                 + rounded[s, None] * scale + 1e-5 * np.abs(base[s, None])).astype(np.float32)
        own = q_ids[s, None] == ids
        est[own] = -np.inf
        bound = bar[s].copy()
        done = None
        if len(ids) > k:
            # The k best by estimate, compared exactly, raise the bar.
            done = np.argpartition(-est, k - 1, axis=1)[:, :k]
            some = np.einsum("qkd,qd->qk", vecs[done], queries[s])
            valid = ~np.take_along_axis(own, done, 1)
            kth = np.where(valid, some, -np.inf).min(1)
            bound = np.maximum(bound, kth - 1e-9 * norm[s] * np.sqrt((vecs[done] ** 2).sum(2).max(1)))
            compared += done.size
        # The k best by estimate stay whatever the bar, so that a query has k results.
        stay = np.full(est.shape, done is None)
        if done is not None:
            np.put_along_axis(stay, done, True, 1)
        q, r = np.nonzero(stay | (est + slack >= bound[:, None].astype(np.float32) - np.float32(1e-6)))
        score = np.zeros(len(q))
        for c in range(0, len(q), 1 << 15):
            p = slice(c, c + (1 << 15))
            score[p] = np.einsum("ij,ij->i", queries[lo + q[p]], vecs[r[p]])
        compared += len(q)
        # Only what can be among the k best is summed in the fixed order.
        keep = (score >= bound[q]) | stay[q, r]
        keep[own[q, r]] = False
        q, r, score = q[keep], r[keep], score[keep]
        order = np.lexsort((-score, q))
        q, r, score = q[order], r[order], score[order]
        begin = np.searchsorted(q, q, side="left")
        last = np.minimum(begin + k - 1, np.searchsorted(q, q, side="right") - 1)
        near = score >= score[last] - 1e-9 * (1 + np.abs(score[last]))
        q, r = q[near], r[near]
        score = inner(queries[lo + q], vecs[r])
        order = np.lexsort((ids[r], -score, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order], side="left")
        best = order[rank < k]
        out.append((q_ids[lo + q[best]], ids[r[best]], score[best]))
    return (*(np.concatenate(x) for x in zip(*out)), compared)


def nearest(vectors: DataFrame, k: int, query_modulus: int, id_col: str = "vec_id",
            vec_col: str = "embedding", epsilon: float | None = None, reach: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each query.

    Queries are the rows whose id is divisible by ``query_modulus``; every usable row but
    those with the query's own id is a candidate.  Ranks by score, then smaller id.  Only
    vectors of the query's dimension are compared.  A repeated row is a candidate
    each time it occurs and a query once for each distinct vector of its id.  Rows that
    ``usable`` leaves out take no part; an empty table gives no rows; other columns are
    not read.  Exact, unless ``epsilon`` and ``reach`` are given.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "vectors")
    rows = usable(vectors, id_col, vec_col)
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    cells = spark.sparkContext.broadcast(sampled(rows))  # SAMPLE_BYTES and MAX_CELLS centres a dimension at most

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby("dim"):
                cell, words, length, quality = encode(np.stack(g["vec"].to_numpy()), cells.value[dim])
                yield pd.DataFrame({"vec_id": g["vec_id"].to_numpy(), "vec": g["vec"].to_numpy(), "dim": dim, "cell": cell,
                                    "code": [x.tobytes() for x in words], "length": length, "quality": quality})

    index_path = scratch_path(spark, "index")
    (rows.mapInPandas(code, "vec_id long, vec array<double>, dim int, cell int, code binary, length double, quality double")
     .write.parquet(index_path))
    index = spark.read.parquet(index_path)
    sizes = index.groupBy("dim", "cell").agg(F.max("length").alias("radius"), F.count("*").alias("n")).collect()
    asking = {r.dim: r.n for r in index.where(F.col("vec_id") % query_modulus == 0)
              .groupBy("dim").agg(F.count("*").alias("n")).collect()}
    # One row a cell, MAX_CELLS of a dimension at most.
    blocks = [(r.dim, r.cell, float(r.radius), -(-r.n // BLOCK_ROWS), -(-asking.get(r.dim, 1) // BLOCK_QUERIES)) for r in sizes]
    layout = spark.sparkContext.broadcast({d: [b[1:] for b in blocks if b[0] == d] for d in {b[0] for b in blocks}})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each block of each cell that a query has to visit."""
        for b in batches:
            for dim, g in b.groupby("dim"):
                own, plan = cells.value[dim], layout.value[dim]
                q, ids = np.stack(g["vec"].to_numpy()), g["vec_id"].to_numpy()
                bar = bars(q, ids, own, k)
                radius = np.full(len(own.centres), -1.0)
                n_blocks = np.zeros(len(own.centres), np.int64)
                for cell, r, n, _ in plan:
                    radius[cell], n_blocks[cell] = r, n
                part = g["h"].to_numpy() % plan[0][3]
                for lo in range(0, len(q), 64):
                    at, cell = np.nonzero(reached(q[lo:lo + 64], bar[lo:lo + 64], own, radius, reach))
                    n = n_blocks[cell]
                    at, cell = np.repeat(lo + at, n), np.repeat(cell, n)
                    block = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    yield pd.DataFrame({"dim": dim, "cell": cell, "row_block": block, "query_block": part[at],
                                        "vec_id": ids[at], "vec": g["vec"].to_numpy()[at], "bar": bar[at]})

    shape = spark.createDataFrame([(d, c, n, q) for d, c, _, n, q in blocks] or [(0, 0, 1, 1)],
                                  "dim int, cell int, n_blocks int, q_blocks int")
    stored = (index.join(F.broadcast(shape), ["dim", "cell"])
              .withColumn("row_block", F.pmod(F.xxhash64("vec_id", "vec"), F.col("n_blocks")).cast("int"))
              .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
              .select("dim", "cell", "row_block", "query_block", "vec_id", "vec", "code", "length", "quality"))
    asked = (rows.where(F.col("vec_id") % query_modulus == 0).select("dim", "vec_id", "vec").distinct()
             .withColumn("h", F.xxhash64("vec_id", "vec").bitwiseAND(F.lit((1 << 62) - 1)))
             .mapInPandas(route, "dim int, cell int, row_block int, query_block int, vec_id long, vec array<double>, bar double"))
    key = ["dim", "cell", "row_block", "query_block"]

    def search(at, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        words = np.frombuffer(b"".join(left["code"]), np.uint64).reshape(len(left), -1)
        q, v, s, _ = search_block(
            words, left["length"].to_numpy(), left["quality"].to_numpy(), left["vec_id"].to_numpy(),
            np.stack(left["vec"].to_numpy()), right["vec_id"].to_numpy(), np.stack(right["vec"].to_numpy()),
            right["bar"].to_numpy(), cells.value[int(at[0])].centres[int(at[1])], k, epsilon)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    found = stored.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(
        search, "query_id long, vec_id long, score double")
    # At most k rows from each block of vectors: Spark keeps the first k of a query before it shuffles.
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
