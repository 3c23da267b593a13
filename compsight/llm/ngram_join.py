"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when 100 * |A & B| >= pct * |A | B| for their sets of word
shingles.  All sets are put in one order, rare shingles first.  Linked documents
then share at least l shingles in prefixes of |A| - ceil(pct |A| / 100) + l; each
document chooses the l whose longer prefix is paid for by fewer candidates, and a
pair is verified only if it shares enough shingles of the prefixes at l = min(l, l'):
with c of them shared, |A & B| <= c - l + max(ceil(pct |A| / 100), ceil(pct |B| / 100)),
as all that follow the prefix that ends first lie in its own set's rest.

Documents with equal sets are one class.  In lists of many documents a few pivots
are verified against all first; what they put into one component needs no
further pairs, so a large group of near copies never becomes all of its pairs.
The remaining candidates, those between components, are all verified: no link
that would join two components is lost.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compsight.llm.components import components, partial_labels
from compsight.llm.rows import bytes_of, forget, give_back, slices, summed_vector, text_col, vector_rows
from compsight.session import scratch_path

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Counters of the frequency sketch: a power of two near shingles / SKETCH_LOAD, within bounds.
SKETCH_LOAD = 32
SKETCH_MIN, SKETCH_MAX = 1 << 16, 1 << 24
#: Largest l that a document may choose; cost of a verification in scanned postings.
MAX_MATCHES = 4
VERIFY_COST = 16.0
#: Lists longer than this are first compared with PIVOTS of their documents.
LONG_LIST = 24
PIVOTS = 2
#: Shingles of each side of a block of pairs that is verified in one place.
BLOCK = 1 << 18
#: Pivot rounds go on while the pairs left exceed this many for each posting and a round halves them.
PAIRS_PER_POSTING = 4
MAX_ROUNDS = 4


def shingles(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of UTF-8 text; A-Z lower-cased, ASCII white space.

    Fewer than k words are one shingle, no words none.
    """
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(k, n)
    key = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        key = (key ^ (key >> np.uint64(29))) * MIX + h[i:n - k + 1 + i]
    return np.unique(key ^ (key >> np.uint64(32)))


def _signatures(docs: DataFrame, k: int, width: int) -> DataFrame:
    """Per row (doc_id, n, sig), and per task the counters (at, part) of its shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counters = np.zeros(width, np.uint32)
        mask = np.uint64(width - 1)
        names = ["doc_id", "n", "sig", "at", "part"]
        for b in batches:
            n, sig = [], []
            for raw in bytes_of(b.column(1)):
                s = shingles(raw, k)
                np.add.at(counters, (s & mask).astype(np.int64), 1)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                 none.cast(pa.int64()), none.cast(pa.binary())], names)
        for at, part in vector_rows(counters):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([at], pa.int64()), pa.array([part], pa.binary())], names)
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, at long, part binary")


def rank_levels(counters: np.ndarray) -> tuple[np.ndarray, float]:
    """Level of each counter, 0 for all that random sharing of counters explains, and the count where 1 begins."""
    heavy = 128 + 4 * float(counters.mean())
    levels = np.zeros(len(counters), np.uint8)
    at = np.flatnonzero(counters >= heavy)  # at most a quarter of all, as the mean says
    levels[at] = np.minimum(255, 1 + 4 * np.log2(counters[at] / heavy))
    return levels, heavy


def choose_prefix(s: np.ndarray, levels: np.ndarray, heavy: float, pct: int) -> tuple[np.ndarray, int, int, int]:
    """Prefix of a set, its l, its length at l = 1, and how many of it are light."""
    lev = levels[(s & np.uint64(len(levels) - 1)).astype(np.int64)]
    order = np.lexsort((s, lev))
    least = -(-pct * len(s) // 100)
    base = len(s) - least
    most = min(MAX_MATCHES, least)
    top = order[:base + most]
    # Expected other documents of each shingle: next to none for light ones.
    cost = np.cumsum(np.where(lev[top] == 0, 0.2, heavy * 2.0 ** ((lev[top].astype(float) - 1) / 4)))
    # A candidate with l matches uses l postings, so there are at most postings / l of them.
    ell = min(range(1, most + 1), key=lambda m: (base + m) + cost[base + m - 1] * (1 + VERIFY_COST / m))
    prefix = s[top[:base + ell]]
    return prefix, ell, base + 1, int(np.count_nonzero(lev[top[:base + ell]] == 0))


def _prefixes(docs: DataFrame, k: int, pct: int, levels: np.ndarray, heavy: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # SKETCH_MAX bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        lev = shared.value
        for b in batches:
            ids, rows = [], []
            for d, raw in zip(b.column(0).to_pylist(), bytes_of(b.column(1))):
                s = shingles(raw, k)
                if d is not None and len(s):
                    ids.append((d, len(s)))
                    rows.append(choose_prefix(s, lev, heavy, pct))
            if not ids:
                continue
            ends = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int32()),
                 *[pa.array([r[j] for r in rows], pa.int32()) for j in (1, 2, 3)], tokens],
                ["rid", "s", "ell", "base", "light", "tokens"])
        give_back()

    return docs.mapInArrow(run, "rid long, s int, ell int, base int, light int, tokens array<long>")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by their first column, whose value there occurs more than once; streams one batch at a time."""
    held = None  # the last row so far, not yet given out
    shown = False  # is its value known to repeat
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        t = b.column(0).to_numpy()
        same = t[1:] == t[:-1]
        keep = np.zeros(len(t), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= shown
        held, last = b.slice(len(t) - 1, 1), bool(keep[-1])
        out = b.slice(0, len(t) - 1).filter(pa.array(keep[:-1]))
        shown = last
        if out.num_rows:
            yield out
    if held is not None and shown:
        yield held


def _postings(prefixes: DataFrame, reps: DataFrame) -> DataFrame:
    """(token, rid, s, need, ell, shared): prefix shingles of class representatives that others have too."""
    rows = (prefixes.join(reps.select("rid"), "rid", "left_semi")
            .select("rid", "s", "ell", "base", "light", F.posexplode("tokens").alias("i", "token"))
            .select("token", "rid", "s", F.greatest(F.lit(1), F.col("i") - F.col("base") + 2).alias("need"), "ell",
                    (F.col("i") < F.col("light")).alias("is_light")))
    path = scratch_path(rows.sparkSession, "prefix-rows")
    rows.write.partitionBy("is_light").option("compression", "zstd").parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    # The sketch bounds how many documents share a light shingle; heavy ones stay where they are.
    light = (rows.where("is_light").drop("is_light").repartition("token").sortWithinPartitions("token")
             .mapInArrow(_repeated, rows.drop("is_light").schema))
    shared = light.union(rows.where("not is_light").drop("is_light")).dropDuplicates(["token", "rid"])
    # How many shingles of its prefix a document can share at all: a window over one prefix.
    return shared.withColumn("shared", F.count("*").over(Window.partitionBy("rid")).cast("int"))


def _blocks(pairs: DataFrame) -> DataFrame:
    """(hub, x, y, a, b) of each pair (a, b, sa, sb): pairs of one block are verified in one place.

    A pair goes to the busiest neighbour of its ``a``, so that each text of a group of copies travels there
    once and not once a pair.  A hub's pairs are cut into blocks by both ends, each side about ``BLOCK`` shingles.
    """
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    degree = both.groupBy("v").agg(F.count("*").alias("d"))
    hubs = (both.union(degree.select(F.col("v").alias("u"), "v")).join(degree, "v").groupBy("u")
            .agg(F.max(F.struct("d", "v"))["v"].alias("hub")).withColumnRenamed("u", "a"))
    keyed = _stored(pairs.join(hubs, "a"), "keyed-pairs")
    for end, size, at in (("a", "sa", "x"), ("b", "sb", "y")):
        parts = keyed.groupBy("hub", end).agg(F.max(size).alias("n")).groupBy("hub").agg(
            F.ceil(F.sum("n") / BLOCK).alias("parts"))
        keyed = keyed.join(parts, "hub").withColumn(at, F.pmod(F.xxhash64(end), "parts")).drop("parts")
    return keyed.select("hub", "x", "y", "a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, pct: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, sa, sb) for which a whole text of a and one of b link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        block, sets = None, {}  # of the block: its documents' sets, keyed by their digests as rows may be repeated
        for batch in (part for b in batches for part in slices(b, 5)):
            found = []
            for hub, x, y, a, b, raw in zip(*[c.to_pylist() for c in batch.columns[:5]], bytes_of(batch.column(5))):
                if block != (hub, x, y):
                    block, sets = (hub, x, y), {}
                if b is None:
                    one = shingles(raw, k)
                    sets.setdefault(a, {})[hashlib.blake2b(one.tobytes(), digest_size=16).digest()] = one
                elif any(_linked(p, q, pct) for p in sets[a].values() for q in sets[b].values()):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        give_back()

    # Written, so that Spark knows the sizes: few are broadcast, and only texts that pairs name are shuffled.
    blocks = _stored(_blocks(_stored(pairs.select("a", "b", "sa", "sb"), "pairs")), "blocks")
    ends = blocks.select("hub", "x", "y", F.col("a").alias("doc_id")).union(blocks.select("hub", "x", "y", "b"))
    ends = _stored(ends.distinct(), "block-ends")
    named = texts.join(_stored(ends.select("doc_id").distinct(), "named"), "doc_id", "left_semi")
    sent = named.join(ends, "doc_id").select("hub", "x", "y", F.col("doc_id").alias("a"),
                                             F.lit(None).cast("long").alias("b"), "text")
    rows = sent.union(blocks.select("hub", "x", "y", "a", "b", F.lit("")))
    return (rows.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y", F.asc_nulls_first("b"))
            .mapInArrow(run, "a long, b long"))


def _linked(p: np.ndarray, q: np.ndarray, pct: int) -> bool:
    if not len(p) or 100 * min(len(p), len(q)) < pct * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= pct * (len(p) + len(q) - both)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _least_shared(pct: int) -> str:
    """Shingles that two linked sets share at least in their prefixes at the smaller l."""
    both = f"({pct} * (x.s + y.s) + {99 + pct}) div {100 + pct}"
    return f"(least(x.ell, y.ell) + {both} - ({pct} * greatest(x.s, y.s) + 99) div 100)"


def _fit(pct: int) -> str:
    """Sets that can link by their sizes and shared shingles, and shingles in both prefixes at the smaller l."""
    return (f"100 * least(x.s, y.s) >= {pct} * greatest(x.s, y.s) and x.component != y.component "
            "and greatest(x.need, y.need) <= least(x.ell, y.ell) "
            f"and least(x.shared, y.shared) >= {_least_shared(pct)}")


def _ends() -> list:
    """A pair's smaller id a and larger id b with the sizes of their sets."""
    first, second = (F.struct(F.col(f"{t}.rid").alias("rid"), F.col(f"{t}.s").alias("s")) for t in "xy")
    low, high = F.least(first, second), F.greatest(first, second)
    return [low["rid"].alias("a"), high["rid"].alias("b"), low["s"].alias("sa"), high["s"].alias("sb")]


def _pairs_left(postings: DataFrame) -> DataFrame:
    """Per token its rows, its largest component and the pairs between its components."""
    return (postings.groupBy("token", "component").agg(F.count("*").alias("c"))
            .groupBy("token").agg(F.sum("c").alias("m"), F.max_by("component", F.struct("c", "component")).alias("main"),
                                  ((F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
            .where("pairs > 0"))


def link_components(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of ``docs``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id
    reachable by links.  Null, empty and blank texts have no shingles and only their own
    id.  Rows with a null id take their class's ids and are no link's end; rows that share
    an id are one document with the links of all of them.  An empty table gives no rows;
    other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_col(docs, text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    width = min(SKETCH_MAX, max(SKETCH_MIN, 1 << int(size / 6 / SKETCH_LOAD).bit_length()))
    first = _stored(_signatures(slim, k, width), "signatures")
    rows = first.where("at is null").select("doc_id", "n", "sig")
    levels, heavy = rank_levels(summed_vector(first.where("at is not null"), width))

    reps = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rid")).where("rid is not null")
    postings = _stored(_postings(_prefixes(slim, k, pct, levels, heavy), reps), "postings")

    # Lists by their length: only long ones are worth pivots and labels.
    counts = postings.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    lists = _stored(postings.join(counts, "token").withColumn("component", F.col("rid")), "lists")
    short, long = lists.where(F.col("m") <= LONG_LIST), lists.where(F.col("m") > LONG_LIST)

    links, before = None, 0
    for round_ in range(MAX_ROUNDS + 1):
        if links is not None:
            labels = partial_labels(links).withColumnRenamed("id", "rid").withColumnRenamed("component", "label")
            long = _stored(long.join(labels, "rid", "left").withColumn(
                "component", F.coalesce("label", "component")).drop("label"), "round")
        tokens = _stored(_pairs_left(long), "tokens")
        rows_left, pairs_left = tokens.agg(F.coalesce(F.sum("m"), F.lit(0)),
                                           F.coalesce(F.sum("pairs"), F.lit(0.0))).collect()[0]
        if round_ == MAX_ROUNDS or pairs_left <= PAIRS_PER_POSTING * rows_left or round_ and pairs_left > before / 2:
            break
        before = pairs_left
        open_ = long.join(tokens.select("token"), "token")
        picks = open_.groupBy("token").agg(*[
            F.min_by(F.struct("rid", "s", "need", "ell", "shared", "component"),
                     # The first shares most with others, the second is any.
                     F.struct((F.lit(0) if p else -F.col("shared")).alias("c"),
                              F.xxhash64("rid", F.lit(round_ * PIVOTS + p)))).alias(f"p{p}") for p in range(PIVOTS)])
        pivots = picks.select("token", F.explode(F.array(*[f"p{p}" for p in range(PIVOTS)])).alias("p")).select(
            "token", "p.*").distinct()
        pairs = (open_.alias("x").join(pivots.alias("y"), "token").where(_fit(pct))
                 .select(*_ends()).groupBy("a", "b").agg(F.max("sa").alias("sa"), F.max("sb").alias("sb")))
        new = _stored(_verified(pairs, slim, k, pct), "pivot-links")
        links = new if links is None else links.union(new)

    # Every pair that is left between two components, by documents outside a token's largest one.  A pair of
    # one component has one label in long lists: it may be counted in short ones only and changes nothing.
    main = long.drop("m").join(tokens.select("token", "main"), "token").union(
        short.drop("m").join(short.groupBy("token").agg(F.min("component").alias("main")), "token"))
    rest = main.where("component != main")
    meet = (rest.alias("x").join(main.alias("y"), "token")
            .where(_fit(pct) + " and (y.component = y.main or x.rid < y.rid)")
            .select(*_ends(), F.expr(_least_shared(pct)).alias("least")))
    pairs = meet.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least"), F.max("sa").alias("sa"),
                                       F.max("sb").alias("sb")).where("n >= least")
    new = _stored(_verified(pairs, slim, k, pct), "pair-links")
    found = components(new if links is None else links.union(new))

    classes = (reps.join(found.withColumnRenamed("id", "rid"), "rid", "left")
               .select("sig", F.col("rid").alias("class_id"), F.coalesce("component", "rid").alias("component_id")))
    linked = (rows.where("n > 0").join(classes, "sig", "left")
              .select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"),
                                       F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def keep_one(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows of ``docs``: of each component the row with its smallest id, once; all rows without shingles or id."""
    ids = linked.where("n_shingles > 0 and doc_id = component_id").select("doc_id").distinct()
    bare = linked.where("n_shingles = 0").select("doc_id").distinct()
    one = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return (one.union(docs.where("doc_id is null"))
            .union(docs.join(bare, "doc_id", "left_semi").join(ids, "doc_id", "left_anti")))
