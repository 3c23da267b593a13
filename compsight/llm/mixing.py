"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents lie in (source, id) order on a line of words that a grid cuts into
blocks.  Every source's target fixes exactly which of its blocks the mix draws,
in permuted order; the last ones are cut between documents.  The quotas of all
sources start at the root of a binary tree over the output shards.  A node hands
its left half an exact number of blocks whose sources are a
multivariate-hypergeometric draw from its own quotas, the rest to its right half;
so every shard has its exact number of blocks, every source its exact quota, and
the composition is that of a full shuffle.  A shard takes its quota as a run of
the source's permuted blocks, disjoint from all others, and orders the documents
of its blocks by hash.  DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compsight.llm.ordering import running, stored

#: Words of a shard and of a block, of the production query.
SHARD_WORDS, BLOCK_WORDS = 1 << 22, 1 << 14
#: Permuted blocks after the last whole one whose documents fill what is left of a target.
CUT_BLOCKS = 4
#: Further blocks are cut while more than this share of the target is missing.
NEAR = 0.001
SEED = 20_011
#: A draw looks this many standard deviations to both sides: beyond lies less than a double's resolution of 1.
DEVIATIONS = 9
_SPACE = r"\x20\x09-\x0D"
_ADDED = ("size", "source_size", "target", "taken", "draws")


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and tab to carriage return."""
    marks = F.regexp_replace(F.regexp_replace(text, f"[^{_SPACE}]++", "x"), f"[{_SPACE}]++", "")
    return F.length(F.coalesce(marks, F.lit(""))).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2,
        shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: int = SEED,
        source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", carry_text: bool = False) -> DataFrame:
    """Every row of ``docs`` plus its size, its source's size and target, the words taken and its draws.

    The text is measured and then left behind, so that it is neither exchanged nor written, but with
    ``carry_text``, which ``mixed_rows`` needs to give whole documents.

    Sources in code point order, null last, weigh ``weights`` in turn; together they
    get ``share`` of all words, none more than ``most`` times its own, the excess
    goes to the others by weight.  ``draws`` is an array of (copy, shard, place):
    a document is drawn whole, once a copy; ``taken`` is size times draws, so no
    document exceeds ``most`` times its size.  A source's words miss its target by
    at most ``NEAR`` of it, or by less than the smallest document left in the blocks cut last, its last blocks.

    Null and empty texts have size 0; they are drawn with their block and add
    nothing.  A null source is a source, null ids come first, repeated rows and equal
    ids are rows like any other.  An empty table gives no rows.  Columns of
    ``docs`` named like an added one (in any case) are replaced.  The result
    depends on rows and parameters only, not on partitions or order.  A tree node holds
    one number for each source in one row.
    """
    left_out = _ADDED if carry_text else (*_ADDED, text_col.lower())
    kept = [c for c in docs.columns if c.lower() not in left_out and not c.startswith("__")]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept],
                       F.coalesce(F.concat(F.lit("a"), F.col(f"`{source_col}`").cast("string")),
                                  F.lit("b")).alias("__key"),
                       F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__tie"),
                       word_count(text).alias("size"))
    line = running(rows, ["__key", "__id", "__tie"], {"__at": F.col("size") + 1}, "mix-line")
    line = line.withColumn("__block", F.floor(F.col("__at") / F.lit(block_words)).cast("long"))
    sources = source_targets(line.groupBy("__key").agg(F.sum("size").alias("source_size")), weights, share, most)
    blocks = stored(line.groupBy("__key", "__block").agg(F.sum("size").alias("__words")).join(sources, "__key"),
                    "mix-blocks")
    drawn = stored(_drawn_blocks(line, blocks, most, seed), "mix-draws")
    mixed_words = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    placed = _in_shards(drawn, max(1, math.ceil(mixed_words / shard_words)), seed)
    draws = placed.groupBy("__key", "__block").agg(
        F.sort_array(F.collect_list(F.struct("copy", "shard", "cut"))).alias("__draws"))
    hit = F.filter("__draws", lambda d: d["cut"].isNull() | F.array_contains(d["cut"], F.col("__at")))
    at_place = F.transform(hit, lambda d: F.struct(
        d["copy"].alias("copy"), d["shard"].alias("shard"),
        F.xxhash64(F.lit(seed), F.col("__at"), d["copy"]).alias("place")))
    whole = blocks.join(draws, ["__key", "__block"], "left").select(
        "__key", "__block", "source_size", "target", "__draws")
    return (line.join(whole, ["__key", "__block"])
            .withColumn("draws", F.coalesce(at_place, F.array().cast("array<struct<copy:int,shard:int,place:bigint>>")))
            .select(*kept, "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws"))


def mixed_rows(mixed: DataFrame, shards_a_task: int = 1) -> DataFrame:
    """The rows that a mix draws, once a draw, with ``copy``, ``shard`` and ``place``, in the order of every shard.

    A shard lies in one task (its words are bounded) and is shuffled there: sorted by
    ``place``, a hash.  Columns of these names are replaced.
    """
    top = mixed.agg(F.max(F.array_max(F.transform("draws", lambda d: d["shard"])))).first()[0] or 0
    kept = [c for c in mixed.columns if c.lower() not in ("draws", "copy", "shard", "place")]
    rows = mixed.select(*[F.col(f"`{c}`") for c in kept], F.inline("draws"))
    return (rows.repartition(max(1, (top + 1) // shards_a_task), "shard")
            .sortWithinPartitions("shard", "place", "copy"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """(__key, source_size, target) of (__key, source_size), stored: capped shares, the excess reshared by weight.

    A source is closed at its cap when its share of what the open ones have reaches it;
    that only raises the others, so rounds end.  The driver gets one row a round.
    """
    ranked = running(sizes, ["__key"], {"__rank": F.lit(1)}, "mix-sources")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = ranked.withColumn("__w", F.element_at(turn, (F.col("__rank") % len(weights) + 1).cast("int")))
    total, cap = share * (table.agg(F.sum("source_size")).first()[0] or 0), F.col("source_size") * float(most)
    level, closed = 0.0, -1
    while True:
        shut = F.col("__w") * F.lit(level) > cap
        r = table.agg(F.count_if(shut).alias("n"), F.sum(F.when(shut, cap).otherwise(0.0)).alias("full"),
                      F.sum(F.when(shut, 0.0).otherwise(F.col("__w"))).alias("open")).first()
        if not r["n"] or r["n"] > closed:  # the first round closes none, and sets the level
            if r["n"] == closed or not r["open"]:
                break
            level, closed = (total - r["full"]) / r["open"], r["n"]
        else:
            break
    target = F.least(F.col("__w") * F.lit(level), cap)
    return stored(table.select("__key", "source_size", target.alias("target")), "mix-targets")


def _drawn_blocks(line: DataFrame, blocks: DataFrame, most: int, seed: int) -> DataFrame:
    """(__key, __block, copy, cut): all draws of a block; ``cut`` lists the documents of one that is not whole."""
    blocks = blocks.where("__words > 0").withColumn(
        "__whole", F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)).cast("int"))
    blocks = blocks.withColumn("__room", F.col("target") - F.col("__whole") * F.col("source_size"))
    no_cut = F.lit(None).cast("array<bigint>").alias("cut")
    full = (blocks.where("__whole > 0")
            .select("__key", "__block", F.explode(F.sequence(F.lit(0), F.col("__whole") - 1)).alias("copy"), no_cut))
    # Part of one more copy: blocks in permuted order as long as they fit.
    order = blocks.where((F.col("__whole") < most) & (F.col("__room") > 0)).withColumn(
        "__mix", F.xxhash64(F.lit(seed), "__key", "__block"))
    order = running(order, ["__key", "__mix", "__block"], {"__before": F.col("__words"), "__nth": F.lit(1)}, "mix-part")
    copy, draws = F.col("__whole").alias("copy"), full
    state = stored(order.groupBy("__key").agg(F.min("__nth").alias("__from"), F.min("__before").alias("__base"),
                                              F.first("__room").alias("__left")), "mix-room")
    while True:
        here = (order.drop("__room").join(state, "__key").where("__nth >= __from")
                .withColumn("__end", F.col("__before") + F.col("__words") - F.col("__base")))
        draws = draws.unionByName(here.where("__end <= __left").select("__key", "__block", copy, no_cut))
        # The block that no longer fits and some after it give single documents.
        crossing = (here.where("__end > __left AND __end - __words <= __left")
                    .select("__key", F.col("__nth").alias("__cross"), (F.col("__left") - F.col("__end") + F.col("__words")).alias("__left")))
        pool = (order.join(crossing, "__key").where(F.col("__nth").between(F.col("__cross"), F.col("__cross") + CUT_BLOCKS - 1))
                .select("__key", "__block", "__left", "__cross", "target", copy))
        # Larger ones first (by doublings, then by hash): small ones are left to fill the gap.
        docs = (line.where("size > 0").select("__key", "__block", "__at", "size").join(pool, ["__key", "__block"])
                .groupBy("__key").agg(*[F.first(c).alias(c) for c in ("__left", "__cross", "target", "copy")],
                                      F.sort_array(F.collect_list(F.struct(
                                          (-F.floor(F.log2("size"))).alias("c"), F.xxhash64(F.lit(seed), "__at").alias("h"),
                                          F.col("__at").alias("at"), F.col("__block").alias("block"),
                                          F.col("size").alias("size")))).alias("__docs")))
        fitted = stored(docs.withColumn("__fit", F.expr(_FIT)).drop("__docs"), "mix-cut")
        draws = draws.unionByName(
            fitted.select("__key", "copy", F.inline("__fit.got")).groupBy("__key", F.col("block").alias("__block"), "copy")
            .agg(F.collect_list("at").alias("cut")).select("__key", "__block", "copy", "cut"))
        # Where one long document took the blocks' place, later blocks fill what is left.
        state = stored(fitted.where(F.col("__fit.left") > NEAR * F.col("target")).select(
            "__key", (F.col("__cross") + CUT_BLOCKS).alias("__from"), F.col("__fit.left").alias("__left")).join(
            order.select("__key", F.col("__nth").alias("__from"), F.col("__before").alias("__base")), ["__key", "__from"]),
            "mix-room")
        if state.isEmpty():
            return draws


#: The documents, in order, that fit into what is left.
_FIT = """aggregate(__docs, named_struct('left', __left, 'got', cast(array() as array<struct<at:bigint,block:bigint>>)),
    (s, d) -> if(d.size <= s.left,
                 named_struct('left', s.left - d.size, 'got', concat(s.got, array(named_struct('at', d.at, 'block', d.block)))), s))"""


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(pop: str, marked: str, draws: str, uniform: str) -> str:
    """SQL of the number of marked ones among ``draws`` of ``pop``, of which ``marked`` are: the inverse of ``uniform``.

    Chances relative to the mode's follow by ratios to both sides; the uniform number is used up
    from the mode to the right, then to the left.
    """
    right = "(a.k - x) * (a.n - x) / ((x + 1D) * (a.p - a.k - a.n + x + 1D))"
    left = "x * (a.p - a.k - a.n + x) / ((a.k - x + 1D) * (a.n - x + 1D))"
    up = "if(b.hi > b.m, sequence(b.m, b.hi - 1), cast(array() as array<bigint>))"
    down = "if(b.lo < b.m, sequence(b.m, b.lo + 1, -1L), cast(array() as array<bigint>))"

    def total(steps, ratio):
        return (f"aggregate({steps}, named_struct('p', 1D, 'z', 0D), (s, x) -> "
                f"named_struct('p', s.p * {ratio}, 'z', s.z + s.p * {ratio}), s -> s.z)")

    def walk(steps, ratio, start, move):
        return (f"aggregate({steps}, named_struct('p', 1D, 'v', {start}.v, 'x', {start}.x), (s, x) -> if(s.v < 0, s, "
                f"named_struct('p', s.p * {ratio}, 'v', s.v - s.p * {ratio}, 'x', if(s.v - s.p * {ratio} < 0, x {move}, s.x))))")

    spread = f"cast(ceil({DEVIATIONS} * sqrt(a.n * (a.k / a.p) * (1 - a.k / a.p) * (a.p - a.n) / greatest(a.p - 1, 1D))) + 9 as bigint)"
    begin = f"named_struct('v', a.u * (1 + {total(up, right)} + {total(down, left)}) - 1, 'x', b.m)"
    body = _let(begin, "c", _let(walk(up, right, "c", "+ 1"), "d", f"({walk(down, left, 'd', '- 1')}).x"))
    middle = "cast(floor((a.n + 1) * (a.k + 1) / (a.p + 2)) as bigint)"
    ends = _let(f"named_struct('m', {middle}, 'w', {spread})", "e",
                "named_struct('m', e.m, 'lo', greatest(cast(greatest(0D, a.n + a.k - a.p) as bigint), e.m - e.w), "
                "'hi', least(cast(least(a.n, a.k) as bigint), e.m + e.w))")
    args = (f"named_struct('p', cast({pop} as double), 'k', cast({marked} as double), "
            f"'n', cast({draws} as double), 'u', {uniform})")
    return f"if({pop} <= 0, 0L, {_let(args, 'a', _let(ends, 'b', body))})"


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(__key, shard, first, n): the run of each source's draws that a shard takes, from quotas (__key, q).

    The row of a node has its shards [lo, hi) and every source's quota; a level splits all
    nodes of more than one shard.  A shard's total is the difference of
    floor(shard * all / shards), so totals are equal but for one block.
    """
    spark = quotas.sparkSession
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("__key", "q"))).alias("s")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"),
        F.expr("transform(s, x -> x.__key)").alias("keys"), F.expr("transform(s, x -> x.q)").alias("q"),
        F.expr("transform(s, x -> 0L)").alias("first"))
    total = quotas.agg(F.sum("q")).first()[0] or 0
    for level in range((shards - 1).bit_length()):
        if level % 6 == 5:  # enough rows by now to deal out
            node = stored(node.repartition(2**level), "mix-tree")
        uniform = f"shiftrightunsigned(xxhash64({seed}L, lo, hi, i), 11) / 9007199254740992D"
        mid = "((lo + hi) div 2)"
        want = f"floor(cast({mid} as decimal(20,0)) * {total} / {shards}) - floor(cast(lo as decimal(20,0)) * {total} / {shards})"
        draw = hypergeometric("s.pop", "q[i]", "s.want", uniform)
        step = _let(draw, "h", "named_struct('want', s.want - h, 'pop', s.pop - q[i], 'left', concat(s.left, array(h)))")
        left = (f"aggregate(sequence(0, size(q) - 1), named_struct('want', cast({want} as bigint), "
                f"'pop', aggregate(q, 0L, (s, x) -> s + x), 'left', cast(array() as array<bigint>)), (s, i) -> {step}, s -> s.left)")
        node = node.withColumn("left", F.expr(f"if(hi - lo > 1 AND size(q) > 0, {left}, q)")).select(F.expr(
            f"inline(if(hi - lo > 1, array(named_struct('lo', lo, 'hi', {mid}, 'keys', keys, 'q', left, 'first', first), "
            f"named_struct('lo', {mid}, 'hi', hi, 'keys', keys, 'q', zip_with(q, left, (x, y) -> x - y), "
            "'first', zip_with(first, left, (x, y) -> x + y))), "
            "array(named_struct('lo', lo, 'hi', hi, 'keys', keys, 'q', q, 'first', first))))"))
    leaves = stored(node, "mix-leaves")
    return leaves.select(F.col("lo").cast("int").alias("shard"), F.inline(F.arrays_zip("keys", "first", "q"))).select(
        F.col("keys").alias("__key"), "shard", "first", F.col("q").alias("n")).where("n > 0")


def _in_shards(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """``drawn`` plus ``shard``: a source's draws in another permuted order, each shard's run by the tree."""
    order = drawn.withColumn("__mix", F.xxhash64(F.lit(seed + 1), "__key", "__block", "copy"))
    order = running(order, ["__key", "__mix", "__block", "copy"], {"__nth": F.lit(1)}, "mix-order")
    first = order.groupBy("__key").agg(F.min("__nth").alias("__n0"), F.count("*").alias("q"))
    runs = splitting_tree(stored(first, "mix-quotas"), shards, seed)
    # One row a draw, so that a source with a third of all draws is no hot key.
    slots = runs.select("__key", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("__slot"))
    return (order.join(first.drop("q"), "__key").withColumn("__slot", F.col("__nth") - F.col("__n0"))
            .join(slots, ["__key", "__slot"]).select("__key", "__block", "copy", "cut", "shard"))
