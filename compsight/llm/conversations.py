"""Conversation repair by alignment to the strings of an alternating grammar.

A repaired conversation's role initials are empty or ``s?(ua)+``.  The turns of
a conversation are aligned (Wagner-Fischer) to the grammar's string of each
feasible length; the best cost so far bounds which lengths and which diagonals
(Ukkonen's band) can still matter, and among equal costs the backtraced audits
are compared.  Turns are numbered over the whole table and cut by a grid into
pieces of ``PIECE`` turns, so no conversation has to fit a task: a piece is
aligned from each state of the grammar that it can start in to each that it can end in,
and pieces are chained ``FAN`` at a time.  Audits of equal cost and ends are never
prefixes of one another, so the least chain is made of least pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compsight.llm.ordering import running, stored

#: Turns of a piece; pieces chained at once.
PIECE, FAN = 32, 32
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: States of the grammar: nothing yet, and after a letter.
NOTHING, AFTER = 0, {"s": 1, "u": 2, "a": 3}
LEGAL = {"su", "ua", "au"}
_SPACE = r"\x20\x09-\x0D"
_PATHS = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
_PIECE = ("key string, piece long, first_at long, blank long, duplicate long, truncated long, illegal long, "
          f"head string, tail string, paths {_PATHS}")


# ------------------------------------------------------------------ damage of the query's rows
def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text), each row damaged as crc32 of ``conv_id:turn`` modulo 20 says.

    0 drops it, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user.
    Nulls count as one space in the key, in roles and in texts; ids and turns stay null.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(F.encode(key, "UTF-8")) % 20, F.coalesce(F.col("text"), space)
    return (turns.where(kind != 0).select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy"))
        .drop("__copy"))


# ------------------------------------------------------------------ alignment of one piece
def _way(i: int, f: int) -> int:
    """Least cost of moving from diagonal ``i`` to diagonal ``f``."""
    return INSERT_COST * (f - i) if f > i else DELETE_COST * (i - f)


def wagner_fischer(turns: str, target: str, limit: int) -> tuple[int, str] | None:
    """Least cost, at most ``limit``, of turning ``turns`` into ``target``, and its ASCII-least audit.

    A turn is its initial (``s u a``, ``o`` for any other), a capital if it is truncated, or ``-``
    if it must go.  Costs of suffixes are filled inside the band of diagonals that a cost
    of ``limit`` can reach; the audit is read off from the front.
    """
    n, m = len(turns), len(target)
    if _way(0, m - n) > limit:
        return None
    low = high = 0
    while _way(0, low - 1) + _way(low - 1, m - n) <= limit and low > -n:
        low -= 1
    while _way(0, high + 1) + _way(high + 1, m - n) <= limit and high < m:
        high += 1
    low, high = min(low, m - n), max(high, m - n)
    far = limit + 1
    rows: list[dict[int, int]] = [{} for _ in range(n + 2)]

    def edits(i: int, j: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            yield DELETE, DELETE_COST, i + 1, j
        if j < m and target[j] != "s":
            yield INSERT, INSERT_COST, i, j + 1
        if i < n and j < m and turns[i] != "-":
            cut = TRUNCATED_COST if turns[i].isupper() else 0
            if turns[i].lower() == target[j]:
                yield KEEP, cut, i + 1, j + 1
            if target[j] != "s":
                yield REROLE, REROLE_COST + cut, i + 1, j + 1

    for i in range(n, -1, -1):
        row = rows[i]
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            row[j] = 0 if i == n and j == m else min(
                (c + rows[a].get(b, far) for _, c, a, b in edits(i, j)), default=far)
    cost = rows[0].get(0, far)
    if cost > limit:
        return None
    i = j = 0
    audit = []
    while (i, j) != (n, m):
        # DELETE, INSERT, KEEP, REROLE: in ASCII order.
        letter, _, i, j = next(e for e in edits(i, j) if e[1] + rows[e[2]].get(e[3], far) == rows[i][j])
        audit.append(letter)
    return cost, "".join(audit)


def targets(entry: int, most: int) -> Iterator[tuple[int, str]]:
    """(exit state, letters) of every string of at most ``most`` letters that the grammar may go on with."""
    yield entry, ""
    for start in ("s", "") if entry == NOTHING else ("",):
        turn = "au" if entry == AFTER["u"] else "ua"
        for length in range(1, most + 1):
            text = (start + turn * length)[:length]
            if not (start and length == 1 and not text.startswith("s")):
                yield AFTER[text[-1]], text


@lru_cache(maxsize=1 << 12)
def align(turns: str) -> tuple[tuple[int, int, int, str], ...]:
    """(entry, exit, cost, audit): the best alignment of a piece for all ends."""
    gone = turns.count("-")
    stay = len(turns) - gone
    out = []
    for entry in range(4):
        best: dict[int, tuple[int, str]] = {}
        by_need = sorted(targets(entry, 2 * len(turns) + 3), key=lambda t: (_way(0, len(t[1]) - stay), t[1]))
        for end, text in by_need:
            if end == NOTHING and text:
                continue
            least = DELETE_COST * gone + _way(0, len(text) - stay)
            limit = best[end][0] if end in best else DELETE_COST * len(turns) + INSERT_COST * len(text)
            if least > limit:
                continue
            got = wagner_fischer(turns, text, limit)
            if got and (end not in best or got < best[end]):
                best[end] = got
        out += [(entry, end, *got) for end, got in sorted(best.items())]
    return tuple(out)


def chain(pieces: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The paths of pieces in a row."""
    done = {(a, b): (c, t) for a, b, c, t in pieces[0]}
    for piece in pieces[1:]:
        new: dict[tuple[int, int], tuple[int, str]] = {}
        for (a, b), (c, t) in done.items():
            for x, y, d, u in piece:
                if x == b and ((a, y) not in new or (c + d, t + u) < new[a, y]):
                    new[a, y] = c + d, t + u
        done = new
    return [(a, b, c, t) for (a, b), (c, t) in sorted(done.items())]


# ------------------------------------------------------------------ tables
def number_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(key, conv_id, turn, role, text, at, initial, mark) of every turn, stored.

    ``at`` numbers all turns by conversation, turn (nulls first), role and text.  Null roles and texts
    are one space; other columns are not read.  ``mark`` is the first fault: ``b`` blank
    (only spaces), ``d`` duplicate (role and text occur before it), ``t`` truncated (the last
    character that is no space is none of ``.!?``) or empty.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.coalesce(F.concat(F.lit("a"), F.col(f"`{conv_col}`").cast("string")), F.lit("b")).alias("key"),
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), space).alias("text"))
    rows = running(rows, ["key", F.col("turn").asc_nulls_first(), "role", "text"], {"at": F.lit(1)}, "turns")
    # The first of equal turns by its number, which is unique: no text is a hot join key.
    first = rows.groupBy("key", "role", F.md5("text").alias("h")).agg(F.min("at").alias("at")).select(
        "at", F.lit(True).alias("new"))
    last = F.regexp_extract("text", rf"([^{_SPACE}])[{_SPACE}]*\z", 1)
    mark = (F.when(last == "", F.lit("b")).when(F.col("new").isNull(), F.lit("d"))
            .when(~last.isin(".", "!", "?"), F.lit("t")).otherwise(F.lit("")))
    letter = F.substring("role", 1, 1)
    return stored(rows.join(first, "at", "left").select(
        "key", "conv_id", "turn", "role", "text", "at",
        F.when(letter.isin("s", "u", "a"), letter).otherwise(F.lit("o")).alias("initial"), mark.alias("mark")), "numbered")


def audit(numbered: DataFrame) -> DataFrame:
    """One row a conversation: key, first_at, gaps, counts of faults, illegal neighbours, cost and audit (stored)."""
    turn = (F.when(F.col("mark").isin("b", "d"), F.lit("-")).when(F.col("mark") == "t", F.upper("initial"))
            .otherwise(F.col("initial")))
    one = F.struct("at", turn.alias("turn"), "initial", "mark")
    pieces = (numbered.groupBy("key", F.floor(F.col("at") / F.lit(PIECE)).cast("long").alias("piece"))
              .agg(F.sort_array(F.collect_list(one)).alias("rows"))
              .select("key", "piece", F.col("rows")[0]["at"].alias("first_at"),
                      F.array_join("rows.turn", "").alias("turn"), F.array_join("rows.initial", "").alias("initial"),
                      F.array_join("rows.mark", "").alias("marks")).mapInArrow(_align_pieces, _PIECE))
    pieces = stored(pieces, "pieces")
    sizes = pieces.groupBy("key").agg(F.min("piece").alias("p0"), F.max("piece").alias("p1"))
    pieces = pieces.join(sizes, "key").withColumn("piece", F.col("piece") - F.col("p0")).drop("p0", "p1")
    left = sizes.agg(F.max(F.col("p1") - F.col("p0") + 1)).first()[0] or 0
    cols = [c.split()[0] for c in _PIECE.split(", ")]
    while left > 1:
        group = F.floor(F.col("piece") / F.lit(FAN)).cast("long")
        pieces = stored(pieces.groupBy("key", group.alias("piece")).agg(
            F.sort_array(F.collect_list(F.struct(*cols[1:]))).alias("parts"))
            .mapInArrow(_chain_pieces, _PIECE), "chained")
        left = -(-left // FAN)
    ends = F.filter("paths", lambda p: (p["entry"] == NOTHING) & p["exit"].isin(NOTHING, AFTER["a"]))
    best = F.array_min(F.transform(ends, lambda p: F.struct(p["cost"], p["audit"])))
    known = F.col("turn").isNotNull()
    gaps = numbered.where(known).groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    return stored(pieces.select(*cols[:1], *cols[2:7], best.alias("best")).join(gaps, "key", "left").select(
        "key", "first_at", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")), "audits")


def _illegal(initials: str) -> int:
    return sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))


def _align_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["key"], r["piece"], r["first_at"], r["marks"].count("b"), r["marks"].count("d"), r["marks"].count("t"),
                 _illegal(r["initial"]), r["initial"][0], r["initial"][-1], align(r["turn"])) for r in batch.to_pylist()]
        yield _pieces(rows)


def _chain_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = r["parts"]
            joints = sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(parts, parts[1:]))
            paths = chain([[(p["entry"], p["exit"], p["cost"], p["audit"]) for p in x["paths"]] for x in parts])
            rows.append((r["key"], r["piece"], parts[0]["first_at"], *[sum(x[c] for x in parts) for c in (
                "blank", "duplicate", "truncated")], joints + sum(x["illegal"] for x in parts),
                parts[0]["head"], parts[-1]["tail"], paths))
        yield _pieces(rows)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    path = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(path)]
    names = [c.split()[0] for c in _PIECE.split(", ")]
    cols = list(zip(*rows)) or [()] * len(names)
    cols[-1] = [[dict(zip(("entry", "exit", "cost", "audit"), p)) for p in paths] for paths in cols[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def repaired_turns(numbered: DataFrame, audits: DataFrame) -> DataFrame:
    """(key, place, edit, role, text): the conversations' turns after their edits, ``place`` in order, not gapless.

    Inserted turns have an empty text; deleted ones are not there.
    """
    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                at, letter = r["first_at"], ""
                for place, edit in enumerate(r["audit"]):
                    if edit != DELETE:
                        new = {"u": "assistant", "": "user"}.get(letter, "user")
                        keeps_s = edit == KEEP and not letter and r["opens"] == at
                        letter = "s" if keeps_s else new[0]
                        out.append((r["key"], place, None if edit == INSERT else at, edit, None if edit == KEEP else new))
                    at += edit != INSERT
                    if len(out) >= 1 << 14:
                        yield _steps(out)
                        out = []
        yield _steps(out)

    # The turn that a system turn opens the conversation with: the first kept one, if its initial is s.
    first = F.locate(KEEP, "audit") - 1
    before = F.substring_index("audit", KEEP, 1)
    opening = audits.select(
        "key", "first_at", "audit",
        F.when((first >= 0) & (F.translate(before, "RI", "") == before),
               F.col("first_at") + first).alias("opens_at"))
    heads = numbered.where("initial = 's'").select(F.col("at").alias("opens_at"), F.col("at").alias("opens"))
    edits = opening.join(heads, "opens_at", "left").select("key", "first_at", "audit", "opens").mapInArrow(
        steps, "key string, place long, at long, edit string, new_role string")
    turns = numbered.select("at", "role", "text")
    return edits.join(turns, "at", "left").select(
        "key", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _steps(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      ["key", "place", "at", "edit", "new_role"])


def digests(turns: DataFrame, line: Column) -> DataFrame:
    """(key, sha256) of the conversations' lines joined by line feeds.

    The hash of a text needs its bytes one after another: a conversation is read as a sorted
    stream in one task, which holds one line and the state of the hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, out = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        out.append(state.hexdigest())
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"\n" + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], ["key", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "sha256"])

    rows = turns.select("key", "place", line.alias("line")).repartition("key").sortWithinPartitions("key", "place")
    return rows.select("key", "line").mapInArrow(run, "key string, sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audits of ``turns`` (conv_id, turn, role, text) and their repaired turns.

    A null conversation id is a conversation.  Equal turn numbers follow role and text; repeated rows are
    duplicates.  No turns, no rows.  Turns may be of any number and length.
    """
    numbered = number_turns(turns)
    audits = audit(numbered)
    return audits, repaired_turns(numbered, audits)
