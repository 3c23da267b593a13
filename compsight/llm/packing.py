"""Best-two-fit packing of documents into sequences.

The plan needs the lengths only, and there are at most ``capacity`` of them: it is
made from the count of documents of each length.  A bin is filled greedily with
the longest documents that fit; then its smallest document may give way to two
unpacked ones that fit the widened gap more tightly.  A bin's pattern is repeated
as long as its lengths last, so the plan's size does not grow with the corpus.
Documents take their places by their rank among those of equal length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compsight.llm.bpe import byte_symbols
from compsight.llm.rows import add_columns, offsets_of, resident, text_col
from compsight.session import scratch_path

#: White space around a space that another pre-token may reach across.
ACROSS = re.compile(r"\s (?:\s|\Z)")
SPACE = re.compile(r"\s")
#: Letters of every Unicode version, then marks of ASCII: two pre-tokens.
LETTERS_THEN_MARK = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+)([!-/:-@\[-`{-~]+)")
#: Letters and marks that are such in every Unicode version.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
MARK = "!-/:-@\\[-`{-~\u00a1\u00ab\u00bb\u00bf\u2010-\u2027"
#: Kinds of characters; texts with any other are cut by the library.
OTHER, LETTERS, DIGITS, MARKS, BLANK = range(5)
#: Kind of each character up to the last mark.
KINDS = np.array([LETTERS if re.match(f"[{LETTER}]", c) else MARKS if re.match(f"[{MARK}]", c) else
                  DIGITS if c in "0123456789" else BLANK if c in " \n" else OTHER for c in map(chr, range(0x2028))], np.uint8)
#: Bytes of texts whose distinct pre-tokens are merged at once, and chunks of other texts that a worker remembers.
PART_CHARS = 1 << 22
MEMO_ENTRIES = 100_000
#: Words of usual texts that a worker remembers in each of two generations.
MEMO_WORDS = 50_000
#: Bytes of a word that is merged together with others.
SHORT = 24
#: Pieces without white space that are given to the library as the lines of one text.
LINES = 256


class Merges:
    """Byte-pair merges of many short words at once.

    Words are rows of a matrix of ids.  A step merges in every row the first pair of least
    rank, so the ids are those of merging one word after the other.
    """

    NONE = np.int32(2**31 - 1)
    SLOTS = 18

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Pairs by a hash with linear probing; ids fit 16 bits.
        self.pair = np.full(1 << self.SLOTS, 2**32 - 1, np.uint32)
        self.rank = np.full(1 << self.SLOTS, self.NONE, np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        for r, (k, s) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.rank[s] != self.NONE:
                s = (s + 1) & ((1 << self.SLOTS) - 1)
            self.pair[s], self.rank[s] = k, r

    @staticmethod
    def fits(spec: dict) -> bool:
        """Is this a plain byte-level vocabulary with fewer than 2^16 ids and few enough merges for the table?"""
        m = spec["model"]
        return (m.get("type") == "BPE" and not any(m.get(k) for k in (
            "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
            and spec.get("normalizer") is None and len(m["vocab"]) < 1 << 16 and len(m["merges"]) < 1 << 17)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> np.uint32(32 - self.SLOTS)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where there is no merge."""
        keys = (left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)).ravel()
        at = self._slot(keys)
        out = np.where(self.pair[at] == keys, self.rank[at], self.NONE)
        open_ = np.flatnonzero((out == self.NONE) & (self.rank[at] != self.NONE))
        at = at[open_]
        while len(open_):
            at = (at + np.uint32(1)) & np.uint32((1 << self.SLOTS) - 1)
            here = self.rank[at]
            out[open_] = np.where(self.pair[at] == keys[open_], here, self.NONE)
            on = (here != self.NONE) & (out[open_] == self.NONE)
            open_, at = open_[on], at[on]
        return out.reshape(left.shape)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (``SHORT`` bytes at most) as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        blob = np.frombuffer(b"".join(words), np.uint8)
        for low, width in ((0, 8), (8, 14), (14, SHORT)):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for lo in range(0, len(rows), 8192):
                part = rows[lo:lo + 8192]
                raw = blob[np.minimum(starts[part] + np.arange(width)[:, None], len(blob) - 1)]
                ids, kept = self._merged(self.first[raw], sizes[part])
                flat = ids.T[kept.T].astype("<u4").tobytes()
                ends = (4 * np.cumsum(kept.sum(0))).tolist()
                for i, a, b in zip(part.tolist(), [0, *ends], ends):
                    out[i] = flat[a:b]
        return out

    def _merged(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` (a word a column, of ``n`` symbols) after all merges, and which of them are left."""
        width, words = ids.shape
        # A last line stands for the place before a word and after it.  What was merged stays, its neighbours pass it by.
        line = np.arange(width + 1, dtype=np.int32)[:, None]
        kept = line[:-1] < n
        ids = np.concatenate((ids, np.zeros((1, words), ids.dtype))).ravel()
        right = np.where(line + 1 < n, line + 1, width).astype(np.int32).ravel()
        left = np.repeat(np.where(line > 0, line - 1, width).astype(np.int32), words)
        # Rank and place in one number, so that the least is the first pair of least rank.
        best = np.full((width + 1) * words, self.NONE, np.int32)
        at = np.flatnonzero(line[1:-1] < n)
        best[at] = self._ranked(ids[at], ids[at + words], at // words)
        alive = kept.ravel()
        while True:
            least = best.reshape(width + 1, words).min(0)
            col = np.flatnonzero(least != self.NONE)
            if not len(col):
                return ids.reshape(width + 1, words)[:-1], kept
            least = least[col]
            j = least & 31
            at = j * words + col
            made = self.made[least >> 5]
            gone = right[at] * words + col
            after, before = right[gone], left[at]
            next_, last = after * words + col, before * words + col
            ids[at], right[at], left[next_], best[gone], alive[gone] = made, after, j, self.NONE, False
            rank = self._ranked(np.concatenate((made, ids[last])), np.concatenate((ids[next_], made)),
                                np.concatenate((j, before)))
            rank[np.concatenate((after, before)) == width] = self.NONE
            best[at], best[last] = rank[:len(j)], rank[len(j):]

    def _ranked(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.ranks(left, right)
        return np.where(rank == self.NONE, rank, rank << 5 | place).astype(np.int32)


def kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 text belongs to."""
    out = KINDS[:256][raw]
    if len(raw) and raw.max() < 128:
        return out
    out[raw > 127] = OTHER
    for first, last, size, bits in ((0xC0, 0xDF, 2, 0x1F), (0xE0, 0xEF, 3, 0x0F)):
        at = np.flatnonzero((raw >= first) & (raw <= last))
        code = (raw[at] & bits).astype(np.int32)
        for k in range(1, size):
            code = code << 6 | (raw[at + k] & 0x3F)
        kind = np.where(code < len(KINDS), KINDS[np.minimum(code, len(KINDS) - 1)], OTHER)
        for k in range(size):
            out[at + k] = kind
    return out


def pre_tokens(raw: np.ndarray, kind: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of usual texts begin, as the byte-level pattern of the library cuts them.

    `` ?[letters]+``, ``'(?:s|t|re|ve|m|ll|d)`` where a mark may begin, `` ?[digits]+``, `` ?[marks]+``, or blanks;
    the last blank before another character stands alone or, if it is a space, leads the next pre-token.
    """
    start = np.ones(len(raw), bool)
    blank, change = kind == BLANK, kind[1:] != kind[:-1]
    start[1:] = change & ((raw[:-1] != 32) | blank[1:])
    start[:-1] |= blank[:-1] & change
    first = np.unique(offs[:-1][np.diff(offs) > 0])
    # The last blank of a text leads nothing in the next one.
    last = np.setdiff1d(first[1:] - 1, first)
    start[last[blank[last] & blank[last - 1]]] = False
    start[first] = True

    at = np.flatnonzero((raw == 39) & start)
    if len(at):
        end = np.append(first, len(raw))[np.searchsorted(first, at, side="right")]
        one, two = (np.where(at + k < end, raw[np.minimum(at + k, len(raw) - 1)], 0) for k in (1, 2))
        short = np.isin(one, list(b"stmd"))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        size = np.where(short, 2, np.where(long, 3, 0))
        at, end, size = at[size > 0], end[size > 0], size[size > 0]
        start[at + 1] = False
        start[(at + size)[at + size < end]] = True
    return np.flatnonzero(start)


class WordIds:
    """Ids of whole texts by the tokenizers library, or equal to them.

    Texts of usual characters are cut into pre-tokens here, as the library's pattern does; the
    distinct ones are merged many at a time (``Merges``), long ones by the library.  Short
    ones are remembered in two generations: a word in use moves to the younger, and when that is
    full the older goes.  Other texts have a memo of space-separated chunks:

    A byte-level pattern begins a new pre-token at a space before a non-space, so
    a text's ids are those of its chunks in turn.  Texts where white space meets
    a space in another way, or with a special token, go to the library whole.
    In the same way a line feed between two non-spaces is a pre-token of its own:
    a chunk is learnt from its lines, and new pieces are encoded as lines of one text.
    A memo key begins with NUL where no space precedes.
    """

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.feed = self._ids(["\n"])[0]
        plain = json.loads(spec)
        self.merges = Merges(plain["model"]) if Merges.fits(plain) else None
        self.memo: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _pieces(chunk: str) -> list[str] | None:
        """Memo keys of a chunk's pieces, a line feed's between its lines; None if white space stands in another way."""
        lead, out = "", []
        for line in chunk.split("\n"):
            if line in ("", "\0") or SPACE.search(line):
                return None
            if out:
                out.append("\0\n")
                lead = "\0"
            start = 1 if line[0] == "\0" else 0
            m = LETTERS_THEN_MARK.fullmatch(line, start)
            if m:
                out += [lead + line[:m.end(1)], "\0" + m[2]]
            else:
                out.append(lead + line)
        return out

    def _learn(self, missing: set[str]) -> None:
        memo = self.memo
        if len(memo) + len(missing) > MEMO_ENTRIES:
            memo.clear()
        memo["\0\n"] = self.feed
        cut = {c: self._pieces(c) for c in missing}
        odd = [c for c, parts in cut.items() if parts is None]
        memo.update(zip(odd, self._ids([c[1:] if c[:1] == "\0" else " " + c for c in odd])))
        need = list({p for parts in cut.values() if parts for p in parts if p not in memo})
        self._lines([c[1:] if c[0] == "\0" else " " + c for c in need], memo, need)
        for c, parts in cut.items():
            if parts and len(parts) > 1:
                memo[c] = b"".join([memo[p] for p in parts])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ends = offsets_of(texts).astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out: list[bytes] = [b""] * len(texts)
        odd, lo = [], 0
        while lo < len(texts):
            hi = min(len(texts), max(lo + 1, int(np.searchsorted(ends, ends[lo] + PART_CHARS))))
            part, offs = raw[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo]
            kind = kinds(part)
            usual = self._usual(part, kind, offs)
            if not usual.all():
                odd += (lo + np.flatnonzero(~usual)).tolist()
                sizes = np.diff(offs)
                of_usual = np.repeat(usual, sizes)
                part, kind = part[of_usual], kind[of_usual]
                offs = np.concatenate(([0], np.cumsum(sizes[usual])))
            for i, ids in zip((lo + np.flatnonzero(usual)).tolist(), self._part(part, kind, offs)):
                out[i] = ids
            lo = hi
        for i, ids in zip(odd, self._odd(texts.take(pa.array(odd, pa.int64())).to_pylist())):
            out[i] = ids
        return out

    def _usual(self, raw: np.ndarray, kind: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Whether each text has usual characters only and no special token."""
        out = np.ones(len(offs) - 1, bool)
        out[np.searchsorted(offs, np.flatnonzero(kind == OTHER), side="right") - 1] = False
        blob = raw.tobytes()
        for s in map(str.encode, self.special):
            if s in blob:
                out &= [s not in blob[lo:hi] for lo, hi in zip(offs.tolist(), offs[1:].tolist())]
        return out

    def _part(self, raw: np.ndarray, kind: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of usual texts, one after the other in ``raw``."""
        if not len(raw):
            return [b""] * (len(offs) - 1)
        starts = pre_tokens(raw, kind, offs)
        bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        words = pa.StringArray.from_buffers(len(starts), bounds, pa.py_buffer(raw)).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, long = self._known(set(distinct))
        ids = list(map(known.__getitem__, distinct))
        for w in long:
            del known[w]
        # A text has fewer than 2^31 bytes and no more ids than bytes.
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)).astype(np.int32) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        word = words.indices.to_numpy()
        n = sizes[word]
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=ends[1:])
        from_ = np.repeat(at[word] - ends[:-1], n)
        from_ += np.arange(ends[-1], dtype=np.int32)
        got = flat[from_].tobytes()
        cuts = (4 * ends[np.searchsorted(starts, offs)].astype(np.int64)).tolist()
        return [got[a:b] for a, b in zip(cuts, cuts[1:])]

    def _known(self, tokens: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of each of ``tokens`` and of others that are remembered, and those too long to stay there."""
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, {}
        new = tokens.difference(self.young)
        words = new.difference(self.old)
        again = new - words
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        # A set keeps its order: each word beside its bytes.
        raw = list(map(str.encode, words))
        small = [self.merges is not None and len(r) <= SHORT for r in raw]
        short, long = list(compress(words, small)), [w for w, is_short in zip(words, small) if not is_short]
        self.young.update(zip(short, self.merges(list(compress(raw, small))) if short else []))
        blank = list(filter(str.isspace, long))
        self.young.update(zip(blank, self._ids(blank)))
        self._lines([w for w in long if not w.isspace()], self.young)
        return self.young, long

    def _lines(self, need: list[str], memo: dict[str, bytes], keys: list[str] | None = None) -> None:
        """Ids of pieces without white space but a leading space, encoded as the lines of a few texts."""
        keys, width = keys or need, len(self.feed)
        feed = np.frombuffer(self.feed, "<u4")[0]
        for lo in range(0, len(need), LINES):
            raw = self._ids(["\n".join(need[lo:lo + LINES])])[0]
            ends = np.flatnonzero(np.frombuffer(raw, "<u4") == feed) * 4
            at = 0
            for c, end in zip(keys[lo:lo + LINES], ends.tolist() + [len(raw)]):
                memo[c] = raw[at:end]
                at = end + width

    def _odd(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with other characters, by a memo of their space-separated chunks."""
        out: list[bytes | None] = [None] * len(texts)
        get, whole, later = self.memo.get, [], []
        missing: set[str] = set()
        for i, t in enumerate(texts):
            if "\0" in t or ACROSS.search(t) or any(s in t for s in self.special):
                whole.append(i)
                continue
            chunks = t.split(" ")
            chunks[0] = "\0" + chunks[0]
            ids = list(map(get, chunks))
            try:
                out[i] = b"".join(ids)
            except TypeError:  # a chunk is new
                new = [(j, c) for j, c in enumerate(chunks) if ids[j] is None]
                missing.update([c for _, c in new])
                later.append((i, ids, new))
        if missing:
            self._learn(missing)
        for i, ids, new in later:
            for j, c in new:
                ids[j] = self.memo[c]
            out[i] = b"".join(ids)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = ids
        return out


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """``docs`` with ``pieces``: a list of (start, length, ids_crc32[, ids]) per document.

    A document is its ids and then ``end_id``, so it has at least one token (null and
    empty texts: just that).  One longer than ``capacity`` is cut into full pieces at
    its end; the first piece holds the rest.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = [("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64())]
    kind += [("ids", pa.list_(pa.int32()))] if with_ids else []
    end = np.asarray([end_id], "<u4").tobytes()

    def make():
        words = resident(f"word ids {hash(spec.value)}", lambda: WordIds(spec.value))

        def pieces(raw: bytes) -> list[dict]:
            raw += end
            n, out = len(raw) // 4, []
            lo, hi = 0, (n - 1) % capacity + 1
            while lo < n:
                part = raw[4 * lo:4 * hi]
                p = {"start": lo, "length": hi - lo, "crc": zlib.crc32(part)}
                out.append(p | {"ids": np.frombuffer(part, "<u4").astype(np.int32)} if with_ids else p)
                lo, hi = hi, hi + capacity
            return out

        def fn(texts):
            return [pa.array([pieces(r) for r in words.encode(texts)], pa.list_(pa.struct(kind)))]
        return fn
    fields = "pieces array<struct<start:long,length:int,crc:long" + (",ids:array<int>>>" if with_ids else ">>")
    return add_columns(docs, [text_col(docs, text)], fields, make)


class Lengths:
    """Unpacked documents by length, with the largest length at most x in a few steps."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = [0] * (capacity + 1)
        for length, n in counts.items():
            self.count[length] += n
        self.have = sum(1 << length for length, n in enumerate(self.count) if n)

    def at_most(self, x: int) -> int:
        """0 if there is none."""
        if x <= 0:
            return 0
        return (self.have & ((2 << x) - 1)).bit_length() - 1 if self.have & ((2 << x) - 1) else 0

    def take(self, length: int, n: int = 1) -> None:
        self.count[length] -= n
        if not self.count[length]:
            self.have &= ~(1 << length)

    def put(self, length: int, n: int = 1) -> None:
        self.count[length] += n
        self.have |= 1 << length


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit: (lengths of a bin, longest first; number of such bins)."""
    left, plan = Lengths(counts, capacity), []
    while left.have:
        pattern, gap = [], capacity
        while (x := left.at_most(gap)):
            left.take(x)
            pattern.append(x)
            gap -= x
        if gap and len(pattern) > 1:
            small = pattern[-1]
            wide, best = gap + small, (small, 0, 0)
            # The two may be any unpacked lengths but must leave less than the one did.
            mask = left.have & ((1 << wide) - 1)
            while mask:
                a = mask.bit_length() - 1
                if 2 * a < best[0]:
                    break
                mask &= ~(1 << a)
                b = left.at_most(min(a, wide - a))
                if b == a and left.count[a] < 2:
                    b = left.at_most(min(a - 1, wide - a))
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == wide:
                        break
            if best[1]:
                left.put(small)
                left.take(best[1])
                left.take(best[2])
                pattern[-1:] = [best[1], best[2]]
        need = Counter(pattern)
        times = 1 + min(left.count[x] // n for x, n in need.items())
        for x, n in need.items():
            if times > 1:
                left.take(x, n * (times - 1))
        plan.append((pattern, times))
    return plan


def place_table(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, bins, first bin, offset, copies): which ranks of a length go where.

    Ranks first + i + copies * k (i under bins, k under copies) go to bin first bin + i,
    place offset + k * length.
    """
    used: Counter = Counter()
    rows, base = [], 0
    for pattern, times in plan:
        at = 0
        for x, n in sorted(Counter(pattern).items(), reverse=True):
            rows.append((x, used[x], times, base, at, n))
            used[x] += n * times
            at += n * x
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null ids, equal ids and repeated rows are packed like any other; an empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    got = (token_pieces(slim, path, capacity, end_id).drop("text")
           .select("doc_id", F.posexplode("pieces").alias("piece", "p"))
           .select("doc_id", "piece", "p.*", F.spark_partition_id().alias("pid"),
                   F.monotonically_increasing_id().alias("seq")))
    # Texts are encoded once; ranks and places work on this table of a few numbers a piece.
    out = scratch_path(spark, "pieces")
    got.write.parquet(out)
    pieces = spark.read.parquet(out)

    # Ranks within a length: per-partition counts, their running sums, ranks inside a partition.
    per = pieces.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    inside = Window.partitionBy("length", "pid").orderBy("seq")
    ranked = (pieces.withColumn("in_pid", F.row_number().over(inside) - 1)
              .join(first, ["length", "pid"])
              .withColumn("rank", F.col("first_rank") + F.col("in_pid")))

    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = place_table(plan_bins(counts, capacity))
    places = spark.sparkContext.broadcast(table)  # at most a few rows for each pair of lengths
    fields = "doc_id, piece, start, length, crc, rank"
    schema = (f"doc_id {dict(slim.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, "
              "sequence_id long, offset long")

    def place(batches):
        t = places.value
        key = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            n = b.column(3).to_numpy().astype(np.int64)
            rank = b.column(5).to_numpy()
            row = t[np.searchsorted(key, n << 44 | rank, side="right") - 1]
            i = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n), b.column(4),
                 pa.array(row[:, 3] + i % row[:, 2]), pa.array(row[:, 4] + i // row[:, 2] * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.selectExpr(*fields.split(", ")).mapInArrow(place, schema)
