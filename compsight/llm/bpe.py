"""Byte-pair encoding by backtracking, decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token at every
position of a word.  The encoder walks left to right and takes the longest
token whose pair with the token before it is compatible, which means that
merging in rank order would not have joined the two in another way; where no
token fits it steps back.  Dead positions are marked, so a word costs linear
time, and the result is exactly that of the ranked merges.

Works for a vocabulary of the ``tokenizers`` library with byte-level symbols, a
word-end suffix, NFC + lower-case normalisation and merges listed in id order.
The vocabulary file's content is broadcast (its size does not depend on the data).
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from compsight.llm.rows import MEMO_ENTRIES, add_columns, text_col

# Fixed value: the vocabulary's pre-tokenisation pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts with other characters are normalised and cut by the tokenizers library itself,
#: whose Unicode tables may be of another version than Python's.
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r -~\xa0-\u017f‐-‧‹›€]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [sign[b] for b in range(256)]


class OffsetTable:
    """Byte strings by id: one blob, and the offset where each begins; ``cut`` has them cut out once."""

    def __init__(self, items: list[bytes]):
        self.blob = b"".join(items)
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in items]))).tolist()
        self.cut = [self.blob[lo:hi] for lo, hi in zip(self.starts, self.starts[1:])]

    def joined(self, ids: list[int], by: bytes) -> bytes:
        return by.join(map(self.cut.__getitem__, ids))


class Bpe:
    """Encoder and decoder of one vocabulary; see the module's text."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if not suffix:
            raise ValueError("the vocabulary has no word-end suffix")
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        by_id = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.texts = OffsetTable([by_id.get(i, "").encode() for i in range(max(by_id) + 1)])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None

        signs = byte_symbols()
        self.inner = [vocab[s] for s in signs]
        self.final = [vocab[s + suffix] for s in signs]
        symbols = {chr(i): i for i in self.inner + self.final}
        spelled = {i: chr(i) for i in symbols.values()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        last = -1
        for m in model["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            if t <= last or a >= t or b >= t:
                raise ValueError("merges are not in the order of ids")
            last = t
            self.merged[a, b] = t
            self.split[t] = (a, b)
            spelled[t] = spelled[a] + spelled[b]
        self.size = {t: len(s) for t, s in spelled.items()}
        self.pairs: dict[int, bool] = {}
        #: Longest token that is a proper prefix of each token, or -1.
        self.prefix = dict.fromkeys(spelled, -1)
        self.automaton = self._automaton(spelled)
        # A token that ranked merges do not make of its own symbols never occurs.
        lost = [t for t, s in spelled.items() if len(s) > 1 and self._walk(s) != [t]]
        if lost:
            spelled = {t: s for t, s in spelled.items() if t not in set(lost)}
            self.automaton = self._automaton(spelled)
        self.library = Tokenizer.from_str(spec)
        self.byte_at = {s: b for b, s in enumerate(signs)}
        self.words: dict[bytes, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}

    def _automaton(self, spelled: dict[int, str]):
        a, by_text = ahocorasick.Automaton(), {s: t for t, s in spelled.items()}
        for t, s in spelled.items():
            a.add_word(s, (len(s) - 1, t))
            self.prefix[t] = next((by_text[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_text), -1)
        a.make_automaton()
        return a

    def _compatible(self, a: int, b: int) -> bool:
        """Would ranked merges leave the border between tokens a and b alone?

        The two are taken apart again, latest merge first; at every step the tokens
        that meet at the border must not have a merge earlier than the one undone.
        """
        split, merged = self.split, self.merged
        bound = 1 << 62
        while True:
            t = merged.get((a, b))
            if t is not None and t < bound:
                return False
            # The later merge of the two is undone; of equal ones the right one is later.
            if a > b:
                if a in split:
                    bound, a = a, split[a][1]
                elif b in split:
                    bound, b = b + 1, split[b][0]
                else:
                    return True
            elif b in split:
                bound, b = b + 1, split[b][0]
            elif a in split:
                bound, a = a, split[a][1]
            else:
                return True

    def _walk(self, s: str) -> list[int]:
        n = len(s)
        longest = [-1] * (n + 1)
        for end, (back, t) in self.automaton.iter(s):
            longest[end - back] = t  # ends rise, so the longest comes last
        size, prefix, pairs = self.size, self.prefix, self.pairs
        live = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, t = 0, longest[0]
        while pos < n or t >= 0:
            if t < 0:
                t = longest[pos]
            before = out[-1] if out else -1
            while t >= 0:
                end = pos + size[t]
                if live[end]:
                    if before < 0:
                        break
                    key = before << 20 | t
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) > 4 * MEMO_ENTRIES:
                            pairs.clear()
                        fits = pairs[key] = self._compatible(before, t)
                    if fits:
                        break
                t = prefix[t]
            if t >= 0:
                out.append(t)
                pos, t = end, -1
            else:
                live[pos] = 0
                t = out.pop()
                pos -= size[t]
        return out

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        got = self.words.get(raw)
        if got is None:
            inner = self.inner
            s = "".join([chr(inner[b]) for b in raw[:-1]]) + chr(self.final[raw[-1]])
            if len(self.words) > MEMO_ENTRIES:
                self.words.clear()
            got = self.words[raw] = self._walk(s)
        return got

    def _lists(self, text: str) -> list[list[int]]:
        """Ids of a text without special tokens, in a list per run of non-space characters."""
        if UNUSUAL.search(text):
            at = self.byte_at
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [self.word(bytes([at[x] for x in piece])) for piece, _ in cut if piece]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        parts = text.lower().split()
        chunks = self.chunks
        try:
            return [chunks[c] for c in parts]
        except KeyError:
            pass
        if len(chunks) > MEMO_ENTRIES:
            chunks.clear()
        for c in parts:
            if c not in chunks:
                found = WORDS.findall(c)
                chunks[c] = self.word(found[0].encode()) if len(found) == 1 else \
                    list(chain.from_iterable([self.word(w.encode()) for w in found]))
        return [chunks[c] for c in parts]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special tokens written in it become their ids."""
        if self.cut is not None and "<" in text and self.cut.search(text):
            lists: list[list[int]] = []
            for k, part in enumerate(self.cut.split(text)):
                lists += [[self.special[part]]] if k % 2 else self._lists(part)
        else:
            lists = self._lists(text)
        return np.fromiter(chain.from_iterable(lists), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: their tokens joined by spaces, as the vocabulary has no decoder."""
        return self.texts.joined(ids.tolist(), b" ")


_LOADED: dict[int, Bpe] = {}


def _loaded(spec: str) -> Bpe:
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` plus ``ids array<int>``: the whole text (null: empty) encoded; empty texts give no ids."""
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        bpe = _loaded(spec.value)

        def fn(texts):
            return [_id_lists([bpe.encode(t) for t in texts.to_pylist()])]
        return fn
    return add_columns(docs, [text_col(docs, text)], "ids array<int>", make)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` plus ``ids array<int>`` and ``decoded string``, the text that those ids decode to.

    Null and empty texts give no ids and an empty text.  Rows are independent:
    repeated rows give equal results, an empty table an empty one.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        bpe = _loaded(spec.value)

        def fn(texts):
            rows = [bpe.encode(t) for t in texts.to_pylist()]
            return [_id_lists(rows), pa.array([bpe.decode(r) for r in rows], pa.binary()).cast(pa.string())]
        return fn
    return add_columns(docs, [text_col(docs, text)], "ids array<int>, decoded string", make)


def _id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
