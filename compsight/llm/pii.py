"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds: email, ip, card (Luhn), phone.  Added kind: iban (mod 97).  Every span
has a score: a kind's prior, raised by a checksum that holds and by a context word
near it, lowered by a word that speaks against it.  Base spans always stay; added
ones stay from ``MIN_SCORE`` up.  All patterns run in time linear in the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compsight.llm.rows import add_columns, forget, text_col

KINDS = ("email", "ip", "card", "phone", "iban")
MIN_SCORE = 0.5
#: Characters before and after a span in which context words count.
WINDOW = 40

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never begins inside a run of digits: it would have begun at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.3}
CHECKED = 0.3
NEAR = 0.2
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "client", "login"),
    "card": ("card", "visa", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
AGAINST = {
    "email": ("example",),
    "ip": ("version", "section", "release"),
    "card": ("order", "isbn", "serial", "tracking"),
    "phone": ("isbn", "serial"),
    "iban": ("serial", "part no"),
}
FOR_RE = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v)) + r")\b", re.I) for k, v in CONTEXT.items()}
AGAINST_RE = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v)) + r")\b", re.I) for k, v in AGAINST.items()}


def luhn(digits: str) -> bool:
    """Luhn's checksum over ASCII digits."""
    doubled = str.maketrans("0123456789", "0246813579")
    return (sum(map(int, digits[::-2])) + sum(map(int, digits[-2::-2].translate(doubled)))) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 over an IBAN without spaces."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@label.label..., found from each @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        else:
            done = at + 1  # nothing left of this @ can match any more
        at = text.find("@", done)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, end, kind number, score) of a whole text, by start and then kind; code points, end exclusive."""
    found: list[tuple[int, int, int, bool]] = []
    if "@" in text:
        found += [(s, e, 0, False) for s, e in _emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 if len(p) > 3 else int(p) <= 255
                   for p in m[0].split(".")):
                found.append((m.start(), m.end(), 1, False))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), 2, True))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), 3, False))
    for m in IBAN.finditer(text):
        s = m[0].replace(" ", "")
        if 15 <= len(s) <= 34 and mod97(s):
            found.append((m.start(), m.end(), 4, True))
    out = []
    for start, end, k, checked in found:
        kind = KINDS[k]
        around = text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW]
        score = PRIOR[kind] + CHECKED * checked + NEAR * bool(FOR_RE[kind].search(around)) \
            - NEAR * bool(AGAINST_RE[kind].search(around))
        score = round(min(1.0, max(0.0, score)), 3)
        if k < 4 or score >= MIN_SCORE:
            out.append((start, end, k, score))
    out.sort(key=lambda x: (x[0], x[2], x[1]))
    return out


def mask(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans, the first's kind."""
    if not spans:
        return text
    parts, at, open_end, kind = [], 0, -1, 0
    for start, end, k, _ in spans:
        if start >= open_end:
            if open_end >= 0:
                parts.append(f"[{KINDS[kind].upper()}]")
                at = open_end
            parts.append(text[at:start])
            open_end, kind = end, k
        else:
            open_end = max(open_end, end)
    return "".join([*parts, f"[{KINDS[kind].upper()}]", text[open_end:]])


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, text: str = "text", masked: str | None = None) -> DataFrame:
    """``docs`` plus ``pii`` (its spans by start and kind) and, if named, the ``masked`` text.

    Null texts are empty; they and texts without spans give an empty list, and a null
    text's mask is empty.  Whole texts are read; rows are independent.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                               ("end", pa.int32()), ("score", pa.float64())]))

    def make():
        forget()

        def fn(texts):
            rows = [(t, find_spans(t)) for t in texts.to_pylist()]
            spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, e, k, p in f]
                              for _, f in rows], kind)
            return [spans] + ([pa.array([mask(t, f) for t, f in rows], pa.string())] if masked else [])
        return fn
    fields = f"pii {SPAN}" + (f", `{masked}` string" if masked else "")
    return add_columns(docs, [text_col(docs, text)], fields, make)


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
