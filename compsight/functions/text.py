"""Text expressions (PRJ-1 names, STR-S1..S5)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CITY_DEFAULT, CITY_RULES
from .numeric import strip_space

_RUN = re.compile(r"[a-z0-9]+")


def normalize_name(name: object) -> str:
    """Column-name normalisation: the lower-cased alphanumeric runs, joined by ``_``."""
    return "_".join(_RUN.findall(str(name).lower()))


def normalize_names(names: Sequence[object]) -> list[str]:
    """Normalise a list of names; collisions get ``_2``, ``_3`` suffixes."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for n in names:
        base = normalize_name(n) or "col"
        k = seen.get(base, 0) + 1
        seen[base] = k
        out.append(base if k == 1 else f"{base}_{k}")
    return out


def strip_text(c: Column | str, missing_token: str | None = None) -> Column:
    """``astype(str).str.strip()``; NULL stays NULL unless a token is given."""
    c = F.col(c) if isinstance(c, str) else c
    s = strip_space(c)
    return s if missing_token is None else F.coalesce(s, F.lit(missing_token))


def lower_strip(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(strip_space(c))


def city_bucket(address: Column | str, rules: Sequence[tuple[str, str]] = CITY_RULES,
                default: str = CITY_DEFAULT) -> Column:
    """First rule whose needle occurs in the lower-cased address; else ``default``."""
    a = F.lower(F.col(address) if isinstance(address, str) else address)
    expr = None
    for needle, label in rules:
        cond = a.contains(needle)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else F.coalesce(expr.otherwise(F.lit(default)), F.lit(default))


def day_key(ts_text: Column | str) -> Column:
    """First ten characters of an ISO timestamp text; NULL/empty -> NULL."""
    t = F.col(ts_text) if isinstance(ts_text, str) else ts_text
    return F.when(F.length(t) > 0, F.substring(t, 1, 10))


def iso_text(ts: Column | str) -> Column:
    """``datetime.isoformat()`` of a timestamp: microseconds only when non-zero."""
    t = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(t, "SSSSSS")
    return F.when(frac == "000000", whole).otherwise(F.concat(whole, F.lit("."), frac))
