"""Type coercion as JVM column expressions (NUM-1, TS-1, FIN-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text a pandas-style numeric parser accepts: optional sign, decimal or
# scientific notation, or inf/infinity.  Spark alone would also accept
# '12d' / '12f' (Java float suffixes) and 'nan', which must become NULL.
NUMBER_PATTERN = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"

# Unicode-aware leading / trailing white space (str.strip semantics).
EDGE_SPACE = r"(?U)^\s+|\s+$"

DEFAULT_DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss",
                        "yyyy-MM-dd'T'HH:mm:ss")


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_space(c: Column | str) -> Column:
    """Remove Unicode white space at both ends; NULL stays NULL."""
    return F.regexp_replace(_as_col(c), EDGE_SPACE, "")


def nan_to_null(c: Column | str) -> Column:
    c = _as_col(c)
    return F.when(~F.isnan(c), c)


def to_number(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Coerce to double, unparseable -> NULL (``to_numeric(errors='coerce')``).

    ``dtype`` is the source column type when known; numeric sources are only
    cast (NaN -> NULL), text goes through the guard pattern and ``try_cast``.
    """
    c = _as_col(c)
    if dtype is not None and isinstance(dtype, T.NumericType):
        return nan_to_null(c.cast("double"))
    s = strip_space(c.cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def to_number_strict(c: Column | str) -> Column:
    """``astype(float)`` semantics: raise on text that is not a number (ANSI cast)."""
    return strip_space(_as_col(c).cast("string")).cast("double")


def to_time(c: Column | str, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Parse text to TIMESTAMP trying each format in turn; no format matches -> NULL."""
    s = strip_space(_as_col(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])


def to_date(c: Column | str, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """The day of ``to_time``."""
    return to_time(c, formats).cast("date")


def zero_if_null(c: Column | str) -> Column:
    """``x or 0``: NULL (and NaN) -> 0.0."""
    c = _as_col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)


def null_if_zero(c: Column | str) -> Column:
    """``replace(0, NaN)`` for a divisor."""
    c = _as_col(c)
    return F.when(c != 0, c)
