"""Cleaning, filtering and de-duplication of the comps table.

DED-1, FLT-1..6, NUM-2, STR-S1, UNIT-1.  Every operator is ``DataFrame ->
DataFrame`` and usable with ``df.transform``.  The order the reference
applies them in matters and is kept by the plans: de-duplication first, so a
latest row that later fails a filter removes its id.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.numeric import to_number, to_number_strict
from ..functions.text import lower_strip, strip_text
from .schema import text_columns


# ---------------------------------------------------------------- DED-1
def latest_per_id(df: DataFrame, id_col: str = C.ID_COL, date_col: str = C.DATE_COL,
                  tiebreak: str = "source_row", within: Sequence[str] = ()) -> DataFrame:
    """Keep the latest row per id (and ``within`` columns that the id decides): date descending (NULL dates last), then the
    tiebreak column descending.  NULL ids form one group.  Without a date
    column the first row in tiebreak order is kept; without an id, no-op.

    Plan: ``row_number() == 1`` becomes a partial ``WindowGroupLimit`` before
    the hash exchange and a final one after it, so a hot id (or the NULL
    group) ships at most one row per map partition.
    """
    if id_col not in df.columns:
        return df
    if tiebreak not in df.columns:
        raise ValueError(f"latest_per_id needs a tiebreak column, {tiebreak!r} is absent")
    if date_col in df.columns:
        order = [F.col(date_col).desc_nulls_last(), F.col(tiebreak).desc()]
    else:
        order = [F.col(tiebreak).asc()]
    w = Window.partitionBy(*within, id_col).orderBy(*order)
    rn = "__rn"
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) == 1).drop(rn)


# ---------------------------------------------------------------- FLT-1 / STR-S1
def positive_target(df: DataFrame, target: str = C.TARGET_COL, strict: bool = False) -> DataFrame:
    """FLT-1: keep rows whose target is a number > 0 (value left as is).

    ``strict=True`` reproduces ``astype(float)``: non-numeric text raises
    (ANSI cast) instead of being dropped.
    """
    num = to_number_strict(target) if strict else to_number(target, df.schema[target].dataType)
    return df.filter(num > 0)


def strip_text_columns(df: DataFrame, missing_token: str | None = None,
                       cols: Sequence[str] | None = None) -> DataFrame:
    """STR-S1: strip white space on every text column (NULL kept unless a token is given)."""
    cols = text_columns(df) if cols is None else list(cols)
    return df.withColumns({c: strip_text(c, missing_token) for c in cols}) if cols else df


def basic_clean(df: DataFrame, target: str = C.TARGET_COL, strict: bool = False,
                missing_token: str | None = None) -> DataFrame:
    """FLT-1 then STR-S1, as the reference's first cleaning step."""
    return strip_text_columns(positive_target(df, target, strict), missing_token)


# ---------------------------------------------------------------- UNIT-1
def normalize_lot_area(df: DataFrame, value_col: str = C.LOT_VALUE_COL,
                       units_col: str = C.LOT_UNITS_COL) -> DataFrame:
    """Acres -> square feet; units lower-cased and stripped, acre rows become 'sqft';
    the value is coerced to a number everywhere.  No-op if a column is absent."""
    if value_col not in df.columns or units_col not in df.columns:
        return df
    units = lower_strip(units_col)
    is_acre = F.coalesce(units.contains("acre"), F.lit(False))
    value = to_number(value_col, df.schema[value_col].dataType)
    return df.withColumns({
        value_col: F.when(is_acre, value * F.lit(C.SQFT_PER_ACRE)).otherwise(value),
        units_col: F.when(is_acre, F.lit("sqft")).otherwise(units),
    })


# ---------------------------------------------------------------- FLT-2
def filter_eligible(df: DataFrame, target: str = C.TARGET_COL) -> DataFrame:
    """Coerce the target to a number, drop NULL and <= 0, store the number."""
    if target not in df.columns:
        return df
    num = to_number(target, df.schema[target].dataType)
    return df.withColumn(target, num).filter(F.col(target) > 0)


# ---------------------------------------------------------------- FLT-3
def _as_of_col(as_of: _dt.date | str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(str(as_of)).cast("date")


def filter_recent(df: DataFrame, months: int = C.MONTH_WINDOW,
                  as_of: _dt.date | str | Column | None = None,
                  date_col: str = C.DATE_COL) -> DataFrame:
    """Keep ``date >= as_of - months`` (calendar months, inclusive); NULL dates drop.

    No-op when the column is absent or holds no value at all.  The all-NULL
    rule is a scalar subquery (``count(date) = 0``) evaluated once per query.
    """
    if date_col not in df.columns:
        return df
    d = F.col(date_col)
    if not isinstance(df.schema[date_col].dataType, (T.DateType, T.TimestampType,
                                                    T.TimestampNTZType)):
        d = d.cast("date")
    cutoff = F.add_months(_as_of_col(as_of), -months)
    no_dates = df.agg(F.count(F.col(date_col)).alias("n")).scalar() == 0
    return df.filter((d >= cutoff) | no_dates)


# ---------------------------------------------------------------- FLT-5
def target_present(df: DataFrame, target: str = "label") -> DataFrame:
    return df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target)))


# ---------------------------------------------------------------- AGG-7/8, FLT-6
def column_profile(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, tuple[int, bool]]:
    """One aggregate pass: per column (non-null count, has more than one value)."""
    cols = list(df.columns if cols is None else cols)
    if not cols:
        return {}
    exprs = []
    for i, c in enumerate(cols):
        exprs += [F.count(F.col(c)).alias(f"n{i}"),
                  (F.min(F.col(c)) < F.max(F.col(c))).alias(f"v{i}")]
    row = df.agg(*exprs).first()
    return {c: (int(row[f"n{i}"]), bool(row[f"v{i}"])) for i, c in enumerate(cols)}


def drop_constant_columns(df: DataFrame, cols: Sequence[str] | None = None,
                          keep: Sequence[str] = ()) -> DataFrame:
    """FLT-6: drop all-NULL columns and columns with a single distinct value."""
    cols = [c for c in (df.columns if cols is None else cols) if c not in keep]
    prof = column_profile(df, cols)
    kept = [c for c in df.columns if c in keep or c not in prof or (prof[c][0] > 0 and prof[c][1])]
    return df.select(*kept)


# ---------------------------------------------------------------- NUM-2 / AGG-6
def parse_rates(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    """AGG-6: share of rows (NULLs included in the denominator) that parse as numbers."""
    cols = text_columns(df) if cols is None else list(cols)
    if not cols:
        return {}
    row = df.agg(*[F.avg(to_number(c).isNotNull().cast("double")).alias(f"r{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: float(row[f"r{i}"] or 0.0) for i, c in enumerate(cols)}


def coerce_text_columns(df: DataFrame, min_rate: float = C.NUMERIC_PARSE_RATE,
                        cols: Sequence[str] | None = None) -> DataFrame:
    """NUM-2: a text column becomes numeric when at least ``min_rate`` of it parses."""
    rates = parse_rates(df, cols)
    chosen = {c: to_number(c) for c, r in rates.items() if r >= min_rate}
    return df.withColumns(chosen) if chosen else df
