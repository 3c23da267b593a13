"""Schema operators (PRJ-2..6).  All decided at plan time from ``df.schema``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


def require_columns(df: DataFrame, cols: Sequence[str], where: str = "") -> None:
    """PRJ-4: raise listing what is there when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{where or 'operator'}: missing columns {missing}; "
                         f"have {sorted(df.columns)}")


def add_missing_columns(df: DataFrame, cols: Sequence[str],
                        dtype: T.DataType = T.DoubleType()) -> DataFrame:
    """PRJ-3: absent columns appear as typed NULL."""
    absent = [c for c in cols if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(dtype) for c in absent}) if absent else df


def allow_list(df: DataFrame, cols: Sequence[str] | None = None,
               keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-2: project the feature allow-list in its fixed order (plus ``keep``)."""
    cols = list(cols) if cols is not None else C.NUMERIC_FEATURES + C.CATEGORICAL_FEATURES
    require_columns(df, cols, "allow_list")
    return df.select(*keep, *cols)


def split_target(df: DataFrame, target: str = C.TARGET_COL,
                 cols: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-5: label first, then the features (one frame, Spark keeps rows aligned)."""
    cols = list(cols) if cols is not None else C.NUMERIC_FEATURES + C.CATEGORICAL_FEATURES
    require_columns(df, [target, *cols], "split_target")
    return df.select(*keep, F.col(target).alias("label"), *cols)


def text_columns(df: DataFrame) -> list[str]:
    """PRJ-6: names of the string-typed columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
