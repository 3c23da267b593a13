"""Comps source (SRC-1, SRC-2).

``load_comps`` reads a comps table from parquet / CSV / JSON / a catalog
table and gives it predictable column names and a parsed date.  The
latest-per-loan step is the separate operator ``clean.latest_per_id``;
``prepare_comps`` applies it to the full timestamps and keeps their days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import config as C
from ..functions.numeric import to_time
from ..functions.text import normalize_names
from ..session import path_exists


def pick_table(names: Sequence[str], prefixes: Sequence[str] = C.TABLE_PREFIXES) -> str:
    """SRC-2: first name whose lower-cased form starts with a prefix, else the first."""
    if not names:
        raise ValueError("no tables to choose from")
    for n in names:
        if n.lower().startswith(tuple(prefixes)):
            return n
    return names[0]


def pick_catalog_table(spark: SparkSession, database: str | None = None,
                       prefixes: Sequence[str] = C.TABLE_PREFIXES) -> str:
    """SRC-2 over the session catalog (tables and temp views, listing order)."""
    tables = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return pick_table([t.name for t in tables], prefixes)


def normalize_columns(df: DataFrame) -> DataFrame:
    """PRJ-1: rename every column to its normalised name (metadata only)."""
    return df.toDF(*normalize_names(df.columns))


def parse_known_dates(df: DataFrame, date_col: str = C.DATE_COL, keep_time: bool = False) -> DataFrame:
    """TS-1 on the known date column, if present: its day, or its timestamp with ``keep_time``."""
    if date_col not in df.columns:
        return df
    dtype = df.schema[date_col].dataType
    if isinstance(dtype, T.DateType):
        return df
    time = isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    parsed = df[date_col] if time else to_time(date_col)
    return df.withColumn(date_col, parsed if keep_time else parsed.cast("date"))


def load_comps(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None, options: dict[str, str] | None = None
               ) -> DataFrame:
    """SRC-1: read, normalise names, parse the date column.

    Raises ``FileNotFoundError`` when the path does not exist.  Give a
    ``schema`` for CSV/JSON so no inference pass runs over the data.
    """
    if fmt == "table":
        df = spark.table(path)
    else:
        if not path_exists(spark, path):
            raise FileNotFoundError(f"comps table not found: {path}")
        reader = spark.read.format(fmt).options(**(options or {}))
        if fmt == "csv":
            reader = reader.option("header", "true")
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.load(path)
    return parse_known_dates(normalize_columns(df))


def prepare_comps(df: DataFrame, tiebreak: str = "source_row") -> DataFrame:
    """Names, date parse and latest-per-loan, by date and time, on a raw frame."""
    from ..operators.clean import latest_per_id

    df = parse_known_dates(normalize_columns(df), keep_time=True)
    return parse_known_dates(latest_per_id(df, C.ID_COL, C.DATE_COL, tiebreak))
