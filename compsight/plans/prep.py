"""The comps preparation plan (query lifecycle A, first five stages).

load (names, date) -> latest per loan -> positive target + strip -> lot area
-> eligible -> recent window.  All lazy: Catalyst sees one plan of scan ->
aggregate/join -> window -> project/filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..functions.finance import rehab_ratio, total_cost
from ..operators import clean
from ..sources import standins
from ..sources.comps import normalize_columns, parse_known_dates, prepare_comps

DEFAULT_AS_OF = "2001-08-01"


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_known_dates(normalize_columns(standins.comps(spark, sf_dir)))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_comps(standins.comps(spark, sf_dir))


def clean_frame(df: DataFrame, as_of: str | None = DEFAULT_AS_OF, recent: bool = True,
                months: int = C.MONTH_WINDOW) -> DataFrame:
    """Reference cleaning order on an already de-duplicated frame."""
    df = clean.basic_clean(df)
    df = clean.normalize_lot_area(df)
    df = clean.filter_eligible(df)
    if recent:
        df = clean.filter_recent(df, months=months, as_of=as_of)
    return df


def cleaned(spark: SparkSession, sf_dir: str, as_of: str | None = DEFAULT_AS_OF,
            recent: bool = True) -> DataFrame:
    return clean_frame(latest(spark, sf_dir), as_of=as_of, recent=recent)


def engineer(df: DataFrame, ratio_mode: str = "train_linear",
             cost_nulls: str = "propagate") -> DataFrame:
    """FEAT-2: total_cost and rehab_ratio from purchase and rehab."""
    return df.withColumns({
        "total_cost": total_cost(C.PURCHASE_COL, C.REHAB_COL, nulls=cost_nulls),
        "rehab_ratio": rehab_ratio(C.PURCHASE_COL, C.REHAB_COL, mode=ratio_mode),
    })


def features(spark: SparkSession, sf_dir: str, as_of: str | None = DEFAULT_AS_OF,
             ratio_mode: str = "train_linear", cost_nulls: str = "propagate") -> DataFrame:
    return engineer(cleaned(spark, sf_dir, as_of), ratio_mode, cost_nulls)
