"""Feature engineering as fit -> small parameter object -> transform (FEAT-1..9).

Fitting runs a few aggregate jobs and keeps O(features) numbers; categories stay
tables at any count, joined as the planner sees fit.  Numeric parameters are literals
of one ``select``, which stays in whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.finance import rehab_ratio, total_cost
from ..functions.numeric import to_number
from ..session import stored
from .clean import coerce_text_columns, column_profile
from .quantiles import column_medians

# ---------------------------------------------------------------- FEAT-1
@dataclass
class RareCollapse:
    """Values seen fewer than ``min_count`` times (and NULL) become ``other``; ``kept`` (value) is a stored table."""

    col: str
    kept: DataFrame
    min_count: int = C.RARE_MIN_COUNT
    other: str = C.CITY_DEFAULT

    @classmethod
    def fit(cls, df: DataFrame, col: str, min_count: int = C.RARE_MIN_COUNT,
            other: str = C.CITY_DEFAULT) -> RareCollapse:
        counts = (df.filter(F.col(col).isNotNull()).groupBy(col)
                  .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
                  .select(F.col(col).cast("string").alias("value")))
        return cls(col, stored(counts, "kept"), min_count, other)

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        hits = self.kept.select(F.col("value").alias("__kept"))
        return (df.join(hits, F.col(f"`{self.col}`") == F.col("__kept"), "left")
                .withColumn(out or self.col, F.coalesce(F.col("__kept"), F.lit(self.other))).drop("__kept"))


def preprocess(df: DataFrame, collapse: RareCollapse | None = None,
               ratio_mode: str = "train_linear", cost_nulls: str = "propagate") -> DataFrame:
    """FEAT-2 (+ FEAT-1 when a fitted collapse is given): engineered columns."""
    if collapse is not None:
        df = collapse.transform(df)
    if C.PURCHASE_COL in df.columns and C.REHAB_COL in df.columns:
        df = df.withColumns({
            "total_cost": total_cost(C.PURCHASE_COL, C.REHAB_COL, nulls=cost_nulls),
            "rehab_ratio": rehab_ratio(C.PURCHASE_COL, C.REHAB_COL, mode=ratio_mode)})
    return df


# ---------------------------------------------------------------- FEAT-3..5
def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """FEAT-3: exact medians (no single-task buffer; see ``quantiles``)."""
    return column_medians(df, cols)


def fit_scaling(df: DataFrame, cols: Sequence[str],
                fill: dict[str, float | None] | None = None) -> dict[str, tuple[float, float]]:
    """FEAT-4: (mean, population std; 0 -> 1) of each column after imputation."""
    fill = fill or {}
    exprs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        if fill.get(c) is not None:
            x = F.coalesce(x, F.lit(float(fill[c])))
        exprs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*exprs).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (float(m or 0.0), float(s) if s not in (None, 0.0) else 1.0)
    return out


def most_frequent(df: DataFrame, col: str):
    """FEAT-5: most frequent non-NULL value, ties -> smallest value.

    Partial counts per value, then a top-1 (no per-group value buffer)."""
    top = (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), F.col(col).asc()).limit(1).collect())
    return top[0][col] if top else None


# ---------------------------------------------------------------- FEAT-6
def fit_categories(df: DataFrame, col: str, fill=None) -> list:
    """Sorted distinct values (after imputation): the names of dummy columns.  Models do not need
    them (``linear`` takes the category column itself)."""
    c = F.col(col) if fill is None else F.coalesce(F.col(col), F.lit(fill))
    vals = df.select(c.alias("__v")).filter(F.col("__v").isNotNull()).distinct().collect()
    return sorted(r["__v"] for r in vals)


def one_hot_columns(col: str, categories: Sequence, prefix: str | None = None,
                    drop_first: bool = True, fill=None) -> list[Column]:
    """FEAT-6: one double column per category (first dropped); unknown -> all 0."""
    c = F.col(col) if fill is None else F.coalesce(F.col(col), F.lit(fill))
    cats = list(categories)[1:] if drop_first else list(categories)
    prefix = prefix if prefix is not None else f"{col}_"
    return [F.coalesce((c == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{prefix}{v}")
            for v in cats]


def one_hot_vector(df: DataFrame, col: str, out: str = "onehot") -> DataFrame:
    """FEAT-6 for many categories: sparse vector of (categories - 1) slots in
    sorted order; the first category, NULL and unknown values are all zeros."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import array_to_vector

    idx = StringIndexer(inputCol=col, outputCol="__idx", stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df)
    last = len(idx.labels) - 1
    if last < 1:
        return df.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    # The encoder drops its last slot: the first category and NULL (index last + 1) go there.
    i = F.col("__idx")
    slots = idx.transform(df).withColumn(
        "__idx", F.when((i == 0) | (i > last), F.lit(float(last))).otherwise(i - 1))
    enc = OneHotEncoder(inputCols=["__idx"], outputCols=[out], dropLast=True).fit(slots)
    return enc.transform(slots).drop("__idx")


# ---------------------------------------------------------------- FEAT-7
@dataclass
class ColumnTransformerModel:
    """Fitted numeric (median impute + standardise) and categorical (mode impute) blocks, every other
    column dropped.  ``columns`` gives ``num__<c>`` and one dummy ``cat__<c>_<value>`` for each category but the
    first, ``compact_columns`` the category itself as ``cat__<c>``."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float | None] = field(default_factory=dict)
    scaling: dict[str, tuple[float, float]] = field(default_factory=dict)
    modes: dict[str, object] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)

    @property
    def kept_numeric(self) -> list[str]:
        # an all-NULL column has no median and is dropped (as sklearn does)
        return [c for c in self.numeric if self.medians.get(c) is not None]

    @property
    def numeric_names(self) -> list[str]:
        return [f"num__{c}" for c in self.kept_numeric]

    @property
    def feature_names(self) -> list[str]:
        names = self.numeric_names
        for c in self.categorical:
            names += [f"cat__{c}_{v}" for v in self.categories[c][1:]]
        return names

    def numeric_columns(self) -> list[Column]:
        out = []
        for c in self.kept_numeric:
            m, s = self.scaling[c]
            x = F.coalesce(F.col(c).cast("double"), F.lit(float(self.medians[c])))
            out.append(((x - F.lit(m)) / F.lit(s)).alias(f"num__{c}"))
        return out

    def columns(self) -> list[Column]:
        out = self.numeric_columns()
        for c in self.categorical:
            out += one_hot_columns(c, self.categories[c], prefix=f"cat__{c}_",
                                   fill=self.modes.get(c))
        return out

    def compact_columns(self) -> list[Column]:
        return self.numeric_columns() + [
            F.coalesce(F.col(c), F.lit(self.modes.get(c)).cast("string")).alias(f"cat__{c}") for c in self.categorical]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *self.columns())


def fit_column_transformer(df: DataFrame, numeric: Sequence[str] = tuple(C.NUMERIC_FEATURES),
                           categorical: Sequence[str] = tuple(C.CATEGORICAL_FEATURES), dummies: bool = True
                           ) -> ColumnTransformerModel:
    """``dummies=False`` leaves out the lists of category names, which only dummy columns need."""
    numeric, categorical = list(numeric), list(categorical)
    medians = fit_medians(df, numeric)
    kept = [c for c in numeric if medians.get(c) is not None]
    scaling = fit_scaling(df, kept, medians)
    modes = {c: most_frequent(df, c) for c in categorical}
    cats = {c: fit_categories(df, c, modes[c]) for c in categorical} if dummies else {}
    return ColumnTransformerModel(numeric, categorical, medians, scaling, modes, cats)


# ---------------------------------------------------------------- FEAT-8
@dataclass
class DesignMatrixModel:
    """Ad-hoc design matrix: numeric coercion (NUM-2), dummies (first level
    dropped) of the remaining text columns, all-NULL and constant columns
    dropped, NULL -> median -> 0."""

    numeric: list[str]
    dummies: dict[str, list]
    fills: dict[str, float]

    @property
    def feature_names(self) -> list[str]:
        return list(self.fills)

    def columns(self) -> list[Column]:
        exprs = {}
        for c in self.numeric:
            exprs[c] = to_number(c) if c in self.numeric else F.col(c)
        for c, cats in self.dummies.items():
            for v in cats[1:]:
                exprs[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("double"),
                                               F.lit(0.0))
        return [F.coalesce(exprs[n], F.lit(self.fills[n])).alias(n) for n in self.fills]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *self.columns())


def fit_design_matrix(df: DataFrame, cols: Sequence[str]) -> DesignMatrixModel:
    sub = coerce_text_columns(df.select(*cols))
    text = [f.name for f in sub.schema.fields if isinstance(f.dataType, T.StringType)]
    numeric = [c for c in cols if c not in text]
    dummies = {c: fit_categories(sub, c) for c in text}
    exprs = {c: to_number(c) for c in numeric}
    for c, cats in dummies.items():
        for v in cats[1:]:
            exprs[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
    wide = df.select(*[e.alias(n) for n, e in exprs.items()])
    prof = column_profile(wide)
    usable = [n for n in exprs if prof[n][0] > 0 and prof[n][1]]
    med = fit_medians(wide, [n for n in usable if n in numeric])  # dummies are never NULL
    fills = {n: float(med[n]) if med.get(n) is not None else 0.0 for n in usable}
    return DesignMatrixModel(numeric, dummies, fills)


# ---------------------------------------------------------------- FEAT-9
def scoring_features(req: DataFrame, unknown: str = "impute", city: str = "other",
                     ratio_mode: str = "score", cost_nulls: str = "zero") -> DataFrame:
    """Feature row per scoring request (address, beds, baths, sf, purchase, rehab).

    unknown='impute': fields the form lacks are NULL (imputed by the model);
    unknown='zero': they are 0 (not imputed).  city='other' sends 'Other',
    city='from_address' applies the address rule (STR-S4).
    """
    from ..functions.numeric import zero_if_null
    from ..functions.text import city_bucket

    fill = F.lit(None).cast("double") if unknown == "impute" else F.lit(0.0)
    if unknown not in ("impute", "zero"):
        raise ValueError("unknown must be 'impute' or 'zero'")
    city_col = F.lit(C.CITY_DEFAULT) if city == "other" else city_bucket("address")
    return req.select(
        "*",
        zero_if_null("sf").alias("square_footage"), zero_if_null("beds").alias("bed"),
        zero_if_null(F.col("baths")).alias("__baths"),
        fill.alias("dom"), fill.alias("lot_area_value"), fill.alias("year_built"),
        fill.alias("school_score"),
        total_cost("purchase", "rehab", nulls=cost_nulls).alias("total_cost"),
        rehab_ratio("purchase", "rehab", mode=ratio_mode).alias("rehab_ratio"),
        city_col.alias("city"),
    ).drop("baths").withColumnRenamed("__baths", "baths")
