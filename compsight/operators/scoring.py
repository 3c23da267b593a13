"""Scoring (query lifecycle B): FEAT-9 -> fitted model (MOD-3) -> exact inverse
transform -> guard-rail (FIN-5) -> loan sizing (FIN-6/7/8).

A model in memory and one loaded from the store (``sources.artifacts``) are the same objects with
the same numbers, so they score alike to the bit.  A linear model is literals and one table of
category effects that is joined; the same function scores a batch or a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.finance import clamp_value, inverse_target, size_loan
from .features import ColumnTransformerModel, RareCollapse, scoring_features
from .forest import Forest
from .linear import linear_expr


@dataclass
class LinearModel:
    """``numeric`` has (column, median, mean, scale, weight) in order; ``lookup`` (value, effect) the category
    values that have an effect of their own, any other or no value has ``other``."""

    numeric: list[tuple[str, float, float, float, float]]
    intercept: float
    category: str
    lookup: DataFrame
    other: float
    transform: str = "log1p"
    ratio_mode: str = "train_linear"
    cost_nulls: str = "propagate"
    model_type: str = "RidgeLOO"
    version: str = "unsaved"

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` plus the predicted transformed target."""
        spec = ColumnTransformerModel([n[0] for n in self.numeric], [], {n[0]: n[1] for n in self.numeric},
                                      {n[0]: (n[2], n[3]) for n in self.numeric})
        side = self.lookup.select(F.col("value").alias("__value"), F.col("effect").alias("__effect"))
        rows = df.select("*", *spec.numeric_columns()).join(side, F.col(f"`{self.category}`") == F.col("__value"), "left")
        numeric = linear_expr(spec.numeric_names, [n[4] for n in self.numeric], self.intercept)
        return rows.withColumn(name, numeric + F.coalesce(F.col("__effect"), F.lit(self.other))).drop(
            "__value", "__effect", *spec.numeric_names)


@dataclass
class ForestModel:
    """A fitted forest, its categories and the transformer and names of its columns."""

    forest: Forest
    collapse: RareCollapse
    transformer: ColumnTransformerModel
    transform: str = "log"
    ratio_mode: str = "train_forest"
    cost_nulls: str = "zero"
    model_type: str = "RandomForestRegressor"
    version: str = "unsaved"
    features: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        (category,) = self.transformer.categorical
        wide = self.collapse.transform(df, "__category")
        mode = F.lit(self.transformer.modes.get(category)).cast("string")
        columns = [*self.transformer.numeric_columns(), F.coalesce(F.col("__category"), mode).alias(f"cat__{category}")]
        scored = self.forest.predict(wide.select("*", *columns), name)
        return scored.drop("__category", f"cat__{category}", *self.transformer.numeric_names)


def score_requests(req: DataFrame, model: LinearModel | ForestModel, policy: str = "ltv",
                   unknown: str = "impute", city: str = "other") -> DataFrame:
    """Score requests (address, beds, baths, sf, purchase, rehab) with a model, by the ratio and cost
    rules that it was trained with."""
    feats = scoring_features(req.withColumn("__baths0", F.col("baths")), unknown=unknown, city=city,
                             ratio_mode=model.ratio_mode, cost_nulls=model.cost_nulls)
    raw = inverse_target("__pred", model.transform)
    cost = (F.coalesce(F.col("purchase"), F.lit(0.0)) + F.coalesce(F.col("rehab"), F.lit(0.0)))
    given = [F.col("__baths0").alias("baths") if c == "baths" else F.col(f"`{c}`") for c in req.columns]
    scored = model.predict(feats, "__pred").select(*given, raw.alias("arv_raw"), cost.alias("__cost"))
    scored = scored.withColumnRenamed("__cost", "total_cost")
    cl = clamp_value("arv_raw", "total_cost")
    scored = scored.select("*", *[v.alias(k) for k, v in cl.items()])
    loan = size_loan("arv", "purchase", "rehab", policy)
    loan.pop("total_cost", None)
    return scored.select("*", *[v.alias(k) for k, v in loan.items()],
                         F.lit(model.model_type).alias("model_type"),
                         F.lit(model.version).alias("model_version"))


def category_lookup(kept: DataFrame, effects: DataFrame, other: str = C.CITY_DEFAULT) -> tuple[DataFrame, float]:
    """(value, effect) of every kept value, and the effect of all others, which are ``other``."""
    side = effects.select(F.col("level").alias("value"), "effect")
    rest = side.filter(F.col("value") == F.lit(other)).select("effect").collect()
    return (kept.join(side, "value", "left").select("value", F.coalesce("effect", F.lit(0.0)).alias("effect")),
            float(rest[0]["effect"]) if rest else 0.0)
