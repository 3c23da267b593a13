"""Training plans (query lifecycle A): linear model with inference and
diagnostics, random forest, and their metrics.

Data flow: cleaned comps -> hash split flag -> rare-category collapse
(fitted on the train rows, D13) -> engineered features -> column
transformer fitted on train -> design, written once because several passes
read it -> GRAM -> small algebra on the driver, level tables on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.finance import forward_target, inverse_target
from ..operators import features as FE
from ..operators import forest as FO
from ..operators import linear as L
from ..operators import ordered as O
from ..operators.aggregates import regression_metrics
from ..operators.sampling import seeded_hash32, split_flags
from ..operators.scoring import ForestModel, LinearModel, category_lookup
from ..session import stored


@dataclass
class LinearTraining:
    collapse: FE.RareCollapse
    transformer: FE.ColumnTransformerModel
    design: DataFrame               # source_row, is_test, label, order key, features
    ridge: L.RidgeModel
    gram: L.Gram
    ols: L.OLSResult
    ratio_mode: str = "train_linear"
    cost_nulls: str = "propagate"
    extras: dict = field(default_factory=dict)

    def train(self) -> DataFrame:
        return self.design.filter(~F.col("is_test"))

    def residuals(self) -> DataFrame:
        """The train rows plus ``resid`` of the OLS fit."""
        return self.ols.with_residual(self.train(), "label")

    def model(self) -> LinearModel:
        """The ridge fit as a scoring model."""
        ct, (category,) = self.transformer, self.transformer.categorical
        lookup, other = category_lookup(self.collapse.kept, self.ridge.effects, self.collapse.other)
        numeric = [(c, float(ct.medians[c]), *ct.scaling[c], float(b)) for c, b in zip(ct.kept_numeric, self.ridge.coef)]
        return LinearModel(numeric, float(self.ridge.intercept), category, stored(lookup, "lookup"), other,
                           self.ridge.transform, self.ratio_mode, self.cost_nulls)


def build_design(df: DataFrame, transform: str = "log1p", fit_on: str = "train",
                 ratio_mode: str = "train_linear", cost_nulls: str = "propagate", dummies: bool = False
                 ) -> tuple[FE.RareCollapse, FE.ColumnTransformerModel, DataFrame]:
    """Split, collapse rare cities, engineer, fit the transformer on train and
    store the design (label in transformed space): numeric columns and the city, or its dummies."""
    df = stored(split_flags(df), "split")  # several fitting passes read it
    fit_rows = df if fit_on == "all" else df.filter(~F.col("is_test"))
    collapse = FE.RareCollapse.fit(fit_rows, "city")
    pre = FE.preprocess(df, collapse, ratio_mode, cost_nulls)
    ct = FE.fit_column_transformer(pre.filter(~F.col("is_test")), dummies=dummies)
    design = pre.select(
        "source_row", "is_test",
        forward_target(C.TARGET_COL, transform).alias("label"),
        seeded_hash32("source_row").alias("order_key"),
        *(ct.columns() if dummies else ct.compact_columns()))
    return collapse, ct, stored(design, "design")


def train_linear(df: DataFrame, diagnostics: bool = True, ratio_mode: str = "train_linear",
                 cost_nulls: str = "propagate") -> LinearTraining:
    collapse, ct, design = build_design(df, "log1p", ratio_mode=ratio_mode, cost_nulls=cost_nulls)
    names, level = ct.numeric_names, f"cat__{ct.categorical[0]}"
    train = design.filter(~F.col("is_test"))
    g = L.gram(train, names, "label", level)
    ridge = L.ridge_loo(train, names, "label", g=g)
    res = L.ols(train, names, "label", cov_type="HC3", g=g)
    out = LinearTraining(collapse, ct, design, ridge, g, res, ratio_mode, cost_nulls)
    if diagnostics:
        resid = stored(out.residuals().select("order_key", "source_row", "resid"), "residuals")
        moments = L.residual_moments(resid, F.col("resid"))
        dw = O.durbin_watson(resid, F.col("resid"), ["order_key", "source_row"])["durbin_watson"]
        out.extras["summary"] = L.fit_summary(res, moments, dw, g)
    return out


def linear_predictions(t: LinearTraining) -> DataFrame:
    """MOD-3: log prediction as a literal dot product plus the city's effect, then the exact inverse."""
    return t.ridge.with_prediction(t.design, "pred_log").select(
        "source_row", "is_test", "label", "pred_log", inverse_target("label", "log1p").alias("y_dollars"),
        inverse_target("pred_log", "log1p").alias("pred_dollars"))


def split_metrics(pred: DataFrame) -> DataFrame:
    """MOD-4: R² / MAE / RMSE per split in log space and in dollars."""
    logm = regression_metrics(pred, "label", "pred_log", group="is_test").select(
        "is_test", "n", F.col("r2").alias("r2_log"), F.col("mae").alias("mae_log"),
        F.col("rmse").alias("rmse_log"))
    dol = regression_metrics(pred, "y_dollars", "pred_dollars", group="is_test").select(
        "is_test", F.col("r2").alias("r2_dollars"), F.col("mae").alias("mae_dollars"),
        F.col("rmse").alias("rmse_dollars"))
    return logm.join(dol, "is_test")


def metrics_by_split(pred: DataFrame) -> dict[str, dict[str, float]]:
    """MOD-4 as {train / test: {metric: value}}."""
    return {"test" if r["is_test"] else "train": {k: float(v) for k, v in r.asDict().items() if k != "is_test"}
            for r in split_metrics(pred).collect()}


# ---------------------------------------------------------------- MOD-2 forest
@dataclass
class ForestTraining:
    model: FO.Forest
    features: list[str]
    design: DataFrame               # key, dup, source_row, is_test, label, features
    collapse: FE.RareCollapse
    transformer: FE.ColumnTransformerModel

    @property
    def importances(self) -> dict[str, float]:
        return self.model.importances()

    def scorer(self) -> ForestModel:
        return ForestModel(self.model, self.collapse, self.transformer, features=self.features)


def train_forest(df: DataFrame, num_trees: int = C.FOREST_TREES, max_depth: int = C.FOREST_DEPTH,
                 max_bins: int = 64, seed: int = C.RANDOM_STATE, predict: bool = True) -> ForestTraining:
    """Random forest on log(target): bootstrap, all features per split (``operators.forest``).
    ``forest_predictions`` needs ``predict``.

    Forest features use the forest definitions (null-as-0 cost, ratio NULL
    -> 0) and the same fitted transformer as the linear model.
    """
    df = stored(split_flags(df), "split")
    collapse = FE.RareCollapse.fit(df.filter(~F.col("is_test")), "city")
    df = collapse.transform(df)
    df = df.withColumns({
        "total_cost": F.coalesce(F.col(C.PURCHASE_COL), F.lit(0.0))
        + F.coalesce(F.col(C.REHAB_COL), F.lit(0.0))})
    from ..functions.finance import rehab_ratio
    df = df.withColumn("rehab_ratio", rehab_ratio(C.PURCHASE_COL, C.REHAB_COL, "train_forest"))
    ct = FE.fit_column_transformer(df.filter(~F.col("is_test")))
    (category,) = ct.categorical
    design = stored(FO.with_keys(df.select("source_row", "is_test", forward_target(C.TARGET_COL, "log").alias("label"),
                                           *ct.compact_columns())), "forest-design")
    model = FO.fit(design, ct.numeric_names, f"cat__{category}", ct.categories[category], "label",
                   ~F.col("is_test"), num_trees, max_depth, max_bins, seed, predict)
    return ForestTraining(model, ct.feature_names, design, collapse, ct)


def forest_predictions(t: ForestTraining) -> DataFrame:
    return t.model.fitted(t.design, "pred_log").select(
        "source_row", "is_test", "label", "pred_log", inverse_target("label", "log").alias("y_dollars"),
        inverse_target("pred_log", "log").alias("pred_dollars"))
