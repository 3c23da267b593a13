"""Model store (SNK-3, SRC-4, SRC-5).

A model is a folder of tables on the shared file system.  Linear: ``numeric`` (position, column, median, mean,
scale, weight), ``categories`` (value, effect).  Forest: ``model`` (``trees``, ``thresholds``, ``forest``),
``numeric``, ``kept`` (value), ``categories`` (position, value), ``features`` (position, name).  Both: ``params`` (name, number or text),
``metrics`` (split, metric, value), ``diagnostics`` (test, feature, statistic, value) and ``meta`` (one JSON record).

``publish`` writes a model into a folder of its own under a store and then one numbered pointer
file that names it; readers follow the pointer of the highest number.  A publication that ends early
leaves no pointer, a later one never changes what an earlier one wrote, and old versions can be loaded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import ColumnTransformerModel, RareCollapse
from ..operators.forest import Forest
from ..operators.scoring import ForestModel, LinearModel
from ..session import hadoop_path, path_exists

META_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("artifact_subdir", T.StringType()),
    T.StructField("r2_train", T.DoubleType()),
    T.StructField("r2_test", T.DoubleType()),
    T.StructField("r2_train_log", T.DoubleType()),
    T.StructField("r2_test_log", T.DoubleType()),
    T.StructField("significance", T.StructType([
        T.StructField("n_obs", T.LongType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("adj_r2", T.DoubleType()),
        T.StructField("significant_features", T.ArrayType(T.StringType())),
        T.StructField("pvalues", T.MapType(T.StringType(), T.DoubleType())),
    ])),
    T.StructField("feature_sets", T.StructType([
        T.StructField("numeric", T.ArrayType(T.StringType())),
        T.StructField("categorical", T.ArrayType(T.StringType())),
    ])),
])


#: What a model is scored by besides its numbers.
RULES = ("transform", "ratio_mode", "cost_nulls", "model_type")
Diagnostics = Iterable[tuple[str, str | None, str, float | None]]
_NUMERIC = "position int, column string, median double, mean double, scale double, weight double"


_PARAMS = "name string, number double, text string"


def _table(spark: SparkSession, rows: list, schema: str, path: str) -> None:
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]
    # From pandas: a local relation, which no Python worker has to produce.
    df = spark.createDataFrame(pd.DataFrame(rows, columns=names, dtype=object), schema) if rows else spark.createDataFrame([], schema)
    df.coalesce(1).write.parquet(path)


def _common(spark: SparkSession, path: str, model, meta: dict, metrics: dict, diagnostics: Diagnostics) -> None:
    _table(spark, [(s, m, v) for s, of in metrics.items() for m, v in of.items()],
           "split string, metric string, value double", f"{path}/metrics")
    _table(spark, list(diagnostics), "test string, feature string, statistic string, value double", f"{path}/diagnostics")
    spark.createDataFrame([meta], META_SCHEMA).coalesce(1).write.json(f"{path}/meta")


def save_linear(spark: SparkSession, path: str, model: LinearModel, meta: dict, metrics: dict | None = None,
                diagnostics: Diagnostics = ()) -> None:
    """SNK-3: a linear model's tables.  ``metrics`` is {split: {metric: value}}."""
    _table(spark, [(i, *n) for i, n in enumerate(model.numeric)], _NUMERIC, f"{path}/numeric")
    _table(spark, [("intercept", model.intercept, None), ("other", model.other, None), ("category", None, model.category),
                   *_rules(model)], _PARAMS, f"{path}/params")
    model.lookup.select("value", "effect").write.parquet(f"{path}/categories")
    _common(spark, path, model, meta, metrics or {}, diagnostics)


def load_linear(spark: SparkSession, path: str, version: str = "unsaved") -> LinearModel:
    """SRC-4: the model as it was saved, number for number."""
    numeric = [tuple(r)[1:] for r in spark.read.parquet(f"{path}/numeric").orderBy("position").collect()]
    p = _params(spark, path)
    return LinearModel(numeric, p["intercept"], p["category"], spark.read.parquet(f"{path}/categories"), p["other"],
                       **{k: p[k] for k in RULES}, version=version)


def save_forest(spark: SparkSession, path: str, model: ForestModel, meta: dict, metrics: dict | None = None,
                diagnostics: Diagnostics = ()) -> None:
    """SNK-3: every tree of a forest and what turns a row into its vector."""
    ct, collapse = model.transformer, model.collapse
    model.forest.save(spark, f"{path}/model")
    _table(spark, [(i, c, ct.medians[c], *ct.scaling[c], None) for i, c in enumerate(ct.kept_numeric)], _NUMERIC,
           f"{path}/numeric")
    collapse.kept.write.parquet(f"{path}/kept")
    (category,) = ct.categorical
    _table(spark, [("category", None, category), ("other", None, collapse.other), ("mode", None, ct.modes[category]),
                   *_rules(model)], _PARAMS, f"{path}/params")
    _table(spark, list(enumerate(ct.categories[category])), "position int, value string", f"{path}/categories")
    _table(spark, list(enumerate(model.features)), "position int, name string", f"{path}/features")
    _common(spark, path, model, meta, metrics or {}, diagnostics)


def load_forest(spark: SparkSession, path: str, version: str = "unsaved") -> ForestModel:
    """SRC-4: a saved forest, ready to score."""
    numeric = spark.read.parquet(f"{path}/numeric").orderBy("position").collect()
    of = _params(spark, path)
    values = [r["value"] for r in spark.read.parquet(f"{path}/categories").orderBy("position").collect()]
    names = [r["name"] for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]
    ct = ColumnTransformerModel([r["column"] for r in numeric], [of["category"]],
                                {r["column"]: r["median"] for r in numeric},
                                {r["column"]: (r["mean"], r["scale"]) for r in numeric},
                                {of["category"]: of["mode"]}, {of["category"]: values})
    collapse = RareCollapse(of["category"], spark.read.parquet(f"{path}/kept"), other=of["other"])
    return ForestModel(Forest.load(spark, f"{path}/model"), collapse, ct,
                       **{k: of[k] for k in RULES}, version=version, features=names)


def _rules(model) -> list[tuple[str, None, str]]:
    return [(k, None, getattr(model, k)) for k in RULES]


def _params(spark: SparkSession, path: str) -> dict:
    return {r["name"]: r["text"] if r["number"] is None else r["number"]
            for r in spark.read.parquet(f"{path}/params").collect()}


# ---------------------------------------------------------------- versions
def publish(spark: SparkSession, store: str, write: Callable[[str], None]) -> str:
    """Run ``write(folder)`` on a new folder of ``store``, then point to it; the version's name.

    The pointer is the last thing written, and claimed by creating a file that must not exist: of two
    publications at once both stay, one after the other.
    """
    folder = f"m-{uuid.uuid4().hex[:12]}"
    write(f"{store}/{folder}")
    while True:
        number = max(_pointers(spark, store), default=0) + 1
        path, fs = hadoop_path(spark, f"{store}/pointers/v{number:08d}")
        try:
            out = fs.create(path, False)
        except Exception:
            if path_exists(spark, f"{store}/pointers/v{number:08d}"):
                continue  # another publication took this number
            raise
        out.write(bytearray(folder.encode()))
        out.close()
        return f"v{number:08d}"


def _pointers(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the pointers that were written to their end, in order."""
    path, fs = hadoop_path(spark, f"{store}/pointers/v*")
    return sorted(int(x.getPath().getName()[1:]) for x in fs.globStatus(path) or [] if x.getLen() > 0)


def versions(spark: SparkSession, store: str) -> list[str]:
    return [f"v{n:08d}" for n in _pointers(spark, store)]


def version_path(spark: SparkSession, store: str, version: str | None = None) -> tuple[str, str]:
    """(version, its folder), of the newest version unless one is named."""
    known = versions(spark, store)
    version = version or (known[-1] if known else None)
    if version not in known:
        raise FileNotFoundError(f"no model {version or ''} in {store}")
    return version, f"{store}/{spark.read.text(f'{store}/pointers/{version}').first()[0]}"


def load_model(spark: SparkSession, store: str, version: str | None = None) -> LinearModel | ForestModel:
    """SRC-4: the newest (or a named) model of a store."""
    version, path = version_path(spark, store, version)
    load = load_forest if path_exists(spark, f"{path}/model") else load_linear
    return load(spark, path, version)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: meta record with the health fallbacks (empty if absent):
    r2_test falls back to r2_test_log when NULL or 0, type / version defaults."""
    if not path_exists(spark, f"{path}/meta"):
        meta = spark.createDataFrame([], META_SCHEMA)
    else:
        meta = spark.read.schema(META_SCHEMA).json(f"{path}/meta")
    return meta.select(
        "target",
        F.coalesce(F.col("model_type"), F.lit("RandomForestRegressor")).alias("model_type"),
        F.coalesce(F.col("artifact_subdir"), F.lit(path.rstrip("/").split("/")[-1]))
        .alias("model_version"),
        F.coalesce(F.nullif(F.col("r2_train"), F.lit(0.0)), F.col("r2_train_log")).alias("r2_train"),
        F.coalesce(F.nullif(F.col("r2_test"), F.lit(0.0)), F.col("r2_test_log")).alias("r2_test"),
        F.col("significance.n_obs").alias("n_obs"),
        F.col("significance.significant_features").alias("significant_features"))
