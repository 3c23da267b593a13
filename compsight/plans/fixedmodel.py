"""A value model of fixed, invented parameters, and the SQL that scores requests with it.

It stands for a model that was trained and saved before: the scoring queries publish it, load it from
the store and train nothing, so that SQL can state what they return.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import config as C
from ..operators.scoring import LinearModel
from . import sqltext as Q

#: Parameters of the model: (column, median, mean, scale, weight), and the cities' effects.
NUMERIC = [
    ("square_footage", 2500.0, 2400.0, 1250.0, 0.05),
    ("bed", 4.0, 4.0, 1.75, 0.02),
    ("baths", 2.0, 2.0, 0.875, 0.01),
    ("dom", 90.0, 88.0, 52.0, -0.01),
    ("lot_area_value", 12000.0, 9000000.0, 20000000.0, 0.005),
    ("year_built", 1960.0, 1958.0, 35.0, 0.015),
    ("school_score", 5.0, 4.5, 2.875, 0.03),
    ("total_cost", 140000.0, 138000.0, 80000.0, 0.45),
    ("rehab_ratio", 0.04, 0.041, 0.03, -0.02),
]
INTERCEPT = 11.875
CITIES = {"Charlotte": 0.125, "Indianapolis": -0.0625, "Atlanta": 0.25}
OTHER = 0.03125


def _rounded(x: str, digits: int) -> str:
    scale = f"CAST(1e{digits} AS DOUBLE)"
    return f"floor({x} * {scale} + 0.5) / {scale}"


def fixed_model(spark: SparkSession) -> LinearModel:
    lookup = spark.createDataFrame(list(CITIES.items()), "value string, effect double")
    return LinearModel(NUMERIC, INTERCEPT, C.CATEGORICAL_FEATURES[0], lookup, OTHER, "log1p", "score", "zero", "RidgeLOO")


def log_value_sql(category: str) -> str:
    """DuckDB SQL of the model's log prediction from columns named like the features and a category expression."""
    terms = " + ".join(f"(COALESCE({c}, {med}) - {mean}) / {scale} * {w}" for c, med, mean, scale, w in NUMERIC)
    return f"{INTERCEPT} + {terms} + CASE {category} " + " ".join(
        f"WHEN '{k}' THEN {v}" for k, v in CITIES.items()) + f" ELSE {OTHER} END"


def scored_sql(policy: str, unknown: str, city: str) -> str:
    """DuckDB SQL of every request's scores, as the scoring queries round them."""
    fill = "NULL" if unknown == "impute" else "0.0"
    address = "lower(concat_ws(', ', CAST(source_row AS VARCHAR), city))"
    bucket = "'Other'" if city == "other" else (
        "CASE " + " ".join(f"WHEN contains({address}, '{k}') THEN '{v}'" for k, v in C.CITY_RULES) + " ELSE 'Other' END")
    ratio = "arv_raw / cost"
    clamped = f"CASE WHEN {ratio} < 1.0 THEN 1.0 WHEN {ratio} > 2.0 THEN 2.0 ELSE {ratio} END"
    if policy == "ltv":
        loan, extra = "greatest(0.0, 0.7 * arv)", ""
    else:
        loan = "least(0.7 * arv, 0.9 * cost)"
        extra = f"{_rounded('0.7 * arv', 2)} AS max_loan_ltv, {_rounded('0.9 * cost', 2)} AS max_loan_ltc,"
    sql = Q.with_ctes(f"""
feat AS (
  SELECT source_row AS request_id, COALESCE(purchase_price_ma, 0.0) AS p, COALESCE(rehab_budget_ma, 0.0) AS r,
    COALESCE(square_footage, 0.0) AS square_footage, COALESCE(bed, 0.0) AS bed, COALESCE(baths, 0.0) AS baths,
    {", ".join(f"CAST({fill} AS DOUBLE) AS {c}" for c in ("dom", "lot_area_value", "year_built", "school_score"))},
    {bucket} AS bucket FROM comps),
cost AS (SELECT *, p + r AS total_cost, p + r AS cost, CASE WHEN p + r > 0 THEN r / (p + r) ELSE 0.0 END AS rehab_ratio
         FROM feat),
raw AS (SELECT *, exp({log_value_sql("bucket")}) - 1 AS arv_raw FROM cost),
cl AS (SELECT *, CASE WHEN cost > 0 THEN ({clamped}) * cost ELSE arv_raw END AS arv,
         CASE WHEN cost > 0 THEN {clamped} END AS clamped_ratio,
         COALESCE(cost > 0 AND abs(({clamped}) - {ratio}) > 1e-6, false) AS arv_clamped FROM raw),
loan AS (SELECT *, {loan} AS loan FROM cl),
adv AS (SELECT *, greatest(loan - r, 0.0) AS adv, loan * 0.0225 AS fee FROM loan)""", body=f"""
SELECT request_id, {_rounded("arv_raw", 2)} AS arv_raw, total_cost, {_rounded("arv", 2)} AS arv,
  {_rounded("clamped_ratio", 6)} AS clamped_ratio, arv_clamped, {extra} {_rounded("loan", 2)} AS total_loan,
  {_rounded("adv", 2)} AS initial_advance, {_rounded("fee", 2)} AS placement_fee,
  greatest(CAST(round_even(p - adv + fee + 1195.0 + 594.0, 0) AS DOUBLE), 0.0) AS cash_to_close,
  'RidgeLOO' AS model_type, 'v00000001' AS model_version
FROM adv""")
    for number in ("0.7 * arv", "0.9 * cost", "loan * 0.0225"):
        a, b = number.split(" * ")
        value, name = (a, b) if a[0] == "0" else (b, a)
        sql = sql.replace(number, f"CAST({value} AS DOUBLE) * {name}")
    return sql
