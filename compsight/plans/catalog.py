"""Query catalog: one Spark job per SURVEY §2 operator, with its DuckDB oracle.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
test tables.  ``ORACLE`` holds the equivalent ANSI SQL for the entries whose
semantics SQL can state; the rest are checked by row count only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import finance as fin
from ..functions.numeric import to_date, to_number
from ..functions.text import city_bucket
from ..operators import clean, schema
from ..session import stored, scratch_path
from ..sources import standins
from ..sources.comps import load_comps, normalize_columns
from . import prep
from . import sqltext as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


AS_OF = prep.DEFAULT_AS_OF
COMPS_COLS = ", ".join(standins.COMPS_COLUMNS)


def r4(c) -> F.Column:
    return F.round(c, 4)


# ====================================================================== sources / schema
@register("comps_load", Q.with_ctes(Q.LOADED_CTE, body="SELECT * FROM loaded"))
def comps_load(spark, sf_dir):
    """SRC-1: the comps stand-in written as parquet to the shared folder, then
    read back through ``load_comps`` (names normalised, date parsed)."""
    path = scratch_path(spark, "comps")
    standins.comps(spark, sf_dir).write.mode("overwrite").parquet(path)
    return load_comps(spark, path)


@register("normalize_columns", Q.with_ctes(body=f"SELECT {COMPS_COLS} FROM comps"))
def normalize_columns_q(spark, sf_dir):
    """PRJ-1: display headers -> normalised names."""
    return normalize_columns(standins.comps_display(spark, sf_dir))


_FEATS = ", ".join(C.NUMERIC_FEATURES + C.CATEGORICAL_FEATURES)


@register("allow_list", Q.with_ctes(
    Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, Q.FEATURES_CTE.replace("FROM recent", "FROM elig"),
    body=f"SELECT source_row, projected_value_ma AS label, {_FEATS} FROM feat"))
def allow_list_q(spark, sf_dir):
    """PRJ-2/5: target + the feature allow-list in fixed order on cleaned comps."""
    df = prep.engineer(prep.cleaned(spark, sf_dir, recent=False))
    return schema.split_target(df, keep=["source_row"])


@register("add_missing_columns", Q.with_ctes(body="""
SELECT source_row, square_footage, bed, baths, dom, lot_area_value, year_built,
       CAST(NULL AS DOUBLE) AS school_score, CAST(NULL AS DOUBLE) AS total_cost,
       CAST(NULL AS DOUBLE) AS rehab_ratio, CAST(city AS VARCHAR) AS city
FROM comps"""))
def add_missing_columns_q(spark, sf_dir):
    """PRJ-3: a comps extract without some features gets them as typed NULLs."""
    df = standins.comps(spark, sf_dir).drop("school_score")
    df = schema.add_missing_columns(df, C.NUMERIC_FEATURES)
    return df.select("source_row", *C.NUMERIC_FEATURES, *C.CATEGORICAL_FEATURES)


# ====================================================================== scalar functions
@register("to_numeric", Q.with_ctes(body=f"""
SELECT source_row, projected_value_ma, {Q.num('projected_value_ma')} AS projected_num FROM comps"""))
def to_numeric_q(spark, sf_dir):
    """NUM-1: text target -> double, unparseable -> NULL."""
    return standins.comps(spark, sf_dir).select(
        "source_row", C.TARGET_COL, to_number(C.TARGET_COL).alias("projected_num"))


@register("to_numeric_gated", Q.with_ctes(body=f"""
SELECT * REPLACE ({Q.num('projected_value_ma')} AS projected_value_ma) FROM comps"""))
def to_numeric_gated_q(spark, sf_dir):
    """NUM-2: each text column is coerced only if >= 10 % of it parses."""
    return clean.coerce_text_columns(standins.comps(spark, sf_dir))


@register("parse_dates", Q.with_ctes(body="""
SELECT source_row, fecha_de_modificacion, TRY_CAST(fecha_de_modificacion AS DATE) AS fecha_parsed
FROM comps"""))
def parse_dates_q(spark, sf_dir):
    """TS-1: date text -> DATE, unparseable -> NULL."""
    return standins.comps(spark, sf_dir).select(
        "source_row", C.DATE_COL, to_date(C.DATE_COL).alias("fecha_parsed"))


@register("strip_text", Q.with_ctes(body=f"""
SELECT * REPLACE ({Q.strip('fecha_de_modificacion')} AS fecha_de_modificacion,
                  {Q.strip('projected_value_ma')} AS projected_value_ma,
                  {Q.strip('lot_area_units')} AS lot_area_units,
                  {Q.strip('city')} AS city)
FROM comps"""))
def strip_text_q(spark, sf_dir):
    """STR-S1: strip every text column."""
    return clean.strip_text_columns(standins.comps(spark, sf_dir))


@register("lot_area", Q.with_ctes(body=f"""
SELECT source_row,
  CASE WHEN contains(lower({Q.strip('lot_area_units')}), 'acre')
       THEN lot_area_value * CAST(43560 AS DOUBLE) ELSE lot_area_value END AS lot_area_value,
  CASE WHEN contains(lower({Q.strip('lot_area_units')}), 'acre') THEN 'sqft'
       ELSE lower({Q.strip('lot_area_units')}) END AS lot_area_units
FROM comps"""))
def lot_area_q(spark, sf_dir):
    """UNIT-1 + STR-S2/S3: acres -> square feet."""
    return clean.normalize_lot_area(standins.comps(spark, sf_dir)).select(
        "source_row", C.LOT_VALUE_COL, C.LOT_UNITS_COL)


@register("city_bucket", Q.with_ctes(body="""
SELECT source_row AS request_id, concat_ws(', ', CAST(source_row AS VARCHAR), city) AS address,
  CASE WHEN contains(lower(concat_ws(', ', CAST(source_row AS VARCHAR), city)), 'charlotte') THEN 'Charlotte'
       WHEN contains(lower(concat_ws(', ', CAST(source_row AS VARCHAR), city)), 'indianapolis') THEN 'Indianapolis'
       ELSE 'Other' END AS city_bucket
FROM comps"""))
def city_bucket_q(spark, sf_dir):
    """STR-S4: city bucket from the submitted address."""
    req = standins.scoring_requests(spark, sf_dir)
    return req.select("request_id", "address", city_bucket("address").alias("city_bucket"))


# ====================================================================== dedup / filters
@register("latest_per_loan", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, body="SELECT * FROM latest"))
def latest_per_loan_q(spark, sf_dir):
    """DED-1 / WIN-1 / SRT-3: latest row per loan (NULL ids are one group)."""
    return prep.latest(spark, sf_dir)


@register("positive_target", Q.with_ctes(Q.LOADED_CTE, body=f"""
SELECT * FROM loaded WHERE {Q.num('projected_value_ma')} > 0"""))
def positive_target_q(spark, sf_dir):
    """FLT-1: target > 0 (non-numbers dropped)."""
    return clean.positive_target(prep.loaded(spark, sf_dir))


@register("eligible", Q.with_ctes(Q.LOADED_CTE, body=f"""
SELECT * REPLACE ({Q.num('projected_value_ma')} AS projected_value_ma)
FROM loaded WHERE {Q.num('projected_value_ma')} > 0"""))
def eligible_q(spark, sf_dir):
    """FLT-2: coerce, drop NULL and <= 0, store the number."""
    return clean.filter_eligible(prep.loaded(spark, sf_dir))


_CUTOFF = f"CAST(DATE '{AS_OF}' - INTERVAL 6 MONTH AS DATE)"


@register("recent_window", Q.with_ctes(Q.LOADED_CTE, body=f"""
SELECT * FROM loaded
WHERE fecha_de_modificacion >= {_CUTOFF} OR (SELECT count(fecha_de_modificacion) FROM loaded) = 0"""))
def recent_window_q(spark, sf_dir):
    """FLT-3: six calendar months back from ``as_of``, inclusive."""
    return clean.filter_recent(prep.loaded(spark, sf_dir), as_of=AS_OF)


@register("stage_counts", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, body="""
SELECT 'loaded' AS stage, CAST(count(*) AS BIGINT) AS n_rows FROM loaded
UNION ALL SELECT 'latest', count(*) FROM latest
UNION ALL SELECT 'positive', count(*) FROM cleaned
UNION ALL SELECT 'eligible', count(*) FROM elig
UNION ALL SELECT 'recent', count(*) FROM recent"""))
def stage_counts_q(spark, sf_dir):
    """AGG-9: rows left after each stage, one aggregate pass per materialised stage."""
    from ..operators.aggregates import stage_counts
    return stage_counts(prep.loaded(spark, sf_dir), as_of=AS_OF)


@register("drop_constant_columns_all", Q.with_ctes(Q.LOADED_CTE, body="""
SELECT * FROM loaded"""))
def drop_constant_columns_all_q(spark, sf_dir):
    """FLT-6 / AGG-7/8 on all loaded comps, where every column varies and stays."""
    return clean.drop_constant_columns(prep.loaded(spark, sf_dir))


# ====================================================================== flagship
@register("city_summary", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, Q.FEATURES_CTE, body="""
SELECT city, CAST(count(*) AS BIGINT) AS n_comps,
       round(median(purchase_price_ma), 4) AS median_purchase,
       round(avg(rehab_ratio), 4) AS avg_rehab_ratio,
       CAST(sum(CAST(projected_value_ma AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_value
FROM feat GROUP BY city"""))
def city_summary(spark, sf_dir):
    """Minimum slice: cleaned recent comps -> FEAT-2 -> per-city count, median
    purchase price, mean rehab ratio and total value."""
    from ..operators.quantiles import exact_percentiles
    df = prep.features(spark, sf_dir).select("city", C.PURCHASE_COL, "rehab_ratio", C.TARGET_COL)
    # exact median in the same passes as the other aggregates: a hot city never sits in one buffer
    out = exact_percentiles(df, C.PURCHASE_COL, [0.5], ["city"], ["m"], extra=[
        F.count(F.lit(1)).alias("n_comps"), r4(F.avg("rehab_ratio")).alias("avg_rehab_ratio"),
        F.sum(F.col(C.TARGET_COL).cast("decimal(18,2)")).cast("decimal(18,2)").alias("total_value")])
    return out.select("city", "n_comps", r4(F.col("m")).alias("median_purchase"), "avg_rehab_ratio", "total_value")


# ====================================================================== finance (FIN-1..9)
def _money_input(spark, sf_dir) -> DataFrame:
    """Eligible comps: the coerced target stands for a predicted value."""
    return clean.filter_eligible(prep.loaded(spark, sf_dir)).select(
        "source_row", F.col(C.PURCHASE_COL).alias("purchase"), F.col(C.REHAB_COL).alias("rehab"),
        F.col(C.TARGET_COL).alias("arv_raw"))


_MONEY_CTE = f"""
money AS (SELECT source_row, purchase_price_ma AS purchase, rehab_budget_ma AS rehab,
                 {Q.num('projected_value_ma')} AS arv_raw
          FROM loaded WHERE {Q.num('projected_value_ma')} > 0)"""


@register("total_cost", Q.with_ctes(body="""
SELECT source_row, purchase_price_ma + rehab_budget_ma AS total_cost_propagate,
       COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0) AS total_cost_zero
FROM comps"""))
def total_cost_q(spark, sf_dir):
    """FIN-1 (both NULL policies) and FIN-3 (missing -> 0)."""
    return standins.comps(spark, sf_dir).select(
        "source_row",
        fin.total_cost(C.PURCHASE_COL, C.REHAB_COL, nulls="propagate").alias("total_cost_propagate"),
        fin.total_cost(C.PURCHASE_COL, C.REHAB_COL, nulls="zero").alias("total_cost_zero"))


_RATIO_SQL = {
    "train_linear": """CASE WHEN rehab_budget_ma / NULLIF(purchase_price_ma, 0) < 0 THEN 0.0
         WHEN rehab_budget_ma / NULLIF(purchase_price_ma, 0) > 5 THEN 5.0
         ELSE rehab_budget_ma / NULLIF(purchase_price_ma, 0) END""",
    "train_forest": "COALESCE(rehab_budget_ma / NULLIF(purchase_price_ma, 0), 0.0)",
    "audit": "rehab_budget_ma / NULLIF(purchase_price_ma, 0)",
    "score": """CASE WHEN COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0) > 0
         THEN COALESCE(rehab_budget_ma, 0.0) / (COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0))
         ELSE 0.0 END""",
}


def _ratio_query(mode):
    def q(spark, sf_dir):
        return standins.comps(spark, sf_dir).select(
            "source_row", fin.rehab_ratio(C.PURCHASE_COL, C.REHAB_COL, mode).alias("rehab_ratio"))
    q.__doc__ = f"FIN-2 rehab ratio, '{mode}' definition."
    return q


for _mode in fin.REHAB_RATIO_MODES:
    register(f"rehab_ratio_{_mode}", Q.with_ctes(body=f"""
SELECT source_row, CAST({_RATIO_SQL[_mode]} AS DOUBLE) AS rehab_ratio FROM comps"""))(_ratio_query(_mode))


@register("log_target", Q.with_ctes(Q.LOADED_CTE, _MONEY_CTE, body="""
SELECT source_row, round(ln(1 + arv_raw), 4) AS y_log1p, round(ln(arv_raw), 4) AS y_log,
       round(exp(ln(arv_raw)), 2) AS back_dollars
FROM money"""))
def log_target_q(spark, sf_dir):
    """FIN-4: log1p / log target transforms and the exact inverse."""
    df = _money_input(spark, sf_dir)
    return df.select(
        "source_row",
        r4(fin.forward_target("arv_raw", "log1p")).alias("y_log1p"),
        r4(fin.forward_target("arv_raw", "log")).alias("y_log"),
        F.round(fin.inverse_target(fin.forward_target("arv_raw", "log"), "log"), 2).alias("back_dollars"))


_CLAMP_SQL = """
  CASE WHEN cost > 0 THEN
    (CASE WHEN arv_raw / cost < 1.0 THEN 1.0 WHEN arv_raw / cost > 2.0 THEN 2.0 ELSE arv_raw / cost END) * cost
  ELSE arv_raw END AS arv,
  CASE WHEN cost > 0 THEN
    (CASE WHEN arv_raw / cost < 1.0 THEN 1.0 WHEN arv_raw / cost > 2.0 THEN 2.0 ELSE arv_raw / cost END)
  END AS clamped_ratio,
  COALESCE(cost > 0 AND abs((CASE WHEN arv_raw / cost < 1.0 THEN 1.0 WHEN arv_raw / cost > 2.0 THEN 2.0
                                  ELSE arv_raw / cost END) - arv_raw / cost) > 1e-6, false) AS arv_clamped"""

_COST_SQL = "COALESCE(purchase, 0.0) + COALESCE(rehab, 0.0)"


def _clamped(spark, sf_dir) -> DataFrame:
    df = _money_input(spark, sf_dir)
    cost = fin.total_cost("purchase", "rehab", nulls="zero")
    cl = fin.clamp_value("arv_raw", cost)
    return df.select("source_row", "purchase", "rehab", "arv_raw", cost.alias("total_cost"),
                     *[v.alias(k) for k, v in cl.items()])


@register("arv_clamp", Q.with_ctes(Q.LOADED_CTE, _MONEY_CTE, body=f"""
SELECT source_row, cost AS total_cost, {_CLAMP_SQL}
FROM (SELECT *, {_COST_SQL} AS cost FROM money)"""))
def arv_clamp_q(spark, sf_dir):
    """FIN-5: value guard-rail, ratio to cost clamped to [1, 2]."""
    return _clamped(spark, sf_dir).select("source_row", "total_cost", "arv", "clamped_ratio",
                                          "arv_clamped")


_CLAMPED_CTE = f"""
clamped AS (SELECT source_row, purchase, rehab, {_CLAMP_SQL}
            FROM (SELECT *, {_COST_SQL} AS cost FROM money))"""


def _loan_query(policy):
    def q(spark, sf_dir):
        df = _clamped(spark, sf_dir)
        out = fin.size_loan("arv", "purchase", "rehab", policy)
        return df.select("source_row", "arv", *[v.alias(k) for k, v in out.items()])
    q.__doc__ = f"FIN-6/7/8 loan sizing, policy '{policy}', on clamped values."
    return q


_P = "COALESCE(purchase, 0.0)"
_R = "COALESCE(rehab, 0.0)"
_LOAN_SQL = {
    "ltv": f"""
SELECT source_row, arv, {_P} + {_R} AS total_cost, total_loan, initial_advance, placement_fee,
  greatest(round_even({_P} - initial_advance + placement_fee + 1195.0 + 594.0, 0), 0.0) AS cash_to_close,
  0.7 AS ltv_limit
FROM (SELECT *, greatest(0.0, 0.7 * arv) AS total_loan,
             greatest(greatest(0.0, 0.7 * arv) - {_R}, 0.0) AS initial_advance,
             greatest(0.0, 0.7 * arv) * 0.0225 AS placement_fee FROM clamped)""",
    "ltv_ltc": f"""
SELECT source_row, arv, {_P} + {_R} AS total_cost, max_loan_ltv, max_loan_ltc, total_loan,
  initial_advance, placement_fee,
  greatest(round_even({_P} - initial_advance + placement_fee + 1195.0 + 594.0, 0), 0.0) AS cash_to_close
FROM (SELECT *, greatest(total_loan - {_R}, 0.0) AS initial_advance, total_loan * 0.0225 AS placement_fee
      FROM (SELECT *, 0.7 * arv AS max_loan_ltv, 0.9 * ({_P} + {_R}) AS max_loan_ltc,
                   least(0.7 * arv, 0.9 * ({_P} + {_R})) AS total_loan FROM clamped))""",
    "ltv_ltc_raw": f"""
SELECT source_row, arv, {_P} + {_R} AS total_cost, max_loan_ltv, max_loan_ltc, total_loan,
  initial_advance, placement_fee,
  greatest({_P} - initial_advance + placement_fee + 1195.0 + 594.0, 0.0) AS cash_to_close
FROM (SELECT *, total_loan - {_R} AS initial_advance, total_loan * 0.0225 AS placement_fee
      FROM (SELECT *, 0.7 * arv AS max_loan_ltv, 0.9 * ({_P} + {_R}) AS max_loan_ltc,
                   least(0.7 * arv, 0.9 * ({_P} + {_R})) AS total_loan FROM clamped))""",
}

for _pol, _name in (("ltv", "loan_ltv"), ("ltv_ltc", "loan_ltv_ltc"), ("ltv_ltc_raw", "loan_ltv_ltc_raw")):
    register(_name, Q.with_ctes(Q.LOADED_CTE, _MONEY_CTE, _CLAMPED_CTE,
                                body=_LOAN_SQL[_pol].replace("0.7", "CAST(0.7 AS DOUBLE)")
                                .replace("0.9 *", "CAST(0.9 AS DOUBLE) *")
                                .replace("0.0225", "CAST(0.0225 AS DOUBLE)")))(_loan_query(_pol))


@register("value_ratio", Q.with_ctes(Q.LOADED_CTE, _MONEY_CTE, body=f"""
SELECT source_row, arv_raw / NULLIF({_COST_SQL}, 0) AS value_ratio FROM money"""))
def value_ratio_q(spark, sf_dir):
    """FIN-9: value / total cost, zero cost -> NULL."""
    df = _money_input(spark, sf_dir)
    return df.select("source_row", fin.value_ratio(
        "arv_raw", fin.total_cost("purchase", "rehab", nulls="zero")).alias("value_ratio"))


@register("display_rounding", Q.with_ctes(Q.LOADED_CTE, _MONEY_CTE, body="""
SELECT source_row, round_even(arv_raw, 0) AS arv_whole, round_even(arv_raw, 2) AS arv_cents FROM money"""))
def display_rounding_q(spark, sf_dir):
    """FMT-1: half-even display rounding (text formatting via ``display_money``)."""
    df = _money_input(spark, sf_dir)
    return df.select("source_row", F.bround("arv_raw", 0).alias("arv_whole"),
                     F.bround("arv_raw", 2).alias("arv_cents"))


# ====================================================================== aggregates (AGG-3..6)
from ..operators import aggregates as agg  # noqa: E402


@register("describe_ratio", Q.with_ctes(Q.LOADED_CTE, _MONEY_CTE, body=f"""
SELECT CAST(count(v) AS BIGINT) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
       round(min(v), 4) AS min, round(quantile_cont(v, 0.1), 4) AS p10,
       round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50,
       round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90,
       round(max(v), 4) AS max
FROM (SELECT arv_raw / NULLIF({_COST_SQL}, 0) AS v FROM money)"""))
def describe_ratio_q(spark, sf_dir):
    """AGG-4: describe() of value / cost with exact percentiles."""
    df = _money_input(spark, sf_dir).select(fin.value_ratio(
        "arv_raw", fin.total_cost("purchase", "rehab", nulls="zero")).alias("v"))
    d = agg.describe(df, "v")
    return d.select("count", *[r4(c).alias(c) for c in d.columns if c != "count"])


@register("metrics", Q.with_ctes(Q.LOADED_CTE, _MONEY_CTE, body=f"""
SELECT CAST(count(*) AS BIGINT) AS n,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
       round(avg(abs(y - p)), 2) AS mae, round(avg((y - p) * (y - p)), 0) AS mse,
       round(sqrt(avg((y - p) * (y - p))), 2) AS rmse
FROM (SELECT arv_raw AS y, 1.2 * ({_COST_SQL}) AS p FROM money)""".replace("1.2 *", "CAST(1.2 AS DOUBLE) *")))
def metrics_q(spark, sf_dir):
    """AGG-5: R², MAE, MSE, RMSE of the cost-plus-20 % valuation against the value."""
    df = _money_input(spark, sf_dir).select(
        F.col("arv_raw").alias("y"),
        (F.lit(1.2) * fin.total_cost("purchase", "rehab", nulls="zero")).alias("p"))
    m = agg.regression_metrics(df, "y", "p")
    return m.select("n", F.round("r2", 6).alias("r2"), F.round("mae", 2).alias("mae"),
                    F.round("mse", 0).alias("mse"), F.round("rmse", 2).alias("rmse"))


@register("category_counts", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, body="""
SELECT city, CAST(count(*) AS BIGINT) AS n FROM elig WHERE city IS NOT NULL GROUP BY city"""))
def category_counts_q(spark, sf_dir):
    """AGG-3: city frequencies on cleaned comps, NULLs excluded."""
    return agg.category_counts(prep.cleaned(spark, sf_dir, recent=False), "city")


_TEXT_COLS = ["fecha_de_modificacion", "projected_value_ma", "lot_area_units", "city"]


@register("parse_rate", Q.with_ctes(body=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {Q.num(c)} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS parse_rate FROM comps"
    for c in _TEXT_COLS)))
def parse_rate_q(spark, sf_dir):
    """AGG-6: share of each text column that parses as a number."""
    return agg.parse_rate(standins.comps(spark, sf_dir), _TEXT_COLS)


@register("null_profile_all", Q.with_ctes(Q.LOADED_CTE, body=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n_values, count({c}) = 0 AS all_null, "
    f"COALESCE(min({c}) < max({c}), false) AS varies FROM loaded"
    for c in standins.COMPS_COLUMNS)))
def null_profile_all_q(spark, sf_dir):
    """AGG-7/8: per-column value count, all-NULL and constant flags of all loaded comps."""
    return agg.null_profile(prep.loaded(spark, sf_dir), standins.COMPS_COLUMNS)


@register("event_filter_counts", f"""
SELECT CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_matching,
       CAST(count(*) AS BIGINT) AS n_total FROM events""")
def event_filter_counts_q(spark, sf_dir):
    """AGG-1 on raw events: filtered and total count in one pass."""
    from ..sources.tables import read_table
    return agg.filtered_counts(read_table(spark, sf_dir, "events"), F.col("event_type") == "purchase")


# ====================================================================== sampling (SMP-1/2)
from ..operators import sampling as smp  # noqa: E402

_H32 = "('0x' || substr(md5(CAST(source_row AS VARCHAR) || '|42'), 1, 8))::BIGINT"


@register("split_flags", Q.with_ctes(body=f"""
SELECT source_row, {_H32} % 10000 < 2000 AS is_test FROM comps"""))
def split_flags_q(spark, sf_dir):
    """SMP-2: seeded hash split, one narrow pass."""
    return smp.split_flags(standins.comps(spark, sf_dir)).select("source_row", "is_test")


@register("split_exact", Q.with_ctes(body=f"""
SELECT source_row,
       row_number() OVER (ORDER BY {_H32}, source_row) <= ceil(0.2 * count(*) OVER ()) AS is_test
FROM comps"""))
def split_exact_q(spark, sf_dir):
    """SMP-2 exact: ceil(0.2 n) test rows by smallest seeded hash (radix select)."""
    return smp.split_exact(standins.comps(spark, sf_dir)).select("source_row", "is_test")


@register("sample10", Q.with_ctes(Q.LOADED_CTE, _MONEY_CTE, body="""
SELECT source_row, arv_raw FROM money
ORDER BY md5(CAST(source_row AS VARCHAR) || '|42'), source_row LIMIT 10"""))
def sample10_q(spark, sf_dir):
    """SMP-1: exactly 10 rows in seeded-hash order."""
    return smp.seeded_sample(_money_input(spark, sf_dir)).select("source_row", "arv_raw")


# ====================================================================== features (FEAT-1..9)
from ..operators import features as FE  # noqa: E402
from ..operators import linear as L  # noqa: E402
from ..operators import ordered as O  # noqa: E402
from . import training as TR  # noqa: E402

_FEAT_ALL = [Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, Q.FEATURES_CTE, Q.SPLIT_CTE]


def _split_features(spark, sf_dir) -> DataFrame:
    """Cleaned, engineered, split comps, materialised once: the fit passes
    and the final transform all read it."""
    return stored(smp.split_flags(prep.features(spark, sf_dir)), "cut")


@register("collapse_rare", Q.with_ctes(*_FEAT_ALL, body="SELECT source_row, city FROM pre"))
def collapse_rare_q(spark, sf_dir):
    """FEAT-1: cities seen < 25 times among train rows (and NULL) -> 'Other'."""
    df = _split_features(spark, sf_dir)
    rc = FE.RareCollapse.fit(df.filter(~F.col("is_test")), "city")
    return rc.transform(df).select("source_row", "city")


@register("median_impute", Q.with_ctes(*_FEAT_ALL, body=f"""
SELECT source_row, {", ".join(Q.NUMERIC)} FROM imp"""))
def median_impute_q(spark, sf_dir):
    """FEAT-3: exact medians learned on train rows fill every row's NULLs."""
    df = _split_features(spark, sf_dir)
    med = FE.fit_medians(df.filter(~F.col("is_test")), C.NUMERIC_FEATURES)
    return df.select("source_row", *[F.coalesce(F.col(c), F.lit(med[c])).alias(c)
                                     for c in C.NUMERIC_FEATURES])


@register("standardize", Q.with_ctes(*_FEAT_ALL, body=f"""
SELECT source_row, {", ".join(f"round(num__{c}, 6) AS num__{c}" for c in Q.NUMERIC)} FROM std"""))
def standardize_q(spark, sf_dir):
    """FEAT-3 + FEAT-4: impute then standardise with population std (train fit)."""
    df = _split_features(spark, sf_dir)
    ct = FE.fit_column_transformer(df.filter(~F.col("is_test")), categorical=())
    return ct.transform(df, keep=["source_row"]).select(
        "source_row", *[F.round(f"num__{c}", 6).alias(f"num__{c}") for c in C.NUMERIC_FEATURES])


@register("mode_impute")
def mode_impute_q(spark, sf_dir):
    """FEAT-5: most frequent train city (ties -> smallest) fills NULL cities."""
    df = _split_features(spark, sf_dir)
    mode = FE.most_frequent(df.filter(~F.col("is_test")), "city")
    return df.select("source_row", F.coalesce(F.col("city"), F.lit(mode)).alias("city"))


ORACLE["mode_impute"] = Q.with_ctes(
    Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, Q.FEATURES_CTE, f"""
sp AS (SELECT *, {Q.H32} % 10000 < 2000 AS is_test FROM feat),
md AS (SELECT city FROM sp WHERE NOT is_test AND city IS NOT NULL GROUP BY city
       ORDER BY count(*) DESC, city LIMIT 1)""",
    body="SELECT source_row, COALESCE(city, (SELECT city FROM md)) AS city FROM sp")


@register("one_hot", Q.with_ctes(*_FEAT_ALL, """
cats AS (SELECT city AS v, row_number() OVER (ORDER BY city) AS pos
         FROM (SELECT DISTINCT city FROM pre WHERE NOT is_test))""", body="""
SELECT p.source_row, 'cat__city_' || c.v AS feature,
       CASE WHEN p.city = c.v THEN 1.0 ELSE 0.0 END AS value
FROM pre p, cats c WHERE c.pos > 1"""))
def one_hot_q(spark, sf_dir):
    """FEAT-6: one-hot of the collapsed city, sorted categories, first dropped
    (long form: one row per row and dummy)."""
    df = _split_features(spark, sf_dir)
    rc = FE.RareCollapse.fit(df.filter(~F.col("is_test")), "city")
    pre = rc.transform(df)
    cats = FE.fit_categories(pre.filter(~F.col("is_test")), "city")
    cols = FE.one_hot_columns("city", cats, prefix="cat__city_")
    wide = pre.select("source_row", *cols)
    names = [f"cat__city_{v}" for v in cats[1:]]
    return wide.select("source_row", F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in names])))


@register("design_matrix")
def design_matrix_q(spark, sf_dir):
    """FEAT-7: full column transformer output (num__ block + cat__ dummies) for all rows."""
    return TR.build_design(prep.cleaned(spark, sf_dir), dummies=True)[2]


@register("scoring_features", Q.with_ctes(body="""
SELECT source_row AS request_id,
  COALESCE(CAST(qty * 25 AS DOUBLE), 0.0) AS square_footage, COALESCE(CAST(n AS DOUBLE), 0.0) AS bed,
  COALESCE(CAST(n AS DOUBLE) / 2, 0.0) AS baths,
  CAST(NULL AS DOUBLE) AS dom, CAST(NULL AS DOUBLE) AS lot_area_value,
  CAST(NULL AS DOUBLE) AS year_built, CAST(NULL AS DOUBLE) AS school_score,
  COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0) AS total_cost,
  CASE WHEN COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0) > 0
       THEN COALESCE(rehab_budget_ma, 0.0) / (COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0))
       ELSE 0.0 END AS rehab_ratio,
  CASE WHEN contains(lower(concat_ws(', ', CAST(source_row AS VARCHAR), city)), 'charlotte') THEN 'Charlotte'
       WHEN contains(lower(concat_ws(', ', CAST(source_row AS VARCHAR), city)), 'indianapolis') THEN 'Indianapolis'
       ELSE 'Other' END AS city
FROM comps JOIN li ON li.k = comps.source_row"""))
def scoring_features_q(spark, sf_dir):
    """FEAT-9: feature row per scoring request (unknown -> NULL, city from address)."""
    req = standins.scoring_requests(spark, sf_dir)
    f = FE.scoring_features(req, unknown="impute", city="from_address")
    return f.select("request_id", *C.NUMERIC_FEATURES, "city")


# ====================================================================== GRAM / statistics with SQL
_NUM_DESIGN = [f"num__{c}" for c in C.NUMERIC_FEATURES]


def _gram_pairs_sql() -> str:
    parts = []
    for i, a in enumerate(_NUM_DESIGN):
        for b in _NUM_DESIGN[i:]:
            parts.append(f"SELECT '{a}' AS i, '{b}' AS j, round(sum({a} * {b}), 6) AS value "
                         f"FROM std WHERE NOT is_test")
    return "\nUNION ALL ".join(parts)


@register("gram_long", Q.with_ctes(*_FEAT_ALL, body=_gram_pairs_sql()))
def gram_long_q(spark, sf_dir):
    """GRAM: XᵀX of the standardised numeric design block on train rows (long form)."""
    df = _split_features(spark, sf_dir)
    ct = FE.fit_column_transformer(df.filter(~F.col("is_test")), categorical=())
    design = ct.transform(df.filter(~F.col("is_test")))
    return L.gram_long(design, _NUM_DESIGN).select("i", "j", F.round("value", 6).alias("value"))


@register("vif_pair", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, Q.FEATURES_CTE, body="""
SELECT f AS feature, round(1 / (1 - r * r), 6) AS vif
FROM (SELECT corr(square_footage, bed) AS r FROM feat), (VALUES ('square_footage'), ('bed')) t(f)"""))
def vif_pair_q(spark, sf_dir):
    """STAT-4 on two features: VIF from the Gram inverse equals 1/(1 - corr²)."""
    df = prep.features(spark, sf_dir).filter(
        F.col("square_footage").isNotNull() & F.col("bed").isNotNull())
    cols = ["square_footage", "bed"]
    g = L.gram(df.withColumn("__y", F.lit(0.0)), cols, "__y")
    res = L.ols(df.withColumn("__y", F.lit(0.0)), cols, "__y", cov_type="nonrobust", g=g)
    v = L.vif(res, g)
    return spark.createDataFrame([(c, round(v[c], 6)) for c in cols], "feature string, vif double")


_RESID_CTE = """
resid AS (SELECT source_row,
            ln(projected_value_ma) - ln(COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0)) AS e
          FROM recent WHERE COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0) > 0)"""


def _resid_frame(spark, sf_dir) -> DataFrame:
    df = prep.cleaned(spark, sf_dir)
    cost = fin.total_cost(C.PURCHASE_COL, C.REHAB_COL, nulls="zero")
    return df.filter(cost > 0).select(
        "source_row", (F.log(F.col(C.TARGET_COL)) - F.log(cost)).alias("e"))


@register("residual_moments", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, _RESID_CTE, body="""
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(e), 6) AS mean,
       round(avg(power(e - m, 3)) / power(avg(power(e - m, 2)), 1.5), 6) AS skew,
       round(avg(power(e - m, 4)) / power(avg(power(e - m, 2)), 2), 6) AS kurtosis
FROM resid, (SELECT avg(e) AS m FROM resid)"""))
def residual_moments_q(spark, sf_dir):
    """STAT-2 moments of the log value-to-cost residual: n, mean, skew, kurtosis."""
    m = L.residual_moments(_resid_frame(spark, sf_dir), F.col("e"))
    return spark.createDataFrame(
        [(int(m["n"]), round(m["mean"], 6), round(m["skew"], 6), round(m["kurtosis"], 6))],
        "n bigint, mean double, skew double, kurtosis double")


@register("durbin_watson", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, _RESID_CTE, body="""
SELECT round(sum(d * d) / (SELECT sum(e * e) FROM resid), 6) AS durbin_watson
FROM (SELECT e - lag(e) OVER (ORDER BY source_row) AS d FROM resid)"""))
def durbin_watson_q(spark, sf_dir):
    """WIN-2: Durbin–Watson of the residual series in source order (range-partitioned lag)."""
    dw = O.durbin_watson(_resid_frame(spark, sf_dir), F.col("e"), ["source_row"])
    return spark.createDataFrame([(round(dw["durbin_watson"], 6),)], "durbin_watson double")


# ====================================================================== models (rows-only checks)
def _tidy(spark, pairs, key="statistic") -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in pairs],
                                 f"{key} string, value double")


@register("ridge_fit")
def ridge_fit_q(spark, sf_dir):
    """MOD-1: ridge coefficients (alpha by exact LOO) plus the LOO error per alpha."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    rows = [("alpha", t.ridge.alpha)] + [(f"loo_mse_{a}", v) for a, v in t.ridge.loo_mse.items()]
    return t.ridge.terms(spark).unionByName(_tidy(spark, rows, "term"))


@register("ols_hc3")
def ols_hc3_q(spark, sf_dir):
    """STAT-1: OLS coefficients with HC3 std errors, z, p and 95 % CI."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    return t.ols.coef_table(spark)


@register("fit_summary")
def fit_summary_q(spark, sf_dir):
    """STAT-2: R², adj R², robust F, LL, AIC, BIC, DW, omnibus, JB, skew, kurtosis, cond."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir))
    return _tidy(spark, list(t.extras["summary"].items()))


@register("vif")
def vif_q(spark, sf_dir):
    """STAT-4: VIF of every design column incl. the constant."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    return L.vif_table(t.ols, t.gram, spark)


@register("breusch_pagan")
def breusch_pagan_q(spark, sf_dir):
    """STAT-5: studentised Breusch–Pagan LM and F with p-values."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    return _tidy(spark, list(L.breusch_pagan(t.train(), t.ols, "label", t.gram).items()))


@register("anderson_darling")
def anderson_darling_q(spark, sf_dir):
    """STAT-6 / WIN-3: Anderson–Darling normality of the OLS residuals (global rank)."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    ad = O.anderson_darling(t.residuals(), F.col("resid"))
    return _tidy(spark, list(ad.items()))


@register("significant_features")
def significant_features_q(spark, sf_dir):
    """STAT-3: features with HC3 p <= 0.05 and their p-values."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    return L.significant(t.ols, spark)


@register("backward_elimination")
def backward_elimination_q(spark, sf_dir):
    """STAT-7 + FEAT-8: backward elimination on the ad-hoc design matrix."""
    df = _split_features(spark, sf_dir).filter(~F.col("is_test"))
    cols = C.NUMERIC_FEATURES + C.CATEGORICAL_FEATURES
    dm = FE.fit_design_matrix(df, cols)
    x = stored(dm.transform(df.withColumn(
        "label", fin.forward_target(C.TARGET_COL, "log1p")), keep=["label"]), "cut")
    res, kept = L.backward_elimination(x, dm.feature_names, "label")
    rows = [(n, float(b), float(p)) for n, b, p in zip(res.names, res.params, res.pvalues)]
    rows += [("__r2", float(res.rsquared), None), ("__adj_r2", float(res.rsquared_adj), None),
             ("__n_obs", float(res.n), None)]
    return spark.createDataFrame(rows, "feature string, coef double, p_value double")


@register("linear_predict")
def linear_predict_q(spark, sf_dir):
    """MOD-3 (linear): predictions in log space and dollars for every row."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    return TR.linear_predictions(t)


@register("train_test_metrics")
def train_test_metrics_q(spark, sf_dir):
    """MOD-4: train/test R², MAE, RMSE in log space and dollars (ridge)."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    return TR.split_metrics(TR.linear_predictions(t))


@register("forest_fit_predict")
def forest_fit_predict_q(spark, sf_dir):
    """MOD-2 + MOD-3: random forest on log(target), predictions for every row."""
    t = TR.train_forest(prep.cleaned(spark, sf_dir))
    return TR.forest_predictions(t)


@register("forest_importances")
def forest_importances_q(spark, sf_dir):
    """STAT-8: forest feature importances joined to the design names."""
    t = TR.train_forest(prep.cleaned(spark, sf_dir), predict=False)
    return _tidy(spark, list(t.importances.items()), "feature")


# ====================================================================== log analytics (AGG-1/2, SRT, JOIN-2, RPT-1)
from ..functions.text import iso_text  # noqa: E402,F401
from ..operators import reports as RP  # noqa: E402

_ISO = ("(strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' "
        "ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END)")
_EST_LOG = f"est AS (SELECT {_ISO} AS timestamp, user_id FROM events WHERE event_type = 'purchase')"
_LEAD_LOG = (f"lead AS (SELECT {_ISO} AS timestamp, 'user ' || CAST(user_id AS VARCHAR) AS name, "
             f"'user' || CAST(user_id AS VARCHAR) || '@example.invalid' AS email "
             f"FROM events WHERE event_type = 'signup')")
_DAYS = """
est_days AS (SELECT substr(timestamp, 1, 10) AS day, CAST(count(*) AS BIGINT) AS estimates FROM est
             WHERE length(timestamp) > 0 GROUP BY 1),
lead_days AS (SELECT substr(timestamp, 1, 10) AS day, CAST(count(*) AS BIGINT) AS leads FROM lead
              WHERE length(timestamp) > 0 GROUP BY 1)"""


def _logs(spark, sf_dir):
    return standins.event_log(spark, sf_dir), standins.lead_log(spark, sf_dir)


@register("event_totals", f"""
WITH {_EST_LOG}, {_LEAD_LOG}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM est) AS total_estimates,
       (SELECT CAST(count(*) AS BIGINT) FROM lead) AS total_leads""")
def event_totals_q(spark, sf_dir):
    """AGG-1: total estimate submissions and total leads."""
    ev, ld = _logs(spark, sf_dir)
    return RP.report_totals(ev, ld)


@register("estimates_by_day", f"WITH {_EST_LOG}, {_LEAD_LOG}, {_DAYS} SELECT day, estimates AS n FROM est_days")
def estimates_by_day_q(spark, sf_dir):
    """AGG-2: estimate submissions per day key."""
    ev, _ = _logs(spark, sf_dir)
    return RP.daily_counts(ev, event=C.ESTIMATE_EVENT)


@register("leads_by_day", f"WITH {_EST_LOG}, {_LEAD_LOG}, {_DAYS} SELECT day, leads AS n FROM lead_days")
def leads_by_day_q(spark, sf_dir):
    """AGG-2: leads per day key."""
    _, ld = _logs(spark, sf_dir)
    return RP.daily_counts(ld)


@register("daily_report", f"""
WITH {_EST_LOG}, {_LEAD_LOG}, {_DAYS},
top AS (SELECT * FROM est_days ORDER BY day DESC LIMIT 14)
SELECT t.day, t.estimates, COALESCE(l.leads, 0) AS leads
FROM top t LEFT JOIN lead_days l ON l.day = t.day""")
def daily_report_q(spark, sf_dir):
    """JOIN-2 + SRT-1: latest 14 estimate days with full lead counts."""
    ev, ld = _logs(spark, sf_dir)
    return RP.daily_report(ev, ld)


@register("daily_report_compat", f"""
WITH {_EST_LOG}, {_LEAD_LOG}, {_DAYS},
top AS (SELECT * FROM est_days ORDER BY day DESC LIMIT 14),
ltop AS (SELECT * FROM lead_days ORDER BY day DESC LIMIT 14)
SELECT t.day, t.estimates, COALESCE(l.leads, 0) AS leads
FROM top t LEFT JOIN ltop l ON l.day = t.day""")
def daily_report_compat_q(spark, sf_dir):
    """JOIN-2 compat: lead lookup limited to the lead top-14 days, as the page does."""
    ev, ld = _logs(spark, sf_dir)
    return RP.daily_report(ev, ld, compat=True)


@register("latest_leads", f"""
WITH {_LEAD_LOG}
SELECT timestamp, name, email FROM lead
ORDER BY COALESCE(timestamp, '') DESC, email, name LIMIT 20""")
def latest_leads_q(spark, sf_dir):
    """SRT-2: the 20 latest leads by timestamp text."""
    _, ld = _logs(spark, sf_dir)
    return RP.latest_leads(ld).select("timestamp", "name", "email")


@register("admin_report", f"""
WITH {_EST_LOG}, {_LEAD_LOG}, {_DAYS},
top AS (SELECT * FROM est_days ORDER BY day DESC LIMIT 14)
SELECT 'totals' AS section, 'all' AS item, (SELECT CAST(count(*) AS BIGINT) FROM est) AS estimates,
       (SELECT CAST(count(*) AS BIGINT) FROM lead) AS leads, CAST(NULL AS VARCHAR) AS detail
UNION ALL
SELECT 'daily', t.day, t.estimates, COALESCE(l.leads, 0), NULL FROM top t LEFT JOIN lead_days l ON l.day = t.day
UNION ALL
SELECT * FROM (SELECT 'lead', timestamp, NULL, NULL, name || ' | ' || email || ' | ' || name
               FROM lead ORDER BY COALESCE(timestamp, '') DESC, email, name LIMIT 20)""")
def admin_report_q(spark, sf_dir):
    """RPT-1: totals, daily table and latest leads in one tidy frame."""
    ev, ld = _logs(spark, sf_dir)
    return RP.admin_report(ev, ld)


# ====================================================================== sources / sinks round trips
from ..sources import artifacts as AR  # noqa: E402
from ..sources.comps import pick_catalog_table  # noqa: E402
from ..sources.logs import append_epoch, append_jsonl, parse_lines, read_jsonl, read_lines, stamp_records  # noqa: E402


@register("comps_from_catalog", Q.with_ctes(Q.LOADED_CTE, body="SELECT * FROM loaded"))
def comps_from_catalog_q(spark, sf_dir):
    """SRC-2: the test tables and the comps stand-in as session views; the
    table is chosen by the name-prefix rule, then loaded (SRC-1)."""
    from ..sources.tables import TABLES, read_table
    for t in TABLES:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    standins.comps(spark, sf_dir).createOrReplaceTempView("comps_export")
    return load_comps(spark, pick_catalog_table(spark), fmt="table")


@register("jsonl_roundtrip", f"""
SELECT {_ISO} AS timestamp,
       CASE WHEN event_type = 'purchase' THEN 'estimate_submitted' ELSE event_type END AS event,
       CASE WHEN event_type = 'purchase' THEN value * 1000 END AS purchase
FROM events""")
def jsonl_roundtrip_q(spark, sf_dir):
    """SNK-1 + SRC-3: event records appended as JSON lines, read back with
    malformed-line dropping and an explicit schema."""
    path = scratch_path(spark, "events-jsonl")
    append_jsonl(standins.event_log(spark, sf_dir), path)
    back = read_jsonl(spark, path, standins.EVENT_LOG_SCHEMA)
    return back.select("timestamp", "event", "purchase")


_CLOCK = "2024-01-02 03:04:05.250000"


def _appended(spark, sf_dir, payload: DataFrame, name: str, schema, **stamp) -> DataFrame:
    """``payload`` stamped at a fixed time, appended in two epochs of which the second is written twice, read back."""
    path = scratch_path(spark, name)
    rows = stamp_records(payload, clock=F.lit(_CLOCK).cast("timestamp"), **stamp)
    half = F.pmod(F.xxhash64(*rows.columns), F.lit(2))
    for epoch in (0, 1, 1):
        append_epoch(rows.filter(half == epoch), path, epoch)
    return read_jsonl(spark, path, schema)


@register("event_append", """
SELECT '2024-01-02T03:04:05.250000' AS timestamp, 'estimate_submitted' AS event, '/estimate' AS path,
       '10.0.' || CAST(user_id % 250 AS VARCHAR) || '.1' AS client_ip, CAST(NULL AS VARCHAR) AS user_agent,
       'user ' || CAST(user_id AS VARCHAR) AS address, value * 1000 AS purchase
FROM events WHERE event_type = 'purchase'""")
def event_append_q(spark, sf_dir):
    """SNK-1: submissions stamped with time, event and request fields (the payload's own win), appended once per epoch."""
    payload = standins.event_log(spark, sf_dir).filter(F.col("event") == C.ESTIMATE_EVENT).select(
        "client_ip", "address", "purchase")
    back = _appended(spark, sf_dir, payload, "events-appended", standins.EVENT_LOG_SCHEMA, event=C.ESTIMATE_EVENT,
                     request={"path": "/estimate", "client_ip": "0.0.0.0", "user_agent": None})
    return back.select("timestamp", "event", "path", "client_ip", "user_agent", "address", "purchase")


@register("lead_append", """
SELECT '2024-01-02T03:04:05.250000' AS timestamp, 'user ' || CAST(user_id AS VARCHAR) AS name,
       'user' || CAST(user_id AS VARCHAR) || '@example.invalid' AS email, CAST(NULL AS VARCHAR) AS phone,
       props AS comments, 'user ' || CAST(user_id AS VARCHAR) AS address
FROM events WHERE event_type = 'signup'""")
def lead_append_q(spark, sf_dir):
    """SNK-2: leads stamped with the ingest time, appended once per epoch."""
    payload = standins.lead_log(spark, sf_dir).drop("timestamp")
    back = _appended(spark, sf_dir, payload, "leads-appended", standins.LEAD_LOG_SCHEMA)
    return back.select("timestamp", "name", "email", "phone", "comments", "address")


_FAULTY_SQL = f"""
SELECT CASE WHEN k > 3 THEN {_ISO} END AS timestamp,
       CASE WHEN k > 3 THEN CASE WHEN event_type = 'purchase' THEN 'estimate_submitted' ELSE event_type END END AS event,
       CASE WHEN k > 3 AND event_type = 'purchase' THEN value * 1000 END AS purchase,
       CASE k WHEN 0 THEN 'malformed' WHEN 1 THEN 'blank' WHEN 2 THEN 'not an object' WHEN 3 THEN 'not an object' END AS fault,
       CASE k WHEN 0 THEN '{{"timestamp":"' || substr({_ISO}, 1, 6) WHEN 1 THEN '  ' WHEN 2 THEN '42'
              WHEN 3 THEN '["x"]' END AS line
FROM (SELECT *, user_id % 40 AS k FROM events)"""


def _faulty_log(spark, sf_dir) -> str:
    """A folder of JSON lines of all events; those of some users are cut, blank, a bare value or a list."""
    path = scratch_path(spark, "faulty-log")
    log = standins.event_log(spark, sf_dir)
    user = F.regexp_extract("address", "([0-9]+)$", 1).cast("long")
    line = F.to_json(F.struct(*log.columns), {"ignoreNullFields": "false"})
    k = user % 40
    log.select(F.when(k == 0, F.substring(line, 1, 20)).when(k == 1, "  ").when(k == 2, "42").when(k == 3, '["x"]')
               .otherwise(line).alias("value")).write.text(path)
    return path


def _both_sides(good: DataFrame, bad: DataFrame) -> DataFrame:
    return good.select("timestamp", "event", "purchase").unionByName(
        bad.select("fault", "line"), allowMissingColumns=True)


@register("log_quarantine", _FAULTY_SQL)
def log_quarantine_q(spark, sf_dir):
    """SRC-3: all lines of a log with faults, read as records and quarantined lines."""
    parsed = parse_lines(read_lines(spark, _faulty_log(spark, sf_dir)), standins.EVENT_LOG_SCHEMA)
    return _both_sides(parsed.filter("fault is null").select("record.*"), parsed.filter("fault is not null"))


@register("model_meta")
def model_meta_q(spark, sf_dir):
    """SNK-3 / SRC-4 / SRC-5: train, persist params + meta + diagnostics,
    read the meta back with the health fallbacks."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    store = scratch_path(spark, "models")
    _publish(spark, store, t)
    return AR.read_meta(spark, AR.version_path(spark, store)[1])


def _publish(spark, store: str, t) -> str:
    """A trained linear model with its metrics, meta record and diagnostics as a version of a store."""
    metrics = TR.metrics_by_split(TR.linear_predictions(t))
    coef = t.ols.coef_table(spark).filter(~F.isnan("p_value")).select("feature", "p_value")
    cats = t.ridge.terms(spark).filter(F.col("term").startswith("cat__"))
    lists = coef.agg(F.map_from_entries(F.collect_list(F.struct("feature", "p_value"))).alias("p"),
                     F.sort_array(F.collect_list(F.when((F.col("feature") != "const") & (
                         F.col("p_value") <= C.P_VALUE_THRESHOLD), F.col("feature")))).alias("s")).first()
    meta = {"target": C.TARGET_COL, "model_type": "RidgeLOO", "artifact_subdir": "v1_ridge",
            "r2_train": metrics["train"]["r2_log"], "r2_test": metrics["test"]["r2_log"],
            "significance": {"n_obs": int(t.ols.n), "r2": t.ols.rsquared, "adj_r2": t.ols.rsquared_adj,
                             "significant_features": lists["s"], "pvalues": lists["p"]},
            "feature_sets": {"numeric": t.transformer.numeric_names,
                             "categorical": [r["term"] for r in cats.select("term").orderBy("term").collect()]}}
    diags = [("vif", r["feature"], "VIF", r["value"]) for r in L.vif_table(t.ols, t.gram, spark).collect()]
    return AR.publish(spark, store, lambda path: AR.save_linear(spark, path, t.model(), meta, metrics, diags))


# ====================================================================== scoring and audit
from ..operators.scoring import score_requests  # noqa: E402
from .fixedmodel import fixed_model, log_value_sql, scored_sql  # noqa: E402


def _fixed_model(spark):
    """The fixed model as a version of a store, loaded again: nothing is trained."""
    store, model = scratch_path(spark, "models"), fixed_model(spark)
    AR.publish(spark, store, lambda path: AR.save_linear(spark, path, model, FIXED_META))
    return AR.load_model(spark, store)


FIXED_META = {"target": C.TARGET_COL, "model_type": "RidgeLOO", "artifact_subdir": "fixed", "r2_test": 0.0,
              "r2_test_log": 0.75}


@register("admin_report_model", ORACLE["admin_report"] + """
UNION ALL SELECT 'model', 'RidgeLOO fixed', NULL, NULL, '0.75'""")
def admin_report_model_q(spark, sf_dir):
    """RPT-1 with the line of the model in use, read from the store."""
    store = scratch_path(spark, "models")
    AR.publish(spark, store, lambda path: AR.save_linear(spark, path, fixed_model(spark), FIXED_META))
    ev, ld = _logs(spark, sf_dir)
    return RP.admin_report(ev, ld, AR.read_meta(spark, AR.version_path(spark, store)[1]))


_AUDIT_CTE = f"""
audit AS (
  SELECT source_row, cost AS total_cost, projected_value_ma AS actual, exp({log_value_sql("city")}) - 1 AS predicted_arv
  FROM (SELECT *, COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0) AS cost,
          COALESCE(purchase_price_ma, 0.0) + COALESCE(rehab_budget_ma, 0.0) AS total_cost,
          rehab_budget_ma / NULLIF(purchase_price_ma, 0) AS rehab_ratio FROM recent))"""


def _audited(spark, sf_dir) -> DataFrame:
    """Cleaned comps with the audit's definitions, predicted by the saved fixed model."""
    df = prep.engineer(prep.cleaned(spark, sf_dir), ratio_mode="audit", cost_nulls="zero")
    df = schema.add_missing_columns(df, C.NUMERIC_FEATURES + C.CATEGORICAL_FEATURES)
    return _fixed_model(spark).predict(df, "__pred").select(
        "source_row", "total_cost", F.col(C.TARGET_COL).alias("actual"),
        fin.inverse_target("__pred", "log1p").alias("predicted_arv")).withColumn(
        "ratio", fin.value_ratio("predicted_arv", "total_cost"))


@register("audit_sample", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, _AUDIT_CTE, body="""
SELECT source_row, total_cost, actual, round(predicted_arv, 2) AS predicted_arv,
       round(predicted_arv / NULLIF(total_cost, 0), 6) AS ratio
FROM audit ORDER BY md5(CAST(source_row AS VARCHAR) || '|42'), source_row LIMIT 10"""))
def audit_sample_q(spark, sf_dir):
    """AUD-1: ten rows of the audit in seeded-hash order: cost, actual and predicted value, ratio."""
    return smp.seeded_sample(_audited(spark, sf_dir)).select(
        "source_row", "total_cost", "actual", F.round("predicted_arv", 2).alias("predicted_arv"),
        F.round("ratio", 6).alias("ratio"))


@register("audit_describe", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, Q.CLEAN_CTE, _AUDIT_CTE, body="""
SELECT CAST(count(r) AS BIGINT) AS count, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS min,
  """ + ", ".join(f"round(quantile_cont(r, {p}), 6) AS p{round(p * 100)}" for p in C.DESCRIBE_PERCENTILES) + """,
  round(max(r), 6) AS max
FROM (SELECT predicted_arv / NULLIF(total_cost, 0) AS r FROM audit)"""))
def audit_describe_q(spark, sf_dir):
    """AUD-1: distribution of the value-to-cost ratio that the saved model predicts."""
    d = agg.describe(_audited(spark, sf_dir), "ratio")
    return d.select("count", *[F.round(c, 6).alias(c) for c in d.columns if c != "count"])


def _scores(scored: DataFrame) -> DataFrame:
    """Scores rounded where two engines' logarithms may differ in the last digit, by the same arithmetic in both."""
    digits = {"arv_raw": 2, "arv": 2, "clamped_ratio": 6, "max_loan_ltv": 2, "max_loan_ltc": 2, "total_loan": 2,
              "initial_advance": 2, "placement_fee": 2}
    plain = ("total_cost", "arv_clamped", "cash_to_close", "model_type", "model_version")
    scale = {c: F.lit(10.0 ** d) for c, d in digits.items()}
    return scored.select("request_id", *[
        (F.floor(F.col(c) * scale[c] + 0.5).cast("double") / scale[c]).alias(c) if c in digits else c
        for c in scored.columns if c in digits or c in plain])


@register("score_saved", scored_sql("ltv", unknown="impute", city="from_address"))
def score_saved_q(spark, sf_dir):
    """SRC-4 + lifecycle B: a saved model of fixed parameters, loaded from the store, scores every request (LTV loan)."""
    return _scores(score_requests(standins.scoring_requests(spark, sf_dir), _fixed_model(spark), city="from_address"))


@register("score_batch", scored_sql("ltv_ltc", unknown="zero", city="other"))
def score_batch_q(spark, sf_dir):
    """Lifecycle B by the other path: unknown fields are 0, the city is Other, LTV and LTC bound the loan."""
    return _scores(score_requests(standins.scoring_requests(spark, sf_dir), _fixed_model(spark), policy="ltv_ltc",
                                  unknown="zero"))


@register("score_trained")
def score_trained_q(spark, sf_dir):
    """MOD-1 -> SNK-3 -> SRC-4 -> MOD-3: train, publish with metrics, load, score every request."""
    store = scratch_path(spark, "models")
    _publish(spark, store, TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False))
    return score_requests(standins.scoring_requests(spark, sf_dir), AR.load_model(spark, store), city="from_address")


@register("valuation_audit")
def valuation_audit_q(spark, sf_dir):
    """AUD-1: cleaned comps -> audit features -> model prediction -> value/cost
    ratio -> describe (exact percentiles)."""
    t = TR.train_linear(prep.cleaned(spark, sf_dir), diagnostics=False)
    df = prep.engineer(prep.cleaned(spark, sf_dir), ratio_mode="audit", cost_nulls="zero")
    df = schema.add_missing_columns(df, C.NUMERIC_FEATURES + C.CATEGORICAL_FEATURES)
    pred = t.model().predict(df, "__pred").select(
        "source_row", "total_cost", C.TARGET_COL, fin.inverse_target("__pred", "log1p").alias("predicted_arv"))
    ratio = pred.select(fin.value_ratio("predicted_arv", "total_cost").alias("ratio_pred_total"))
    return agg.describe(ratio, "ratio_pred_total")


# ====================================================================== streaming (STR-1..4)
from ..streaming import logs as SL  # noqa: E402


@register("stream_daily_counts", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type,
       CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2""")
def stream_daily_counts_q(spark, sf_dir):
    """STR-2: events read as a stream, watermarked 1-day window counts per type
    (complete mode, drained with availableNow)."""
    from ..sources.tables import read_table
    schema_ = read_table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema_).parquet(f"{sf_dir.rstrip('/')}/events*.parquet")
    out = SL.run_complete(SL.daily_event_counts(stream), "daily")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      "event_type", "n")


@register("stream_closed_days", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n
FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
GROUP BY 1, 2""")
def stream_closed_days_q(spark, sf_dir):
    """STR-2 in append mode: the days that a watermark of one day has closed, written once."""
    from ..sources.tables import read_table
    schema_ = read_table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema_).parquet(f"{sf_dir.rstrip('/')}/events*.parquet")
    out, _ = SL.run_closed(SL.daily_event_counts(stream), "daily")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@register("stream_latest", Q.with_ctes(Q.LOADED_CTE, Q.LATEST_CTE, body="SELECT * FROM latest"))
def stream_latest_q(spark, sf_dir):
    """STR-4: comps arrive as four change files; each micro-batch is merged
    into the stored latest-per-loan table (DED-1)."""
    src = scratch_path(spark, "comps-changes")
    prep.loaded(spark, sf_dir).repartition(4).write.mode("overwrite").parquet(src)
    stream = SL.log_stream(spark, src, spark.read.parquet(src).schema, fmt="parquet",
                           max_files=1)
    state = scratch_path(spark, "comps-latest")
    q = SL.keep_latest_stream(stream, state, scratch_path(spark, "ckpt-latest"),
                              C.ID_COL, C.DATE_COL, "source_row")
    q.awaitTermination()
    return SL.latest_table(spark, state)


@register("stream_score", scored_sql("ltv", unknown="impute", city="from_address"))
def stream_score_q(spark, sf_dir):
    """STR-3: scoring requests read as a stream and scored by the saved model, as ``score_saved`` does in a batch."""
    src = scratch_path(spark, "requests")
    standins.scoring_requests(spark, sf_dir).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    model = _fixed_model(spark)
    scored = SL.score_stream(stream, lambda req: score_requests(req, model, city="from_address"))
    return _scores(SL.run_append(scored, "scored"))


@register("stream_quarantine", _FAULTY_SQL)
def stream_quarantine_q(spark, sf_dir):
    """STR-1: the log with faults read as a stream of lines; records and quarantined lines of every epoch."""
    out = scratch_path(spark, "ingested")
    SL.ingest_lines(SL.line_stream(spark, _faulty_log(spark, sf_dir)), standins.EVENT_LOG_SCHEMA, out,
                    scratch_path(spark, "ckpt-lines")).awaitTermination()
    return _both_sides(*SL.read_ingested(spark, out, standins.EVENT_LOG_SCHEMA))


@register("stream_ingest")
def stream_ingest_q(spark, sf_dir):
    """STR-1: event records as JSON lines ingested incrementally; malformed lines
    go to a quarantine table, good ones to parquet."""
    src = scratch_path(spark, "events-in")
    append_jsonl(standins.event_log(spark, sf_dir), src)
    good, bad = scratch_path(spark, "events-good"), scratch_path(spark, "events-bad")
    q = SL.ingest_with_quarantine(SL.log_stream(spark, src, standins.EVENT_LOG_SCHEMA), good, bad,
                                  scratch_path(spark, "ckpt-ingest"))
    q.awaitTermination()
    return SL.read_epochs(spark, good, standins.EVENT_LOG_SCHEMA)
