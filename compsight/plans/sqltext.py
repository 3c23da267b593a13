"""Shared ANSI-SQL fragments for the DuckDB oracle of the query catalog.

The oracle re-derives every result from the raw test tables in plain SQL,
independently of the Spark code path.
"""

from __future__ import annotations

AS_OF = "2001-08-01"

# comps stand-in (FIXTURES.md §3), valid in DuckDB
COMPS_CTE = """
li AS (
  SELECT l_orderkey AS k,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS px,
         SUM(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4))) AS tx,
         SUM(l_quantity) AS qty,
         COUNT(*) AS n
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT li.*, o.o_custkey AS u, o.o_orderdate, o.o_orderpriority, na.n_nationkey AS nk, na.n_name
  FROM li
  JOIN orders o ON o.o_orderkey = li.k
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation na ON na.n_nationkey = c.c_nationkey),
comps AS (
  SELECT k AS source_row,
    CASE WHEN k % 97 = 0 THEN NULL ELSE u END AS loan_number,
    CASE WHEN k % 101 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS fecha_de_modificacion,
    CASE WHEN k % 61 = 0 THEN 'N/A' WHEN k % 67 = 0 THEN '0' WHEN k % 71 = 0 THEN NULL
         ELSE CAST(CAST(CAST(px + tx AS DECIMAL(20,4)) * CAST(110 + k % 37 AS DECIMAL(5,0))
                        * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS VARCHAR) END AS projected_value_ma,
    CASE WHEN k % 53 = 0 THEN 0.0 WHEN k % 59 = 0 THEN NULL ELSE CAST(px AS DOUBLE) END AS purchase_price_ma,
    CASE WHEN k % 43 = 0 THEN NULL ELSE CAST(CAST(tx AS DECIMAL(18,2)) AS DOUBLE) END AS rehab_budget_ma,
    CAST(qty * 25 AS DOUBLE) AS square_footage,
    CAST(n AS DOUBLE) AS bed,
    CAST(n AS DOUBLE) / 2 AS baths,
    CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k % 180 AS DOUBLE) END AS dom,
    CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN qty / 128 ELSE qty * 500 END AS DOUBLE) AS lot_area_value,
    CASE o_orderpriority WHEN '1-URGENT' THEN ' Acres' WHEN '2-HIGH' THEN 'Square Feet'
         WHEN '3-MEDIUM' THEN 'sqft' WHEN '4-NOT SPECIFIED' THEN 'acre ' END AS lot_area_units,
    CASE WHEN u % 11 = 0 THEN NULL ELSE CAST(1900 + u % 120 AS DOUBLE) END AS year_built,
    CASE WHEN u % 13 = 0 THEN NULL ELSE CAST(u % 10 AS DOUBLE) END AS school_score,
    CASE WHEN nk < 5 THEN ' Charlotte ' WHEN nk < 8 THEN 'Indianapolis' WHEN nk < 12 THEN 'Atlanta'
         WHEN nk = 12 THEN NULL ELSE n_name || '_' || CAST(u % 5 AS VARCHAR) END AS city
  FROM base)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def num(x: str) -> str:
    """to_number(): guard pattern then TRY_CAST (text input)."""
    s = strip(x)
    return (f"(CASE WHEN regexp_full_match({s}, '(?i)[+-]?((\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?"
            f"|inf(inity)?)') THEN TRY_CAST({s} AS DOUBLE) END)")


LOADED_CTE = """
loaded AS (SELECT * REPLACE (TRY_CAST(fecha_de_modificacion AS DATE) AS fecha_de_modificacion) FROM comps)"""

LATEST_CTE = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY loan_number
                                 ORDER BY fecha_de_modificacion DESC NULLS LAST, source_row DESC) AS rn
    FROM loaded) WHERE rn = 1)"""

CLEAN_CTE = f"""
cleaned AS (
  SELECT * REPLACE ({strip('projected_value_ma')} AS projected_value_ma,
                    {strip('lot_area_units')} AS lot_area_units,
                    {strip('city')} AS city)
  FROM latest WHERE {num('projected_value_ma')} > 0),
lot AS (
  SELECT * REPLACE (
    CASE WHEN contains(lower({strip('lot_area_units')}), 'acre') THEN lot_area_value * CAST(43560 AS DOUBLE)
         ELSE lot_area_value END AS lot_area_value,
    CASE WHEN contains(lower({strip('lot_area_units')}), 'acre') THEN 'sqft'
         ELSE lower({strip('lot_area_units')}) END AS lot_area_units)
  FROM cleaned),
elig AS (
  SELECT * REPLACE ({num('projected_value_ma')} AS projected_value_ma)
  FROM lot WHERE {num('projected_value_ma')} > 0),
recent AS (
  SELECT * FROM elig
  WHERE fecha_de_modificacion >= CAST(DATE '{AS_OF}' - INTERVAL 6 MONTH AS DATE)
     OR (SELECT count(fecha_de_modificacion) FROM elig) = 0)"""

# FEAT-2 on the recent frame: total_cost propagates NULL, rehab_ratio clipped (train_linear)
FEATURES_CTE = """
feat AS (
  SELECT *,
    purchase_price_ma + rehab_budget_ma AS total_cost,
    CASE WHEN rehab_budget_ma / NULLIF(purchase_price_ma, 0) < 0 THEN 0.0
         WHEN rehab_budget_ma / NULLIF(purchase_price_ma, 0) > 5 THEN 5.0
         ELSE rehab_budget_ma / NULLIF(purchase_price_ma, 0) END AS rehab_ratio
  FROM recent)"""


def with_ctes(*parts: str, body: str) -> str:
    """``WITH`` the comps CTE plus the named extra CTE blocks, then the body."""
    ctes = ",".join([COMPS_CTE, *parts])
    return f"WITH {ctes}\n{body}"


def r4(x: str) -> str:
    return f"round({x}, 4)"


H32 = "('0x' || substr(md5(CAST(source_row AS VARCHAR) || '|42'), 1, 8))::BIGINT"

NUMERIC = ["square_footage", "bed", "baths", "dom", "lot_area_value", "year_built",
           "school_score", "total_cost", "rehab_ratio"]

# split flag, rare-city collapse fitted on train rows, exact medians on train
SPLIT_CTE = f"""
sp AS (SELECT *, {H32} % 10000 < 2000 AS is_test FROM feat),
kept AS (SELECT city FROM sp WHERE NOT is_test AND city IS NOT NULL GROUP BY city HAVING count(*) >= 25),
pre AS (SELECT * REPLACE (CASE WHEN city IN (SELECT city FROM kept) THEN city ELSE 'Other' END AS city) FROM sp),
med AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in NUMERIC)} FROM pre WHERE NOT is_test),
imp AS (SELECT source_row, is_test, projected_value_ma, city,
          {", ".join(f"COALESCE({c}, (SELECT m_{c} FROM med)) AS {c}" for c in NUMERIC)} FROM pre),
sc AS (SELECT {", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in NUMERIC)}
       FROM imp WHERE NOT is_test),
std AS (SELECT source_row, is_test,
          {", ".join(f"({c} - (SELECT mu_{c} FROM sc)) / (SELECT CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END FROM sc) AS num__{c}" for c in NUMERIC)}
        FROM imp)"""
