"""Fixed values of the valuation domain.

These constants must equal the reference application's for the results to
match; they are stated plainly here and imported everywhere else.
"""

from __future__ import annotations

# ---- fixed values: column roles --------------------------------------------
TARGET_COL = "projected_value_ma"
DATE_COL = "fecha_de_modificacion"
ID_COL = "loan_number"
PURCHASE_COL = "purchase_price_ma"
REHAB_COL = "rehab_budget_ma"
LOT_VALUE_COL = "lot_area_value"
LOT_UNITS_COL = "lot_area_units"

# ---- fixed values: feature allow-list (order matters) ----------------------
NUMERIC_FEATURES = [
    "square_footage", "bed", "baths", "dom",
    "lot_area_value", "year_built", "school_score",
    "total_cost", "rehab_ratio",
]
CATEGORICAL_FEATURES = ["city"]

# ---- fixed values: training parameters -------------------------------------
MONTH_WINDOW = 6
TEST_SIZE = 0.2
RANDOM_STATE = 42
FOREST_TREES = 400
FOREST_DEPTH = 30  # the most that Spark builds; the reference sets no limit
P_VALUE_THRESHOLD = 0.05
RARE_MIN_COUNT = 25
RIDGE_ALPHAS = (0.1, 1.0, 10.0)
NUMERIC_PARSE_RATE = 0.10

# ---- fixed values: units ----------------------------------------------------
SQFT_PER_ACRE = 43560.0

# ---- fixed values: table selection prefixes (lower-cased name starts with) --
TABLE_PREFIXES = ("comp", "sales", "export", "property")

# ---- fixed values: address -> city bucket, first match wins -----------------
CITY_RULES = (("charlotte", "Charlotte"), ("indianapolis", "Indianapolis"))
CITY_DEFAULT = "Other"

# ---- fixed values: valuation guard-rail and loan economics ------------------
ARV_MIN_RATIO = 1.0
ARV_MAX_RATIO = 2.0
CLAMP_TOLERANCE = 1e-6
LTV_LIMIT = 0.70
LTC_LIMIT = 0.90
PLACEMENT_POINTS = 0.0225
ACCOUNT_SETUP_FEE = 1195.0
OTHER_FIXED_FEES = 594.0

# ---- fixed values: log analytics -------------------------------------------
ESTIMATE_EVENT = "estimate_submitted"
REPORT_TOP_DAYS = 14
REPORT_LATEST_LEADS = 20
LEAD_SOURCE = "estimate_form"

# ---- fixed values: audit ----------------------------------------------------
AUDIT_SAMPLE_ROWS = 10
DESCRIBE_PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
