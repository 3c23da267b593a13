"""Stand-in inputs built from the driver's test tables.

The reference's own input (a comps workbook and two JSONL logs) is not
available, so these functions give rows *in the schema the jobs expect*
derived from the TPC-H-like tables.  They do none of the jobs' work: every
cleaning, filtering, fitting and reporting step runs later through the
library's operators on whatever these return.

comps: one row per order with line items (FIXTURES.md §3).
event log / lead log: ``events`` rows, ``purchase`` standing for a submitted
estimate and ``signup`` for a lead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.text import iso_text
from .tables import read_table

COMPS_COLUMNS = [
    "source_row", C.ID_COL, C.DATE_COL, C.TARGET_COL, C.PURCHASE_COL, C.REHAB_COL,
    "square_footage", "bed", "baths", "dom", C.LOT_VALUE_COL, C.LOT_UNITS_COL,
    "year_built", "school_score", "city",
]


def comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw comps table (text where the source is untrusted)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_tax")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    tax = (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)")
    # partial aggregation before the shuffle on the order key
    per_order = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum(price).alias("px"), F.sum(tax).alias("tx"),
        F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"), "o_orderdate",
        "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("u"), "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    base = (per_order.join(orders, "k").join(customer, "u").join(nation, "c_nationkey")
            .withColumnRenamed("c_nationkey", "nk"))

    k, u, nk = F.col("k"), F.col("u"), F.col("nk")
    value = ((F.col("px") + F.col("tx")).cast("decimal(20,4)")
             * (F.lit(110) + k % 37).cast("decimal(5,0)")
             * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,2)")
    prio = F.col("o_orderpriority")
    return base.select(
        k.alias("source_row"),
        F.when(k % 97 == 0, F.lit(None).cast("long")).otherwise(u).alias(C.ID_COL),
        F.when(k % 101 == 0, F.lit("n/a"))
         .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias(C.DATE_COL),
        F.when(k % 61 == 0, F.lit("N/A")).when(k % 67 == 0, F.lit("0"))
         .when(k % 71 == 0, F.lit(None).cast("string"))
         .otherwise(value.cast("string")).alias(C.TARGET_COL),
        F.when(k % 53 == 0, F.lit(0.0)).when(k % 59 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("px").cast("double")).alias(C.PURCHASE_COL),
        F.when(k % 43 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("tx").cast("decimal(18,2)").cast("double")).alias(C.REHAB_COL),
        (F.col("qty") * 25).cast("double").alias("square_footage"),
        F.col("n").cast("double").alias("bed"),
        (F.col("n").cast("double") / 2).alias("baths"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise((k % 180).cast("double"))
         .alias("dom"),
        F.when(prio.isin("1-URGENT", "4-NOT SPECIFIED"), F.col("qty") / 128).otherwise(F.col("qty") * 500)
         .cast("double").alias(C.LOT_VALUE_COL),
        F.when(prio == "1-URGENT", F.lit(" Acres")).when(prio == "2-HIGH", F.lit("Square Feet"))
         .when(prio == "3-MEDIUM", F.lit("sqft")).when(prio == "4-NOT SPECIFIED", F.lit("acre "))
         .otherwise(F.lit(None).cast("string")).alias(C.LOT_UNITS_COL),
        F.when(u % 11 == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(1900) + u % 120).cast("double")).alias("year_built"),
        F.when(u % 13 == 0, F.lit(None).cast("double")).otherwise((u % 10).cast("double"))
         .alias("school_score"),
        F.when(nk < 5, F.lit(" Charlotte ")).when(nk < 8, F.lit("Indianapolis"))
         .when(nk < 12, F.lit("Atlanta")).when(nk == 12, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("n_name"), F.lit("_"), (u % 5).cast("string")))
         .alias("city"),
    )


# Display-style headers as a spreadsheet export would carry them.
DISPLAY_NAMES = {
    "source_row": "Source Row",
    C.ID_COL: "Loan Number",
    C.DATE_COL: " Fecha de Modificacion ",
    C.TARGET_COL: "Projected Value (MA)",
    C.PURCHASE_COL: "Purchase Price - MA",
    C.REHAB_COL: "Rehab Budget / MA",
    "square_footage": "Square Footage",
    "bed": "BED",
    "baths": "Baths",
    "dom": "DOM",
    C.LOT_VALUE_COL: "Lot Area (Value)",
    C.LOT_UNITS_COL: "Lot Area Units",
    "year_built": "Year Built",
    "school_score": "School   Score",
    "city": "City",
}


def comps_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comps with display headers (input to column-name normalisation)."""
    df = comps(spark, sf_dir)
    return df.toDF(*[DISPLAY_NAMES[c] for c in df.columns])


EVENT_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("beds", T.DoubleType()),
    T.StructField("baths", T.DoubleType()),
    T.StructField("sf", T.DoubleType()),
    T.StructField("purchase", T.DoubleType()),
    T.StructField("rehab", T.DoubleType()),
    T.StructField("total_cost", T.DoubleType()),
    T.StructField("arv_raw", T.DoubleType()),
    T.StructField("arv_clamped", T.DoubleType()),
    T.StructField("total_loan", T.DoubleType()),
    T.StructField("cash_to_close", T.DoubleType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("model_version", T.StringType()),
])

LEAD_LOG_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "timestamp", "name", "email", "phone", "comments", "address", "arv", "total_loan",
        "cash_to_close", "source", "client_ip", "user_agent", "model_type", "model_version")
])


def _client(user_id):
    return F.concat(F.lit("10.0."), (user_id % 250).cast("string"), F.lit(".1"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-log records; ``purchase`` rows are estimate submissions."""
    ev = read_table(spark, sf_dir, "events")
    is_est = F.col("event_type") == "purchase"
    null_d = F.lit(None).cast("double")
    cols = {
        "timestamp": iso_text("ts"),
        "event": F.when(is_est, F.lit(C.ESTIMATE_EVENT)).otherwise(F.col("event_type")),
        "path": F.when(is_est, F.lit("/estimate")).otherwise(F.concat(F.lit("/"), "event_type")),
        "client_ip": _client(F.col("user_id")),
        "user_agent": F.lit(None).cast("string"),
        "address": F.concat(F.lit("user "), F.col("user_id").cast("string")),
        "beds": null_d, "baths": null_d, "sf": null_d,
        "purchase": F.when(is_est, F.col("value") * 1000),
        "rehab": null_d, "total_cost": null_d, "arv_raw": null_d, "arv_clamped": null_d,
        "total_loan": null_d, "cash_to_close": null_d,
        "model_type": F.lit(None).cast("string"), "model_version": F.lit(None).cast("string"),
    }
    return ev.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in EVENT_LOG_SCHEMA])


def lead_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead-log records (all text, as the reference stores them); ``signup`` rows."""
    ev = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    uid = F.col("user_id").cast("string")
    cols = {
        "timestamp": iso_text("ts"),
        "name": F.concat(F.lit("user "), uid),
        "email": F.concat(F.lit("user"), uid, F.lit("@example.invalid")),
        "phone": F.lit(None).cast("string"),
        "comments": F.col("props"),
        "address": F.concat(F.lit("user "), uid),
        "arv": (F.col("value") * 1000).cast("string"),
        "total_loan": (F.col("value") * 700).cast("string"),
        "cash_to_close": (F.col("value") * 10).cast("string"),
        "source": F.lit(C.LEAD_SOURCE),
        "client_ip": _client(F.col("user_id")),
        "user_agent": F.lit(None).cast("string"),
        "model_type": F.lit(None).cast("string"),
        "model_version": F.lit(None).cast("string"),
    }
    return ev.select(*[cols[f.name].alias(f.name) for f in LEAD_LOG_SCHEMA])


def scoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate-form submissions in the scoring-input schema, one per comp."""
    c = comps(spark, sf_dir)
    return c.select(
        F.col("source_row").alias("request_id"),
        F.concat_ws(", ", F.col("source_row").cast("string"), F.col("city")).alias("address"),
        F.col("bed").alias("beds"), F.col("baths"), F.col("square_footage").alias("sf"),
        F.col(C.PURCHASE_COL).alias("purchase"), F.col(C.REHAB_COL).alias("rehab"))
