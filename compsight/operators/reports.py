"""Log analytics (AGG-1/2, SRT-1/2, JOIN-2, RPT-1).

Both logs are scanned once per report; per-day counts are hash aggregates
with partial aggregation (a hot day costs nothing extra); top-k uses
``TakeOrderedAndProject`` (per-task top-k, no global sort); the daily join
has a 14-row side, broadcast by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import day_key


def report_totals(events: DataFrame, leads: DataFrame) -> DataFrame:
    """AGG-1: total estimate events and total leads (two one-row aggregates)."""
    est = events.agg(F.count_if(F.col("event") == C.ESTIMATE_EVENT).alias("total_estimates"))
    lds = leads.agg(F.count(F.lit(1)).alias("total_leads"))
    # two single-row aggregates side by side without a join
    return est.select(F.lit(1).alias("__k"), "*").unionByName(
        lds.select(F.lit(2).alias("__k"), "*"), allowMissingColumns=True).agg(
        F.max("total_estimates").alias("total_estimates"),
        F.max("total_leads").alias("total_leads"))


def daily_counts(df: DataFrame, ts: str = "timestamp", event: str | None = None,
                 name: str = "n") -> DataFrame:
    """AGG-2: rows per day key (first 10 characters of the timestamp text)."""
    if event is not None:
        df = df.filter(F.col("event") == event)
    d = day_key(ts)
    return (df.select(d.alias("day")).filter(F.col("day").isNotNull()).groupBy("day")
            .agg(F.count(F.lit(1)).alias(name)))


def top_days(daily: DataFrame, n: int = C.REPORT_TOP_DAYS) -> DataFrame:
    """SRT-1: latest ``n`` days, descending (day keys are unique)."""
    return daily.orderBy(F.col("day").desc()).limit(n)


def latest_leads(leads: DataFrame, n: int = C.REPORT_LATEST_LEADS,
                 tiebreak: tuple[str, ...] = ("email", "name")) -> DataFrame:
    """SRT-2: latest ``n`` leads by timestamp text (missing sorts as '')."""
    order = [F.coalesce(F.col("timestamp"), F.lit("")).desc()]
    order += [F.col(c).asc_nulls_last() for c in tiebreak]
    return leads.orderBy(*order).limit(n)


def daily_report(events: DataFrame, leads: DataFrame, compat: bool = False,
                 n: int = C.REPORT_TOP_DAYS) -> DataFrame:
    """JOIN-2: the latest ``n`` estimate days with their lead counts (0 if none).

    ``compat=True`` reproduces the reference page, whose lead lookup only
    holds the lead top-``n`` days; the default looks up full lead counts.
    """
    est = top_days(daily_counts(events, event=C.ESTIMATE_EVENT, name="estimates"), n)
    lead_days = daily_counts(leads, name="leads")
    if compat:
        lead_days = top_days(lead_days, n)
    return (est.join(lead_days, "day", "left")
            .select("day", "estimates", F.coalesce(F.col("leads"), F.lit(0)).alias("leads")))


def admin_report(events: DataFrame, leads: DataFrame, meta: DataFrame | None = None,
                 compat: bool = False) -> DataFrame:
    """RPT-1 as one tidy frame: section, item, estimates, leads, detail."""
    tot = report_totals(events, leads).select(
        F.lit("totals").alias("section"), F.lit("all").alias("item"),
        F.col("total_estimates").alias("estimates"), F.col("total_leads").alias("leads"),
        F.lit(None).cast("string").alias("detail"))
    daily = daily_report(events, leads, compat).select(
        F.lit("daily").alias("section"), F.col("day").alias("item"),
        F.col("estimates").cast("long"), F.col("leads").cast("long"),
        F.lit(None).cast("string").alias("detail"))
    latest = latest_leads(leads).select(
        F.lit("lead").alias("section"), F.col("timestamp").alias("item"),
        F.lit(None).cast("long").alias("estimates"), F.lit(None).cast("long").alias("leads"),
        F.concat_ws(" | ", "name", "email", "phone", "address").alias("detail"))
    out = tot.unionByName(daily).unionByName(latest)
    if meta is not None:
        out = out.unionByName(meta.select(
            F.lit("model").alias("section"),
            F.concat_ws(" ", "model_type", "model_version").alias("item"),
            F.lit(None).cast("long").alias("estimates"), F.lit(None).cast("long").alias("leads"),
            F.format_number(F.col("r2_test"), 2).alias("detail")))
    return out
