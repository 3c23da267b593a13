"""Every catalog query with an oracle matches DuckDB at sf0.01 (the driver's gate);
the flagship runs on sf0.001."""

import pytest

from compsight.plans.catalog import ORACLE, QUERIES
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.01"
FAST = ["comps_load", "latest_per_loan", "stage_counts", "eligible", "recent_window", "loan_ltv",
        "loan_ltv_ltc_raw", "arv_clamp", "split_exact", "describe_ratio", "median_impute",
        "one_hot", "gram_long", "durbin_watson", "daily_report_compat", "admin_report",
        "stream_daily_counts", "city_summary"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert r["ok"], r.get("detail")


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "median_purchase" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
