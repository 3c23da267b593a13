"""Golden scalar cases (FIXTURES.md §4) and edge cases of the expressions."""

import datetime as dt
import math

from pyspark.sql import functions as F

from compsight.functions import distributions as D
from compsight.functions import finance as fin
from compsight.functions.numeric import to_date, to_number
from compsight.functions.text import city_bucket, day_key, normalize_name, normalize_names


def test_to_number_cases(spark):
    vals = ["12d", "nan", "", "1,000", " 12 ", "1e3", "0x1F", "-2.5", ".5", "inf", None, "N/A"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_number("s")).collect()]
    assert got[:6] == [None, None, None, None, 12.0, 1000.0]
    assert got[6] is None and got[7] == -2.5 and got[8] == 0.5 and math.isinf(got[9])
    assert got[10] is None and got[11] is None


def test_to_date_bad_is_null(spark):
    df = spark.createDataFrame([("2024-02-29",), ("n/a",), (None,)], "s string")
    assert [r[0] for r in df.select(to_date("s")).collect()] == [dt.date(2024, 2, 29), None, None]


def test_loan_ltv_golden(spark):
    df = spark.createDataFrame([(235000.0, 70000.0, 385346.6413382565)], "p double, r double, a double")
    cl = fin.clamp_value("a", fin.total_cost("p", "r"))
    row = df.select(*[v.alias(k) for k, v in cl.items()], "p", "r").select(
        "*", *[v.alias(k) for k, v in fin.size_loan("arv", "p", "r", "ltv").items()]).first()
    assert row.total_cost == 305000.0
    assert row.arv_clamped is False
    assert abs(row.total_loan - 269742.64893677953) < 1e-6
    assert row.cash_to_close == 43116.0


def test_clamp_cases(spark):
    df = spark.createDataFrame([(100000.0, 50000.0), (100000.0, 500000.0), (0.0, 50000.0)],
                               "cost double, raw double")
    rows = df.select(*[v.alias(k) for k, v in fin.clamp_value("raw", "cost").items()]).collect()
    assert (rows[0].arv, rows[0].clamped_ratio, rows[0].arv_clamped) == (100000.0, 1.0, True)
    assert (rows[1].arv, rows[1].clamped_ratio, rows[1].arv_clamped) == (200000.0, 2.0, True)
    assert (rows[2].arv, rows[2].clamped_ratio, rows[2].arv_clamped) == (50000.0, None, False)


def test_half_even(spark):
    df = spark.createDataFrame([(43116.5,), (43115.5,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 0)).collect()] == [43116.0, 43116.0]


def test_month_end_cutoff(spark):
    from compsight.operators.clean import filter_recent
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 2, 28),)],
                               "fecha_de_modificacion date")
    kept = filter_recent(df, 6, "2024-08-31").collect()
    assert [r[0] for r in kept] == [dt.date(2024, 2, 29)]


def test_recent_all_null_is_noop(spark):
    from compsight.operators.clean import filter_recent
    df = spark.createDataFrame([(None,), (None,)], "fecha_de_modificacion date")
    assert filter_recent(df, 6, "2024-08-31").count() == 2


def test_lot_area(spark):
    from compsight.operators.clean import normalize_lot_area
    df = spark.createDataFrame([(0.5, " Acres"), (100.0, "Square Feet"), (3.0, None)],
                               "lot_area_value double, lot_area_units string")
    rows = normalize_lot_area(df).collect()
    assert (rows[0][0], rows[0][1]) == (21780.0, "sqft")
    assert (rows[1][0], rows[1][1]) == (100.0, "square feet")
    assert (rows[2][0], rows[2][1]) == (3.0, None)


def test_rehab_ratio_modes(spark):
    df = spark.createDataFrame([(0.0, 10.0)], "p double, r double")
    got = df.select(*[fin.rehab_ratio("p", "r", m).alias(m) for m in fin.REHAB_RATIO_MODES]).first()
    assert (got.train_linear, got.train_forest, got.audit, got.score) == (None, 0.0, None, 1.0)


def test_city_bucket(spark):
    df = spark.createDataFrame([("CHARLOTTE near Indianapolis",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(city_bucket("a")).collect()] == ["Charlotte", "Other", "Other"]


def test_day_key(spark):
    df = spark.createDataFrame([("2024-01-05T10:00:00",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(day_key("t")).collect()] == ["2024-01-05", None, None]


def test_normalize_names():
    assert normalize_name(" Purchase Price - MA ") == "purchase_price_ma"
    assert normalize_names(["A b", "a-b", "C"]) == ["a_b", "a_b_2", "c"]


def test_distribution_tails():
    assert abs(D.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(D.f_sf(4.0, 2, 10) - 1.8 ** -5) < 1e-12  # closed form for d1 = 2
    assert abs(D.t_two_sided(2.228138851986273, 10) - 0.05) < 1e-9
    assert abs(D.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
