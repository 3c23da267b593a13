"""Exact quantiles of any double, one-hot vectors, latest rows by time of day, streams that replay."""
import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from compsight import config as C
from compsight.operators.features import one_hot_vector
from compsight.operators.quantiles import column_medians, exact_percentiles, wide_percentiles
from compsight.session import scratch_path
from compsight.sources.comps import prepare_comps
from compsight.operators.aggregates import regression_metrics
from compsight.streaming.logs import daily_event_counts, latest_table, log_stream, merge_latest, run_closed

INF = float("inf")


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, INF], [-1.5e308, 1.0, 2.0, 1.5e308], [-INF, -1.0, 0.0, 5e-324, 1e-323, INF],
    [2.0 ** e for e in range(-1070, 1020, 11)], [0.0, -0.0, 0.0], [7.0] * 9 + [8.0],
    [-(3.0 ** e) for e in range(-300, 300, 7)]])
def test_order_statistics_of_any_double(spark, values):
    n = len(values)
    probs = [i / (n - 1) for i in {0, 1, n // 2, n - 1}]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(3)
    got = exact_percentiles(df, "x", probs, names=[f"p{i}" for i in range(len(probs))]).first()
    for i, p in enumerate(probs):
        h = (n - 1) * p
        want = sorted(values)[int(np.floor(h))], sorted(values)[int(np.ceil(h))]
        assert want[0] <= got[f"p{i}"] <= want[1]


def test_medians_of_columns_with_infinity_and_without_values(spark):
    df = spark.createDataFrame([(1.0, INF, None), (2.0, INF, None), (4.0, 1.0, None)], "a double, b double, c double")
    assert column_medians(df, ["a", "b", "c"]) == {"a": 2.0, "b": INF, "c": None}


def test_one_hot_vector_baseline_and_null_are_zeros(spark):
    rows = [(i, v) for i, v in enumerate(["b", "a", "c", None, "a", "d"])]
    got = {r.i: r.onehot.toArray().tolist()
           for r in one_hot_vector(spark.createDataFrame(rows, "i int, v string"), "v").collect()}
    assert got == {0: [1, 0, 0], 1: [0, 0, 0], 2: [0, 1, 0], 3: [0, 0, 0], 4: [0, 0, 0], 5: [0, 0, 1]}
    one = one_hot_vector(spark.createDataFrame([("a",), (None,)], "v string"), "v").collect()
    assert all(len(r.onehot) == 0 for r in one)


def test_latest_row_of_a_day_is_by_time(spark):
    rows = [(7, "2024-05-01 18:00:00", 1), (7, "2024-05-01 09:00:00", 2), (8, "2024-05-01", 3), (8, None, 4)]
    df = spark.createDataFrame(rows, f"{C.ID_COL} int, {C.DATE_COL} string, source_row int")
    got = prepare_comps(df)
    assert {(r[C.ID_COL], r[C.DATE_COL], r.source_row) for r in got.collect()} == {
        (7, dt.date(2024, 5, 1), 1), (8, dt.date(2024, 5, 1), 3)}


def test_replayed_epoch_changes_nothing(spark):
    path = scratch_path(spark, "replay")
    body = merge_latest(path, "id", "day", "n")
    batches = [spark.createDataFrame(rows, "id int, day string, n int") for rows in (
        [(1, "a", 1), (2, "b", 2)], [(1, "c", 3)], [(2, "a", 4), (3, "a", 5)])]
    for epoch, batch in enumerate(batches):
        body(batch, epoch)
    first = sorted(latest_table(spark, path).collect())
    body(batches[2], 2)
    assert sorted(latest_table(spark, path).collect()) == first == [(1, "c", 3), (2, "b", 2), (3, "a", 5)]


def test_percentiles_of_hot_groups_columns_and_null_groups(spark):
    """Ties of a third, a NULL group, tiny groups and two columns, against NumPy."""
    rng = np.random.default_rng(4)
    n = 60_000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b"], n)).astype(object)
    g[rng.random(n) < 0.1] = None
    x, y = rng.normal(size=n).round(3), rng.lognormal(3, 3, n)
    x[rng.random(n) < 0.33] = 0.5
    rows = [(k, float(u), None if w > 1e4 else float(w)) for k, u, w in zip(g, x, y)]
    rows += [("one", 7.0, None), ("two", 1.0, 2.0), ("two", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {r.g: r for r in wide_percentiles(df, ["x", "y"], probs, ["g"], [F.count(F.lit(1)).alias("rows")]).collect()}
    assert set(got) == {None, "hot", "a", "b", "one", "two"}
    for k, r in got.items():
        mine = [row for row in rows if row[0] == k]
        assert r.rows == len(mine)
        for i, col in ((0, 1), (1, 2)):
            values = [row[col] for row in mine if row[col] is not None]
            for j, p in enumerate(probs):
                want = np.quantile(values, p) if values else None
                assert r[f"q{i}_{j}"] == (want if want is None else pytest.approx(want, rel=1e-12))
    assert exact_percentiles(df.filter("g = 'one'"), "y", [0.5]).count() == 0
    assert exact_percentiles(df.limit(0), "y", [0.5], ["g"]).count() == 0


def test_closed_days_and_late_rows(spark):
    """Rows behind the watermark when they arrive are counted, and change no day that was written."""
    src = scratch_path(spark, "late")
    day = dt.datetime(2024, 5, 1)
    batches = [[(day + dt.timedelta(hours=h), "a") for h in range(0, 24 * 6, 6)],
               [(day + dt.timedelta(hours=24 * 6), "b")],
               [(day + dt.timedelta(hours=1), "a"), (day + dt.timedelta(hours=26), "a")]]
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files in the order of their times
    stream = log_stream(spark, src, spark.read.parquet(src).schema, "parquet", max_files=1)
    out, late = run_closed(daily_event_counts(stream), "t")
    got = sorted((r.w.start.day, r.event_type, r.n) for r in out.collect())
    assert got == [(d, "a", 4) for d in range(1, 6)] and late == 2


def test_metrics_leave_out_rows_without_a_prediction(spark):
    rows = [(1.0, 1.5), (2.0, 2.0), (3.0, None), (None, 4.0), (4.0, 3.0)]
    r = regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()
    assert r.n == 3 and r.mae == 0.5 and r.r2 == pytest.approx(1 - 1.25 / 4.666666666666667)
