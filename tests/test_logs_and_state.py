"""Quarantine with both sides, keyed appends, bucketed stream state, ranks under ties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compsight.operators import ordered
from compsight.plans.catalog import ORACLE, QUERIES
from compsight.session import scratch_path
from compsight.sources.logs import append_epoch, parse_lines, read_jsonl, read_lines, stamp_records
from compsight.streaming import logs as SL
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
LINES = ['{"a": 1, "b": "x"}', "", "   ", "{oops", '{"a": "no number"}', "42", "null", '["x"]', "text", '{"b": "only"}', "{}"]
FAULTS = [None, "blank", "blank", "malformed", "malformed", "not an object", "not an object", "not an object",
          "not an object", None, None]


@pytest.mark.parametrize("name", ["event_append", "lead_append", "log_quarantine", "stream_quarantine", "stream_latest"])
def test_matches_duckdb(spark, name):
    r = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert r["ok"], r.get("detail")


def test_every_line_is_on_one_side(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(path)
    rows = parse_lines(read_lines(spark, path), SCHEMA).collect()
    assert [r.line for r in rows] == LINES and [r.fault for r in rows] == FAULTS
    assert [tuple(r.record) for r in rows if r.record] == [(1, "x"), (None, "only"), (None, None)]
    assert read_lines(spark, path + "-absent").count() == 0

    out, ckpt = scratch_path(spark, "sides"), scratch_path(spark, "ckpt")
    for _ in range(2):  # the second run has nothing new
        SL.ingest_lines(SL.line_stream(spark, path), SCHEMA, out, ckpt).awaitTermination()
    good, bad = SL.read_ingested(spark, out, SCHEMA)
    assert good.count() == 3 and {r.epoch for r in good.collect()} == {0}
    assert sorted((r.line, r.fault) for r in bad.collect()) == sorted((x, f) for x, f in zip(LINES, FAULTS) if f)


def test_an_epoch_appends_once_and_the_payload_wins(spark):
    path = scratch_path(spark, "appended")
    payload = spark.createDataFrame([("p", 1.5)], "path string, x double")
    clock = F.lit("2024-05-01 10:00:00").cast("timestamp")
    for epoch in (0, 1, 1):
        append_epoch(stamp_records(payload, "e", {"path": "/q", "agent": None}, clock), path, epoch)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("timestamp", "event", "path", "agent", "x")])
    assert [tuple(r) for r in read_jsonl(spark, path, schema).collect()] == [
        ("2024-05-01T10:00:00", "e", "p", None, "1.5")] * 2


def test_a_batch_rewrites_its_own_buckets_only(spark):
    path = scratch_path(spark, "state")
    body = SL.merge_latest(path, "id", "day", "n", buckets=8)
    first = spark.createDataFrame([(i, "a", i) for i in range(100)] + [(None, "a", 7), (None, "b", 8)], "id int, day string, n int")
    body(first, 0)
    before = SL._manifest(spark, path, 0)
    for _ in range(2):  # a replay replaces itself
        body(spark.createDataFrame([(5, "b", 500), (5, "a", 501)], first.schema), 1)
        after = SL._manifest(spark, path, 1)
        changed = [b for b in after if after[b] != before[b]]
        assert len(before) == 8 and len(changed) == 1 and after[changed[0]] == 1
        rows = {r.id: r.n for r in SL.latest_table(spark, path).collect()}
        assert rows == {**{i: i for i in range(100)}, 5: 500, None: 8}
        assert SL.latest_table(spark, path).columns == ["id", "day", "n"]
    body(spark.createDataFrame([(200, "a", 1)], first.schema), 2)
    body(spark.createDataFrame([], first.schema), 3)
    assert SL.latest_table(spark, path).count() == 102


def test_ranks_of_a_column_that_is_mostly_one_value(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(5000) < 0.9, 0.25, rng.standard_normal(5000))
    got = ordered.anderson_darling(spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7), F.col("x"), 4)
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    from compsight.functions.distributions import log_normal_cdf
    i = np.arange(1, len(z) + 1)
    want = -len(z) - np.sum((2 * i - 1) * (log_normal_cdf(z) + log_normal_cdf(-z)[::-1])) / len(z)
    assert got["n"] == 5000 and got["statistic"] == pytest.approx(want, rel=1e-9)
