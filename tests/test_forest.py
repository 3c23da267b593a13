"""The forest's size, and saved models against those in memory."""

import pytest
from pyspark.sql import functions as F

from compsight.operators import forest as FO
from compsight.operators.scoring import score_requests
from compsight.plans import catalog, prep, training
from compsight.plans.fixedmodel import fixed_model
from compsight.session import scratch_path, stored
from compsight.sources import artifacts, standins
from compsight.streaming import logs
from conftest import SF001


def test_queries_fit_the_whole_forest(spark, monkeypatch):
    asked, fit = [], training.train_forest

    def small(df, num_trees=fit.__defaults__[0], max_depth=fit.__defaults__[1], **more):
        asked.append((num_trees, max_depth))
        return fit(df, num_trees=2, max_depth=3, **more)

    monkeypatch.setattr(training, "train_forest", small)
    for name in ("forest_fit_predict", "forest_importances"):
        assert catalog.QUERIES[name](spark, SF001).count() > 0
    assert asked == [(400, 30)] * 2


def rows(df):
    return {r["request_id"]: tuple(v for k, v in r.asDict().items() if k != "model_version") for r in df.collect()}


def test_saved_forest_scores_as_in_memory(spark):
    t = training.train_forest(prep.cleaned(spark, SF001), num_trees=5, max_depth=6)
    store, metrics = scratch_path(spark, "store"), training.metrics_by_split(training.forest_predictions(t))
    artifacts.publish(spark, store, lambda p: artifacts.save_forest(spark, p, t.scorer(), {"target": "x", "r2_test": 0.5},
                                                                    metrics))
    again = artifacts.load_model(spark, store)
    assert again.forest.getNumTrees == 5 and (again.version, again.transform) == ("v00000001", "log")
    req = standins.scoring_requests(spark, SF001)
    want = rows(score_requests(req, t.scorer(), city="from_address"))
    assert rows(score_requests(req, again, city="from_address")) == want and want
    path = artifacts.version_path(spark, store)[1]
    saved = {(r["split"], r["metric"]): r["value"] for r in spark.read.parquet(f"{path}/metrics").collect()}
    assert saved["test", "r2_log"] == metrics["test"]["r2_log"]
    assert artifacts.read_meta(spark, path).first()["r2_test"] == 0.5


def test_saved_linear_model_scores_as_in_memory_in_batch_and_stream(spark):
    t = training.train_linear(prep.cleaned(spark, SF001), diagnostics=False)
    store = scratch_path(spark, "store")
    version = catalog._publish(spark, store, t)
    loaded = artifacts.load_model(spark, store, version)
    req = standins.scoring_requests(spark, SF001)
    want = rows(score_requests(req, t.model(), city="from_address"))
    assert want and rows(score_requests(req, loaded, city="from_address")) == want
    src = scratch_path(spark, "req")
    req.write.parquet(src)
    stream = spark.readStream.schema(req.schema).parquet(src)
    out = logs.run_append(logs.score_stream(stream, lambda r: score_requests(r, loaded, city="from_address")), "scored")
    assert rows(out) == want
    # the model's predictions are those of the fit
    fit = {r.source_row: r.pred_log for r in training.linear_predictions(t).collect()}
    pre = prep.engineer(prep.cleaned(spark, SF001))
    got = {r.source_row: r.p for r in t.model().predict(pre, "p").select("source_row", "p").collect()}
    assert got == pytest.approx(fit, rel=1e-12)


def test_versions_stand_side_by_side(spark):
    store, model = scratch_path(spark, "store"), fixed_model(spark)
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, store)

    def broken(path):
        artifacts.save_linear(spark, path, model, {"target": "x"})
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        artifacts.publish(spark, store, broken)
    assert artifacts.versions(spark, store) == []
    for intercept in (1.0, 2.0):
        model.intercept = intercept
        artifacts.publish(spark, store, lambda p: artifacts.save_linear(spark, p, model, {"target": "x"}))
    assert artifacts.versions(spark, store) == ["v00000001", "v00000002"]
    assert artifacts.load_model(spark, store).intercept == 2.0
    first = artifacts.load_model(spark, store, "v00000001")
    assert first.intercept == 1.0 and first.numeric == model.numeric and first.version == "v00000001"
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, store, "v00000003")


def test_many_cities_collapse_save_and_score(spark):
    """1,500 kept cities: nothing is cut, no list of them is on the driver."""
    df = spark.range(6_000).select(F.format_string("city %04d", F.col("id") % 1_500).alias("city"), F.col("id"))
    from compsight.operators.features import RareCollapse, fit_categories
    collapse = RareCollapse.fit(df, "city", min_count=4)
    assert collapse.kept.count() == 1_500 == len(fit_categories(df, "city"))
    assert RareCollapse.fit(df, "city", min_count=5).transform(df).filter("city != 'Other'").count() == 0
    kept = collapse.transform(df.union(spark.createDataFrame([(None, -1), ("new", -2)], "city string, id long")))
    assert {r.id: r.city for r in kept.filter("id < 0").collect()} == {-1: "Other", -2: "Other"}
    assert kept.filter("id >= 0 AND city = 'Other'").count() == 0


def table(spark, n, seed, distinct=12):
    """Rows with a few values a column, a city and a label of its own in each row."""
    import numpy as np

    g = np.random.default_rng(seed)
    x, city = g.integers(0, distinct, (n, 3)).astype(float), g.integers(0, 5, n)
    y = 12 + x[:, 0] * 0.1 + np.sin(x[:, 1]) + 0.3 * (city == 2) + g.normal(0, 0.05, n)
    return [(int(i), bool(i % 5 == 0), float(y[i]), *map(float, x[i]), f"c{city[i]}") for i in range(n)]


TABLE = "source_row long, is_test boolean, label double, a double, b double, c double, city string"


def fitted(spark, rows, **more):
    kept = stored(FO.with_keys(spark.createDataFrame(rows, TABLE)), "rows")
    levels = sorted({r[-1] for r in rows})
    f = FO.fit(kept, ["a", "b", "c"], "city", levels, "label", ~F.col("is_test"), **more)
    return f, {r.source_row: r.p for r in f.fitted(kept, "p").collect()}, kept


def test_trees_are_those_of_spark_on_the_drawn_rows(spark):
    """Each tree of ours is Spark's tree on its drawn rows, repeated as often as drawn; so are the importances."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = table(spark, 400, 1)
    f, got, kept = fitted(spark, rows, num_trees=3, max_depth=4)
    keys = kept.orderBy("source_row").select("key", "dup").collect()
    hashes = FO.row_hashes(np.array([k.key for k in keys]), np.array([k.dup for k in keys], np.int32))
    names, want, shares = ["a", "b", "c", "city_c1", "city_c2", "city_c3", "city_c4"], np.zeros(len(rows)), np.zeros(7)
    vectors = VectorAssembler(inputCols=names, outputCol="x")
    for tree in range(3):
        counts = FO.bootstrap_counts(hashes, tree, 42)
        wide = [(r[0], r[1], r[2], *r[3:6], *(float(r[6] == c) for c in ("c1", "c2", "c3", "c4")), int(n))
                for r, n in zip(rows, counts)]
        df = vectors.transform(spark.createDataFrame(wide, "id long, test boolean, label double, a double, b double, c double, "
                                                     + ", ".join(f"{n} double" for n in names[3:]) + ", n int")).coalesce(1)
        drawn = df.filter("NOT test AND n > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n"))))
        model = RandomForestRegressor(labelCol="label", featuresCol="x", numTrees=1, maxDepth=4, maxBins=64, bootstrap=False,
                                      featureSubsetStrategy="all").fit(drawn)
        want += [r.prediction for r in model.transform(df).orderBy("id").collect()]
        shares += model.featureImportances.toArray()
    assert [got[i] for i in range(len(rows))] == pytest.approx(want / 3, rel=1e-12)
    assert [f.importances()[n] for n in names] == pytest.approx(shares / 3, rel=1e-9, abs=1e-15)


def test_the_fit_takes_as_many_jobs_for_many_deep_trees(spark):
    """One pass, not one for each level and each group of nodes."""
    df, sc = prep.cleaned(spark, SF001), spark.sparkContext
    jobs = {}
    for trees, depth in ((2, 2), (24, 30)):
        group = f"forest-{trees}"
        sc.setJobGroup(group, group)
        training.forest_predictions(training.train_forest(df, num_trees=trees, max_depth=depth)).collect()
        jobs[trees] = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[24] <= jobs[2] + 2


def test_nodes_as_units_give_the_same_trees(spark, monkeypatch):
    """Over more rows than a task may hold the upper nodes are split by passes: same trees, also for a node that
    stays too large because its rows are equal."""
    rows = table(spark, 500, 2, distinct=40) + [(1_000 + i, i % 4 == 0, 11.0, 50.0, 0.0, 0.0, "c0") for i in range(150)]
    f, want, _ = fitted(spark, rows, num_trees=5, max_depth=30)
    monkeypatch.setattr(FO, "UNIT_ROWS", 90)
    g, got, kept = fitted(spark, rows, num_trees=5, max_depth=30)
    assert g.trees.filter("part >= 0").select("tree", "part").distinct().count() > 5 * 3
    assert got == pytest.approx(want, rel=1e-13) and g.importances() == pytest.approx(f.importances(), rel=1e-9, abs=1e-15)
    scored = {r.source_row: r.p for r in g.predict(kept, "p").collect()}
    assert scored == got and {r.source_row: r.p for r in f.predict(kept, "p").collect()} == want
    _, shallow, _ = fitted(spark, rows, num_trees=5, max_depth=1)
    monkeypatch.undo()
    assert shallow == pytest.approx(fitted(spark, rows, num_trees=5, max_depth=1)[1], rel=1e-13)


def test_repeated_and_null_rows_are_drawn_one_by_one(spark):
    rows = [(7, False, 12.0, 1.0, 2.0, 3.0, "c1")] * 40 + [(None, False, 12.5, 1.0, 2.0, 3.0, "c1")] * 40 + \
        [(None, None, 12.7, 1.0, 2.0, 3.0, "c1")] * 3
    kept = stored(FO.with_keys(spark.createDataFrame(rows, TABLE)), "rows")
    f = FO.fit(kept, ["a", "b", "c"], "city", ["c1"], "label", ~F.col("is_test"), num_trees=9, max_depth=30)
    out = f.fitted(kept, "p").collect()
    weights = {tuple(memoryview(r.weight).cast("i")) for r in f.trees.collect()}
    assert len(out) == len(rows) and len({r.p for r in out}) == 1 and 12.1 < out[0].p < 12.4
    # One leaf a tree, of about 80 draws: if equal rows were drawn together, these would be sums of two counts times 40.
    assert len(weights) > 3 and all(len(w) == 1 and 40 < w[0] < 120 for w in weights)
    assert set(f.importances().values()) == {0.0}


def test_forest_scores_a_stream_as_a_batch(spark):
    t = training.train_forest(prep.cleaned(spark, SF001), num_trees=3, max_depth=8)
    req, src = standins.scoring_requests(spark, SF001), scratch_path(spark, "req")
    req.write.parquet(src)
    stream = spark.readStream.schema(req.schema).parquet(src)
    out = logs.run_append(logs.score_stream(stream, lambda r: score_requests(r, t.scorer(), city="from_address")), "scored")
    assert rows(out) == rows(score_requests(req, t.scorer(), city="from_address"))


def test_importances_need_no_predictions(spark, monkeypatch):
    """The same trees, whether rows are predicted or not, and from units of nodes."""
    rows = table(spark, 300, 3, distinct=30)
    whole, _, kept = fitted(spark, rows, num_trees=4, max_depth=30)
    args = (kept, ["a", "b", "c"], "city", sorted({r[-1] for r in rows}), "label", ~F.col("is_test"), 4, 30)
    alone = FO.fit(*args, predict=False)
    assert {tuple(r) for r in alone.trees.collect()} == {tuple(r) for r in whole.trees.collect()} and alone.totals is None
    assert alone.importances() == pytest.approx(whole.importances(), rel=1e-12)
    assert sum(alone.importances().values()) == pytest.approx(1.0)
    monkeypatch.setattr(FO, "UNIT_ROWS", 60)
    assert FO.fit(*args, predict=False).importances() == pytest.approx(whole.importances(), rel=1e-9, abs=1e-15)
