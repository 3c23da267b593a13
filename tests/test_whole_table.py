"""Profiles cover every loaded row; id-less and undated comps as small cases."""

from compsight.operators import aggregates as agg
from compsight.operators import clean
from compsight.plans import prep
from compsight.plans.catalog import AS_OF, ORACLE, QUERIES
from conftest import SF01
from oracle_harness import compare, duck


def test_profiles_cover_the_whole_table(spark):
    con, n = duck(SF01), prep.loaded(spark, SF01).count()
    for name in ("null_profile_all", "drop_constant_columns_all"):
        out = compare(spark, con, name, QUERIES[name], ORACLE[name], SF01)
        assert out["ok"], out
    profile = {r["column"]: r for r in QUERIES["null_profile_all"](spark, SF01).collect()}
    assert profile["source_row"].n_values == n and 0 < profile["loan_number"].n_values < n
    assert QUERIES["drop_constant_columns_all"](spark, SF01).count() == n


def test_columns_without_a_second_value(spark):
    df = spark.createDataFrame([(1, None, "a", 5), (2, None, None, 5), (3, None, "b", 5)],
                               "source_row int, loan_number string, city string, fixed int")
    got = {r["column"]: (r.n_values, r.all_null, r.varies) for r in agg.null_profile(df, df.columns).collect()}
    assert got == {"source_row": (3, False, True), "loan_number": (0, True, False),
                   "city": (2, False, True), "fixed": (3, False, False)}
    assert clean.drop_constant_columns(df).columns == ["source_row", "city"]


def test_undated_rows_stay_only_where_no_row_has_a_date(spark):
    rows = spark.sql("SELECT 1 AS source_row, CAST(NULL AS DATE) AS fecha_de_modificacion "
                     "UNION ALL SELECT 2, DATE'2001-07-01'")
    assert [r.source_row for r in clean.filter_recent(rows, as_of=AS_OF).collect()] == [2]
    assert clean.filter_recent(rows.where("source_row = 1"), as_of=AS_OF).count() == 1
