"""Operators against hand-written expectations (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from scorecube import config as C
from scorecube.operators import aggregate as A
from scorecube.operators import cohort as CO
from scorecube.operators import mix as M
from scorecube.operators import series as SE
from scorecube.operators.joins import top_k
from scorecube.operators.select import label_pred, tag_sides


def test_weighted_average(spark):
    df = spark.createDataFrame([("k", 50.0, 10), ("k", 100.0, 30), ("k", None, 99), ("k", 70.0, 0),
                                ("k", 70.0, None), ("z", None, 5)], "key string, pct_met_and_above double, students_tested int")
    rows = {r["key"]: r for r in A.weighted_average(df, ["key"]).collect()}
    assert rows["k"][C.PCT] == pytest.approx(87.5) and rows["k"][C.N] == 40.0
    assert "z" not in rows  # all-suppressed key is absent


def test_headcount_and_share_all_null(spark):
    df = spark.createDataFrame([(2019, "EL", None), (2019, "All", None)], "year int, g string, students_tested int")
    assert A.headcount(df, ["year"]).collect()[0]["students"] == 0
    s = A.group_share(df, ["year"], F.col("g") == "EL", F.col("g") == "All").collect()
    assert len(s) == 1 and s[0]["share"] is None


def test_change_on_spine_and_present_rows(spark):
    df = spark.createDataFrame([("e", 2017, 40.0), ("e", 2019, 50.0), ("e", 2021, 55.0)],
                               "entity string, year int, pct_met_and_above double")
    spine = SE.on_spine(df, ["entity"], "year", C.YEARS, ord_col="ord")
    w1 = {r["year"]: r["change"] for r in SE.change(spine, ["entity"], "ord").collect()}
    assert w1 == {2021: pytest.approx(5.0)}
    w2 = {r["year"]: r["change"] for r in SE.change(df, ["entity"], "year").collect()}
    assert w2 == {2019: pytest.approx(10.0), 2021: pytest.approx(5.0)}


def test_index_without_base_is_null(spark):
    df = spark.createDataFrame([("e", 2016, 40.0), ("e", 2017, 44.0)], "entity string, year int, pct_met_and_above double")
    assert [r["index"] for r in SE.index_to_base(df, ["entity"], base=2015).collect()] == [None, None]
    df = spark.createDataFrame([("e", 2015, 40.0), ("e", 2017, 44.0)], "entity string, year int, pct_met_and_above double")
    got = {r["year"]: r["index"] for r in SE.index_to_base(df, ["entity"], base=2015).collect()}
    assert got[2015] == pytest.approx(100.0) and got[2017] == pytest.approx(110.0)


def test_regression_needs_three_points(spark):
    two = spark.createDataFrame([("e", 1.0, 2.0), ("e", 2.0, 4.0)], "k string, x double, y double")
    assert A.regression(two, ["k"], "x", "y", 3).count() == 0
    three = two.unionByName(spark.createDataFrame([("e", 3.0, 6.0)], "k string, x double, y double"))
    reg = A.regression(three, ["k"], "x", "y", 3)
    r = reg.collect()[0]
    assert r["slope"] == pytest.approx(2.0) and r["intercept"] == pytest.approx(0.0, abs=1e-9)
    line = A.fitted_line(reg, ["k"], 50).orderBy("i").collect()
    assert len(line) == 50 and line[0]["x"] == pytest.approx(1.0) and line[-1]["y_fit"] == pytest.approx(6.0)


def test_bounds(spark):
    df = spark.createDataFrame([(2, 3.0), (2, 98.0)], "test_id int, v double")
    b = A.bounds(df, ["test_id"], "v", 5).collect()[0]
    assert (b["y_lo"], b["y_hi"]) == (0.0, 100.0)
    b = A.bounds(df, ["test_id"], "v", 3, None, None).collect()[0]
    assert (b["y_lo"], b["y_hi"]) == (0.0, 101.0)


def test_trajectories_and_start_end(spark):
    rows = [("e", 2015, 3, 2015, 40.0), ("e", 2015, 4, 2016, 42.0), ("e", 2015, 8, 2020, 50.0),
            ("e", 2016, 3, 2016, 41.0), ("e", 2017, 3, 2017, None)]
    df = spark.createDataFrame(rows, "entity string, cohort_year int, grade int, year int, pct_met_and_above double")
    t = CO.trajectories(df, ["entity"], 2).collect()
    assert {r["cohort_year"] for r in t} == {2015} and sorted(r["point"] for r in t) == [1, 2, 3]
    se = CO.start_end(df, ["entity"], 3, 8).collect()
    assert len(se) == 1 and se[0]["start_pct"] == 40.0 and se[0]["end_pct"] == 50.0


def test_mix_counterfactual_and_contributions(spark):
    rows = []
    for year, el, fl, allp, el_n, all_n in ((2015, 20.0, 60.0, 52.0, 20, 100), (2016, 30.0, 70.0, 60.0, 25, 100)):
        rows += [("e", year, C.SG_EL, el, el_n), ("e", year, C.SG_FLUENT, fl, all_n - el_n), ("e", year, C.SG_ALL, allp, all_n)]
    df = spark.createDataFrame(rows, "entity string, year int, student_group_name string, pct_met_and_above double, students_tested int")
    mix = M.mix_frame(df, ["entity"])
    got = {r["year"]: r for r in M.counterfactual(mix, ["entity"], 2015).collect()}
    assert got[2015]["el_pct"] == pytest.approx(20.0)
    assert got[2016]["simulated_perf"] == pytest.approx(0.2 * 30 + 0.8 * 70)
    c = {r["year"]: r for r in M.contributions(mix).collect()}
    assert c[2016]["el_contrib"] + c[2016]["fluent_contrib"] == pytest.approx(0.25 * 30 + 0.75 * 70)


def test_tag_sides_overlap(spark):
    df = spark.createDataFrame([(4, "x"), (5, "y")], "type_id int, n string")
    out = tag_sides(df, {"focus": F.col("type_id") == 4, "bench": F.col("type_id") == 4})
    assert sorted(r["entity"] for r in out.collect()) == ["bench", "focus"]


def test_label_with_two_parentheses(spark):
    df = spark.createDataFrame([(6, "A", "B) (C", "s"), (6, "A", "B", "s")],
                               "type_id int, district_name string, county_name string, school_name string")
    got = df.filter(label_pred("A (B) (C)", "District")).collect()
    # district = text before the first " (", county = the piece before the second " (" without trailing ")"
    assert [r["county_name"] for r in got] == ["B"]


def test_top_k_deterministic(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "w"), ("a", 2, "v"), ("b", 0, "u")], "p string, v int, code string")
    got = [(r["p"], r["code"]) for r in top_k(df, ["p"], [F.col("v"), F.col("code")], 2).orderBy("p", "rank").collect()]
    assert got == [("a", "w"), ("a", "x"), ("b", "u")]


def test_change_on_domain_equals_spine_change(spark):
    rows = [("e", 2015, 10.0), ("e", 2016, 12.0), ("e", 2018, 15.0), ("e", 2019, 16.0), ("e", 2021, 20.0),
            ("f", 2019, 1.0), ("f", 2021, 3.0), ("f", 2023, 4.0)]
    df = spark.createDataFrame(rows, "entity string, year int, pct_met_and_above double")
    spine = SE.on_spine(df, ["entity"], "year", C.YEARS, ord_col="ord")
    a = sorted((r["entity"], r["year"], r["change"]) for r in SE.change(spine, ["entity"], "ord").collect())
    b = sorted((r["entity"], r["year"], r["change"]) for r in SE.change_on_domain(df, ["entity"]).collect())
    assert a == b == [("e", 2016, 2.0), ("e", 2019, 1.0), ("e", 2021, 4.0), ("f", 2021, 2.0)]


def test_selection_status(spark):
    df = spark.createDataFrame([("s", 2019), ("s", 2015), ("s", 2019), ("t", 2021)], "side string, year int")
    got = {r["side"]: (r["rows"], r["years"]) for r in A.selection_status(df, ["side"]).collect()}
    assert got == {"s": (3, [2015, 2019]), "t": (1, [2021])}


def test_gap_needs_both_sides(spark):
    df = spark.createDataFrame([("f", 1, 5.0), ("b", 1, 3.0), ("f", 2, 4.0), ("b", 3, 1.0), ("f", 4, None), ("b", 4, 2.0), ("x", 5, 9.0)],
                               "side string, year int, pct_met_and_above double")
    f, b = F.col("side") == "f", F.col("side") == "b"
    assert [tuple(r) for r in SE.gap(df, ["year"], f, b).collect()] == [(1, 5.0, 3.0, 2.0)]
    # a null value counts as present: the key stays in the inner alignment
    assert sorted(r["year"] for r in SE.pivot_sides(df, ["year"], {"f": f, "b": b}).collect()) == [1, 4]


def test_cohorts_of_both_groups(spark):
    df = spark.createDataFrame([("EL", 2015, 1), ("FL", 2015, 2), ("EL", 2016, 3), ("EL", 2016, 4), ("XX", 2015, 5), ("FL", 2017, 6)],
                               "g string, cohort_year int, v int")
    got = CO.common_cohorts(df.filter("g <> 'XX'"), "g", ("EL", "FL"))
    assert sorted(r["v"] for r in got.collect()) == [1, 2]
    recent, older = CO.recent_split(df, 2016)
    assert sorted(r["v"] for r in recent.collect()) == [3, 4, 6] and sorted(r["v"] for r in older.collect()) == [1, 2, 5]


def test_counterfactual_needs_its_base_year(spark):
    df = spark.createDataFrame([("a", 2015, 20.0, 30.0, 70.0), ("a", 2016, 30.0, 30.0, 70.0), ("b", 2016, 10.0, 1.0, 2.0)],
                               "entity string, year int, el_pct double, el_perf double, fluent_perf double")
    got = {(r["entity"], r["year"]): r["simulated_perf"] for r in M.counterfactual(df, ["entity"], 2015).collect()}
    assert got == {("a", 2015): pytest.approx(62.0), ("a", 2016): pytest.approx(62.0)}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_ordinal_is_the_place_in_the_order(spark, partitions):
    from scorecube.operators.ordinal import with_ordinal
    values = [(i * 7919 % 1000, f"n{i % 13}") for i in range(1000)] + [(None, "x")]
    df = spark.createDataFrame(values, "v int, n string").repartition(5)
    got = {r["ordinal"]: r["v"] for r in with_ordinal(df, "v", partitions=partitions).collect()}
    assert got == dict(enumerate([*range(1000), None], start=1))
    down = with_ordinal(df.dropna(), F.col("n").desc(), F.col("v").asc(), name="place").orderBy("place").collect()
    want = sorted((v for v in values if v[0] is not None), key=lambda x: x[0])
    assert [(r["v"], r["n"]) for r in down] == sorted(want, key=lambda x: x[1], reverse=True)
    assert with_ordinal(df.limit(0), "v").collect() == []


def test_distinct_values_by_bitmaps(spark):
    values = [-32768, -1, 0, 1, 2, 2, 2025, 32767, None, 1]
    df = spark.createDataFrame([(v,) for v in values], "v short")
    assert df.groupBy().agg(A.distinct_small("v", "n")).first()["n"] == 7
    assert df.limit(0).groupBy().agg(A.distinct_small("v", "n")).first()["n"] == 0
