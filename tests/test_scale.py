"""How the work of the cells table, its sorted write and the ingest grows with the rows."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from scorecube.sinks.fact import sorted_for_fact, write_sorted_fact


def plan(df):
    return df._jdf.queryExecution().toString()


def test_tasks_follow_from_rows():
    from scorecube.session import ROWS_PER_TASK, task_count

    assert [task_count(n) for n in (0, 1, ROWS_PER_TASK, ROWS_PER_TASK + 1, 60 * ROWS_PER_TASK)] == [1, 1, 1, 2, 60]


def test_map_sides_write_straight_while_rows_allow():
    """Up to 200 tasks a map side keeps no rows; more tasks only when each would take over four times the rows."""
    from scorecube.session import ROWS_PER_TASK as R, task_count

    assert [task_count(n) for n in (200 * R, 200 * R + 1, 632 * R, 800 * R, 800 * R + 1, 8000 * R)] == [200, 200, 200, 200, 201, 2000]


def test_series_are_dealt_not_combined_in_their_splits(spark):
    """An entity's series has a few rows in a split: combining there would hold the split's rows in memory."""
    import __spark_entry__ as entry

    for name in ("a01_weighted_average", "a02_headcount", "a03_mean_by_year", "a04_mean_by_grade", "a05_years_per_cohort", "n11_vs_own_history"):
        p = plan(entry.queries()[name](spark, SF_SMALL)).split("== Physical Plan ==")[1]
        assert p.count("Exchange") == 1 and "REPARTITION_BY_NUM" in p, (name, p)
        assert "Aggregate" not in p[p.index("Exchange"):], (name, p)


def test_first_group_names_without_sorting_the_table(spark):
    from scorecube.plans.explorer import group_choices

    rows = [(1, 2016, "b", "x"), (1, 2015, "c", "x"), (1, 2015, "a", "y"), (1, 2015, "a", "y"), (2, 2015, None, "z"), (2, 2016, "d", "z"),
            (3, None, "e", None), (3, 2015, "f", "w"), (None, 2015, "g", "v")]
    df = spark.createDataFrame(rows, "student_group_id int, year int, student_group_name string, student_group_category string")
    assert sorted(map(tuple, group_choices(df).collect()), key=str) == [(1, "a", "y"), (3, "e", None), (None, "g", "v")]
    p = plan(group_choices(df)).split("== Physical Plan ==")[1]
    from_scan = p[p.rindex("Exchange"):]
    assert "HashAggregate" in from_scan and "Sort" not in from_scan, p


def test_cells_by_written_counts_equal_one_plan(spark):
    from scorecube.sources.cells import cells, derive_cells

    staged, one = cells(spark, SF_SMALL), derive_cells(spark, SF_SMALL)
    assert staged.count() == one.count() > 0
    assert staged.exceptAll(one).isEmpty() and one.exceptAll(staged).isEmpty()


def test_suppliers_of_one_code_and_name_are_one_school(spark, tmp_dir):
    """Keys beyond seven digits share a code; so do supplier rows given twice. Neither may give two rows for one cell."""
    from scorecube.sources.cells import cells

    tables = {"region": [(0, "R")], "nation": [(0, "N", 0)], "customer": [(1, "BUILDING")], "orders": [(1, 1, "1-URGENT")],
              "supplier": [(123456780, "S", 0), (123456781, "S", 0), (7, "T", 0), (7, "T", 0)],
              "lineitem": [(1, 123456780, 1, 30.0, "O"), (1, 123456781, 1, 3.0, "O"), (1, 7, 1, 30.0, "O"), (1, None, 1, 1.0, "O")]}
    schema = {"region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
              "customer": "c_custkey long, c_mktsegment string", "supplier": "s_suppkey long, s_name string, s_nationkey int",
              "orders": "o_orderkey long, o_custkey long, o_orderpriority string",
              "lineitem": "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_linestatus string"}
    for name, rows in tables.items():
        df = spark.createDataFrame(rows, schema[name])
        if name == "orders":
            df = df.withColumn("o_orderdate", F.lit("1995-03-01").cast("timestamp"))
        df.write.parquet(f"{tmp_dir}/{name}.parquet")
    rows = cells(spark, tmp_dir).where("student_group_id = 1").select("type_id", "school_name", "students_tested").collect()
    assert sorted(map(tuple, rows)) == [(4, "", 4), (5, "", 4), (6, "", 4), (7, "S", 2), (7, "T", 2)]


def test_line_items_are_shuffled_narrow_and_counted_after(spark):
    from scorecube.sources.cells import school_counts

    p = plan(school_counts(spark, SF_SMALL)).split("== Physical Plan ==")[1]
    dealt = p.index("REPARTITION_BY_NUM")
    assert "partial_count" in p[:dealt] and "partial_count" not in p[dealt:]


def test_sorted_write_deals_by_rows_not_by_bytes(spark, tmp_dir, monkeypatch):
    from scorecube.sinks import fact

    monkeypatch.setattr(fact, "task_count", lambda rows: -(-rows // 100))
    df = spark.range(1000).select(F.lit(2015).alias("year"), F.lit(3).alias("grade"), F.lit(1).alias("student_group_id"),
                                  F.lit(7).alias("type_id"), F.lit("d").alias("district_code"), F.col("id").cast("string").alias("school_code"))
    write_sorted_fact(df, f"{tmp_dir}/f")
    out = spark.read.parquet(f"{tmp_dir}/f")
    assert out.select(F.input_file_name()).distinct().count() == 10 and out.count() == 1000
    assert sorted_for_fact(df, partitions=10).rdd.getNumPartitions() == 10


LINES = ['a^^ x ^NA', 'a^"b ""q""^c"^d^e', '"^', 'a', '^^^^^', 'a^b^c^d^e^f']


def test_plain_cut_equals_the_csv_parser(spark):
    """Records without quotes are cut at their separators: the same fields as the parser gives."""
    from scorecube.functions.exprs import na_to_null
    from scorecube.sources.layouts import parse_members

    head = {"tag": "data", "year": 2015, "kind": "data", "member": "m", "caret": True, "line": "w^x^y^z"}
    lines = spark.createDataFrame([("data", 2015, "data", True, i + 1, line) for i, line in enumerate(LINES)],
                                  "tag string, year int, kind string, caret boolean, line_no long, line string")
    got = parse_members(lines, [head]).orderBy("line_no").select("w", "x", "y", "z").collect()
    csv = F.from_csv("line", "w string, x string, y string, z string", {"sep": "^", "quote": '"', "escape": '"', "multiLine": "true"})
    want = lines.orderBy("line_no").select(csv.alias("r")).select(*[na_to_null(F.col(f"r.{c}")).alias(c) for c in "wxyz"]).collect()
    assert got == want


def test_no_parse_in_filters(spark):
    """A filter on a parsed column must not repeat the parse."""
    from scorecube.sources.layouts import parse_members

    head = {"tag": "data", "year": 2015, "kind": "data", "member": "m", "caret": True, "line": "w^x"}
    lines = spark.createDataFrame([("data", 2015, "data", True, 1, "a^b")],
                                  "tag string, year int, kind string, caret boolean, line_no long, line string")
    p = plan(parse_members(lines, [head]).where("w = 'a' AND x = 'b'")).split("== Optimized Logical Plan ==")[1].split("==")[0]
    assert p.count("from_csv(") == 1, p
