"""Documents, sidecars and the sorted fact write."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scorecube import config as C
from scorecube.sinks import documents as D
from scorecube.sinks.fact import write_sorted_fact
from scorecube.sources.cells import cells

SCHEMA = ("year int, type_id int, county_code string, county_name string, district_code string, district_name string, "
          "school_code string, school_name string, test_id int, student_group_id int, student_group_name string, "
          "student_group_category string, grade int, students_tested int, pct_met_and_above double")


def _fact(spark):
    rows = [
        (2017, 7, "01", "R", "00002", "N", "0000019", "S", 2, 1, "All Students", "All", 3, 20, 50.0),
        (2018, 9, "01", "R", "00002", "N", "0000019", "S", 2, 1, "All Students", "All", 3, 22, 55.0),
        (2018, 9, "01", "R", "00002", "N", "0000019", "S", 1, 1, "All Students", "All", 4, 22, None),
        (2018, 5, "01", "R", "00000", "", "0000000", "", 2, 1, "All Students", "All", 3, 90, 40.0),
        (2018, 4, "00", "", "00000", "", "0000000", "", 2, 1, "All Students", "All", 3, 900, 45.0),
        (2018, 4, "00", "", "00000", "", "0000000", "", 1, 1, "All Students", "All", 3, 900, 44.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_documents_conflict_and_order(spark):
    docs = {r["doc"]: r for r in D.entity_documents(_fact(spark)).collect()}
    assert set(docs) == {"state", "county_01", "school_0000019"}
    school = json.loads(docs["school_0000019"]["json"])
    assert docs["school_0000019"]["type_id"] == 9 and [d["year"] for d in school] == [2018]  # type 9 wins
    state = json.loads(docs["state"]["json"])
    assert [d["test_id"] for d in state] == [1, 2]  # sorted by test, grade, year, group
    assert list(state[0]) == list(C.DOC_COLS)
    merged = {r["doc"]: r for r in D.entity_documents(_fact(spark), on_conflict="merge").collect()}
    assert merged["school_0000019"]["records"] == 2


def test_documents_written_and_read_back(spark, tmp_dir):
    path = os.path.join(tmp_dir, "docs")
    D.write_documents(D.document_lines(_fact(spark)), path)
    assert os.path.isdir(os.path.join(path, "doc=county_01"))  # leading zeros kept in the name
    back = spark.read.option("basePath", path).text(path, wholetext=True).withColumn("doc", F.regexp_extract(F.input_file_name(), r"doc=([^/]+)", 1))
    got = {r["doc"]: json.loads(r["value"]) for r in back.collect()}
    assert got["county_01"][0]["pct_met_and_above"] == 40.0


def test_manifest(spark):
    m = {r["label"]: (r["files"], r["records"]) for r in D.manifest(_fact(spark)).collect()}
    assert m == {"State": (1, 2), "Counties": (1, 1), "Schools": (1, 1), "Schools (charter)": (1, 1)}


def test_sidecars(spark):
    f = _fact(spark)
    assert D.entity_list(f, 2018).count() == 3
    assert D.subgroup_list(f, 2018).count() == 0


def test_sorted_fact_layout(spark, tmp_dir):
    path = os.path.join(tmp_dir, "fact")
    write_sorted_fact(_fact(spark), path, partitions=2)
    back = spark.read.parquet(path)
    assert back.count() == 6
    keys = [tuple(r) for r in back.select(*C.FACT_SORT_KEYS).collect()]
    assert keys == sorted(keys, key=lambda k: tuple((x is not None, x) for x in k))


def test_named_series(spark, tmp_dir):
    paths = D.write_named_series({"overall": _fact(spark).limit(2)}, tmp_dir)
    assert paths[0].endswith("01_overall") and spark.read.parquet(paths[0]).count() == 2


def test_sidecar_written_in_order(spark, tmp_dir):
    path = os.path.join(tmp_dir, "entities")
    D.write_sidecar(D.entity_list(_fact(spark), 2018), path, ["type_id", "county_name", "district_name", "school_name"])
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    rows = [json.loads(line) for f in files for line in open(os.path.join(path, f))]
    assert [r["type_id"] for r in rows] == [4, 5, 9]


def test_export_documents_key_guard(spark, tmp_dir):
    import pytest

    D.export_documents(_fact(spark), os.path.join(tmp_dir, "ok"))
    assert os.path.isdir(os.path.join(tmp_dir, "ok", "doc=state"))
    with pytest.raises(ValueError):
        D.export_documents(_fact(spark).union(_fact(spark)), os.path.join(tmp_dir, "no"))


def test_sorted_fact_row_groups_are_skippable(spark, tmp_dir):
    """Row groups hold ordered, non-overlapping (year, grade) ranges, so min/max statistics prune them."""
    import glob

    import pyarrow.parquet as pq

    from conftest import SF_SMALL
    from scorecube.sources.cells import derive_cells

    path = os.path.join(tmp_dir, "fact")
    write_sorted_fact(derive_cells(spark, SF_SMALL), path, partitions=4, row_group_rows=1000)
    files = sorted(glob.glob(os.path.join(path, "*.parquet")))
    groups = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.row_group(0).column(0).compression == "ZSTD"
        for i in range(meta.num_row_groups):
            rg = meta.row_group(i)
            assert rg.num_rows <= 1000
            names = [rg.column(j).path_in_schema for j in range(rg.num_columns)]
            st = rg.column(names.index("year")).statistics
            groups.append((st.min, st.max))
    assert len(groups) >= 10
    # ranges never go backwards across the globally sorted row groups
    assert all(a[1] <= b[0] for a, b in zip(groups, groups[1:]))
    # a single-year predicate touches only the row groups whose range contains that year
    hit = [g for g in groups if g[0] <= 2016 <= g[1]]
    assert 0 < len(hit) < len(groups)


def test_write_report(spark, tmp_dir):
    from conftest import SF_SMALL

    paths = D.write_report(spark, SF_SMALL, tmp_dir, select="q0")
    assert len(paths) >= 5 and os.path.basename(paths[0]) == "01_q01_overall_trend"
    assert spark.read.parquet(paths[0]).count() > 0


def test_documents_reread_equal_filtered_fact(spark, tmp_dir):
    """Every record of every written document, parsed back from the JSON text, equals the fact's scored rows of
    that entity (school codes under types 7 and 9: the type-9 rows)."""
    from pyspark.sql import Window

    from conftest import SF_SMALL
    from scorecube.sources.cells import cells

    fact = cells(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "docs")
    D.export_documents(fact, path)
    schema = "array<struct<" + ", ".join(
        f"{c}: {'double' if c == C.PCT else 'string' if c == 'student_group_name' else 'int'}" for c in C.DOC_COLS) + ">>"
    back = (spark.read.text(path, wholetext=True).withColumn("doc", F.regexp_extract(F.input_file_name(), r"doc=([^/]+)", 1))
            .select("doc", F.explode(F.from_json("value", schema)).alias("r")).select("doc", "r.*"))
    rows = fact.filter(F.col("type_id").isin(4, 5, 6, 7, 9) & F.col(C.PCT).isNotNull()).withColumn("doc", D._doc_key())
    keep = rows.withColumn("_max", F.max("type_id").over(Window.partitionBy("doc"))).filter(F.col("type_id") == F.col("_max"))
    expected = keep.select("doc", *C.DOC_COLS)

    def norm(df):
        return sorted(tuple(str(x) for x in r) for r in df.select("doc", *C.DOC_COLS).collect())
    assert norm(back) == norm(expected)


@pytest.mark.parametrize("conflict", ["last_type", "merge"])
def test_streamed_documents_are_the_gathered_ones(spark, tmp_dir, conflict):
    """On all cells: what the streaming export writes, line after line, is each document's array; nothing is gathered for it."""
    fact = cells(spark, "/root/testdata/sf0.001")
    lines = D.document_lines(fact, conflict)
    assert "collect_list" not in lines._jdf.queryExecution().toString()
    D.export_documents(fact, tmp_dir, conflict)
    want = {r["doc"]: json.loads(r["json"]) for r in D.entity_documents(fact, conflict).collect()}
    got = {}
    for d in os.listdir(tmp_dir):
        files = [f for f in os.listdir(os.path.join(tmp_dir, d)) if f.endswith(".txt")] if d.startswith("doc=") else []
        for f in files:
            with open(os.path.join(tmp_dir, d, f)) as text:
                got[d.removeprefix("doc=")] = json.load(text)
    assert len(want) > 20 and got == want


def test_point_lookups_skip_row_groups_by_bloom_filter(spark, tmp_dir):
    """Codes inside a row group's range that it doesn't hold are told by its Bloom filter: the scan reads no rows for them."""
    from scorecube.sinks.fact import write_sorted_fact

    rows = spark.range(40_000).selectExpr("2015 AS year", "3 AS grade", "1 AS student_group_id", "7 AS type_id",
                                          "lpad(id * 2, 7, '0') AS district_code", "'0' AS school_code")
    write_sorted_fact(rows, f"{tmp_dir}/f", partitions=1, row_group_rows=10_000)

    def read(code):
        df = spark.read.parquet(f"{tmp_dir}/f").filter(F.col("district_code") == code)
        n = len(df.collect())
        metrics, todo, total = {}, [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            if node.getClass().getSimpleName() == "FileSourceScanExec":
                total = node.metrics().apply("numOutputRows").value()
        return n, total
    assert read("0002000") == (1, 10_000)   # its row group only
    assert read("0002001") == (0, 0)        # within a row group's range, but in none
