"""The batch jobs end to end: raw archives -> ingested fact -> the same report as on the derived cells."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from scorecube import jobs
from scorecube.sources.cells import cells
from render import render_archives

QUERIES = E.queries()


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_ingest_then_report_equals_derived(spark, tmp_dir):
    src = cells(spark, SF_SMALL).filter(F.col("type_id").isin(4, 5))
    raw = os.path.join(tmp_dir, "raw")
    render_archives(src, raw).collect()
    out = os.path.join(tmp_dir, "out")
    jobs.run_ingest(spark, os.path.join(raw, "all-student-groups"), os.path.join(raw, "file_formats"), out,
                    sidecar_year=2019)
    fact = os.path.join(out, "fact")
    assert {r["rows"] > 0 for r in spark.read.parquet(os.path.join(out, "status")).collect()} == {True, False}
    assert spark.read.json(os.path.join(out, "entities")).count() > 0
    # the focus (a county) and the benchmark (the state) live at levels 4 and 5 only, so the report on the ingested
    # fact must equal the report on the derived cells
    for name in ("q01_overall_trend", "q14_cohorts_vs_bench", "q37_mix_frame", "q47_heatmap_gap_all"):
        assert _rows(QUERIES[name](spark, fact)) == _rows(QUERIES[name](spark, SF_SMALL)), name


def test_documents_report_and_sql_jobs(spark, tmp_dir):
    jobs.run_documents(spark, SF_SMALL, os.path.join(tmp_dir, "d"))
    assert os.path.isdir(os.path.join(tmp_dir, "d", "documents", "doc=state"))
    assert spark.read.parquet(os.path.join(tmp_dir, "d", "manifest")).count() == 5
    paths = jobs.run_report(spark, SF_SMALL, os.path.join(tmp_dir, "r"))
    assert len(paths) == 57 and os.path.basename(paths[0]) == "01_q01_overall_trend"
    jobs.run_sql(spark, SF_SMALL, "SELECT year, count(*) AS n FROM cells WHERE type_id = 4 GROUP BY year",
                 os.path.join(tmp_dir, "s"))
    assert spark.read.parquet(os.path.join(tmp_dir, "s")).count() == 7


def test_cli_report_with_district_focus(spark, tmp_dir):
    out = os.path.join(tmp_dir, "cli")
    jobs.main(["report", SF_SMALL, out, "--level", "6", "--name-col", "district_name", "--pattern", "NATION_1"])
    q01 = spark.read.parquet(os.path.join(out, "01_q01_overall_trend"))
    assert q01.filter(F.col("entity") == "focus").count() > 0
    # the default spec is back in effect afterwards
    assert _rows(QUERIES["q01_overall_trend"](spark, SF_SMALL)) == _rows(QUERIES["q01_overall_trend"](spark, SF_SMALL))
    from scorecube.plans import report as R
    assert R._SPEC[0] == R.S


def test_explore_state_district_school(spark, tmp_dir):
    from scorecube.plans.explorer import ExplorerSpec

    base = os.path.join(tmp_dir, "x")
    jobs.run_explore(spark, SF_SMALL, os.path.join(base, "state"), ExplorerSpec(entity_type="State"))
    st = spark.read.parquet(os.path.join(base, "state", "cohort_grid")).collect()
    assert st and all(r["state_value"] == r["selected_value"] for r in st)  # state selected: both sides equal
    label = QUERIES["q67_district_choices"](spark, SF_SMALL).orderBy("label").first()["label"]
    jobs.main(["explore", SF_SMALL, os.path.join(base, "district"), "--label", label, "--test-name", "English"])
    status = spark.read.parquet(os.path.join(base, "district", "status")).first()
    assert status["selected_rows"] > 0 and status["state_rows"] > 0
    school = QUERIES["q68_school_choices"](spark, SF_SMALL).orderBy("label").first()["label"]
    jobs.run_explore(spark, SF_SMALL, os.path.join(base, "school"), ExplorerSpec(entity_type="School", label=school))
    assert spark.read.parquet(os.path.join(base, "school", "grade_grid")).count() > 0
    from scorecube.plans import explorer as X
    assert X._XS[0] == X.X


def test_year_partitioned_fact(spark, tmp_dir):
    src = cells(spark, SF_SMALL).filter(F.col("type_id").isin(4, 5))
    raw = os.path.join(tmp_dir, "raw")
    render_archives(src, raw).collect()
    out = os.path.join(tmp_dir, "out")
    jobs.main(["ingest", os.path.join(raw, "all-student-groups"), os.path.join(raw, "file_formats"), out,
               "--partition-by-year"])
    fact = os.path.join(out, "fact")
    assert sorted(d for d in os.listdir(fact) if d.startswith("year=")) == [f"year={y}" for y in (2015, 2016, 2017, 2018, 2019, 2021, 2022)]
    assert dict(cells(spark, fact).dtypes)["year"] == "int"
    p = io_plan(QUERIES["q78_district_weighted_average"](spark, fact))  # year = 2019 prunes directories
    assert "PartitionFilters" in p
    for name in ("q01_overall_trend", "q76_state_grade_trend"):
        assert _rows(QUERIES[name](spark, fact)) == _rows(QUERIES[name](spark, SF_SMALL)), name


def io_plan(df) -> str:
    import io
    from contextlib import redirect_stdout

    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_documents_merge_option(spark, tmp_dir):
    import json

    jobs.main(["documents", SF_SMALL, os.path.join(tmp_dir, "m"), "--merge-school-types"])
    jobs.run_documents(spark, SF_SMALL, os.path.join(tmp_dir, "l"))

    def records(root):
        docs = os.path.join(root, "documents")
        out = {}
        for d in os.listdir(docs):
            if d.startswith("doc=school_"):
                part = [f for f in os.listdir(os.path.join(docs, d)) if f.startswith("part-")][0]
                out[d] = len(json.loads(open(os.path.join(docs, d, part)).read()))
        return out
    merged, last = records(os.path.join(tmp_dir, "m")), records(os.path.join(tmp_dir, "l"))
    assert set(merged) == set(last) and all(merged[k] >= last[k] for k in last)
    assert sum(merged.values()) > sum(last.values())  # a code under both types keeps both types' records
