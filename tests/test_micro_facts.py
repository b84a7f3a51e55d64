"""Queries that the provided tables leave empty, on small facts written for them (a query takes a fact's path as its source)."""

import pytest

from scorecube.plans import load_all

QUERIES = load_all()[0]
SCHEMA = ("year int, type_id int, county_code string, county_name string, district_code string, district_name string, "
          "school_code string, school_name string, test_id int, test_name string, student_group_id int, student_group_name string, "
          "student_group_category string, grade int, students_tested int, pct_met_and_above double, cohort_year int")
NAMES = {1: "All Students", 2: "EL (English learner, excluding RFEP)",
         3: "IFEP, RFEP, and EO (Fluent English proficient and English only)"}


def _cell(year, kind, school, group, grade, n, pct, county="AFRICA"):
    codes = ("01", county, "00000" if kind == 5 else "00001", "" if kind == 5 else "D", school, f"S{school}" if kind > 6 else "")
    return (year, kind, *codes, 2, "Mathematics", group, NAMES[group], "x", grade, n, pct, year - (grade - 3))


def _fact(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return path


def test_schools_with_the_smallest_gaps(spark, tmp_dir):
    """Weighted averages over grades, gap Fluent − EL, the smallest first, ties by code and type; suppressed cells and schools without
    one of the groups don't take part."""
    gaps = {"0000007": 5.0, "0000003": -2.0, "0000005": 2.0, "0000001": 40.0, "0000009": 2.0}
    rows = []
    for school, gap in gaps.items():
        kind = 9 if school == "0000009" else 7
        rows += [_cell(2019, kind, school, 2, 3, 10, 20.0), _cell(2019, kind, school, 2, 4, 30, 40.0),  # 35 on average
                 _cell(2019, kind, school, 3, 3, 50, 35.0 + gap)]
    rows += [_cell(2019, 7, "0000002", 2, 3, 10, 20.0), _cell(2019, 7, "0000002", 3, 3, 10, None),
             _cell(2019, 7, "0000004", 3, 3, 10, 50.0), _cell(2021, 7, "0000004", 2, 3, 12, 1.0), _cell(2021, 7, "0000004", 3, 3, 12, 4.0)]
    got = QUERIES["n06_smallest_school_gaps"](spark, _fact(spark, f"{tmp_dir}/fact", rows)).collect()
    ranked = sorted((r["year"], r["rank"], r["school_code"], r["gap"]) for r in got)
    assert [r[2] for r in ranked if r[0] == 2019] == ["0000003", "0000005", "0000009", "0000007", "0000001"][:len(ranked) - 1]
    assert [r[3] for r in ranked if r[0] == 2019][:3] == pytest.approx([-2.0, 2.0, 2.0])
    assert [r[2:] for r in ranked if r[0] == 2021] == [("0000004", 3.0)]


def test_entry_outcome_line(spark, tmp_dir):
    """Four cohorts from grade 3 to 8 on a line; one without an end and one with a suppressed start take no part."""
    rows = []
    for cohort, start in ((2016, 10.0), (2017, 20.0), (2018, 40.0), (2019, 30.0)):
        rows += [_cell(cohort, 5, "0000000", 1, 3, 20, start), _cell(cohort + 5, 5, "0000000", 1, 8, 20, 5.0 + start / 2)]
    rows += [_cell(2021, 5, "0000000", 1, 3, 20, 90.0), _cell(2015, 5, "0000000", 1, 4, 20, 1.0)]
    fact = _fact(spark, f"{tmp_dir}/fact", rows)
    line = sorted((r["i"], r["x"], r["y_fit"]) for r in QUERIES["q58_entry_outcome_fit"](spark, fact).collect())
    assert len(line) == 50 and line[0][1] == 10.0 and line[-1][1] == 40.0
    assert all(y == pytest.approx(5.0 + x / 2) for _, x, y in line)
    labels = {r["cohort_year"]: r["label"] for r in QUERIES["q18_cohort_start_end"](spark, fact).collect()}
    assert labels == {2016: "Gr3=10%  →  Gr8=10%", 2017: "Gr3=20%  →  Gr8=15%", 2018: "Gr3=40%  →  Gr8=25%", 2019: "Gr3=30%  →  Gr8=20%"}
