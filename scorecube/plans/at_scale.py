"""The generic operators applied to EVERY entity, subject and group of the fact table at once.

The report runs the operators for one focus entity; these queries run the same operators partitioned by the
entity keys over the whole table – the shape they have at full scale.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import aggregate as A
from ..operators import cohort as CO
from ..operators import mix as M
from ..operators import series as SE
from ..sources.cells import cells
from .registry import register, with_cells
from .report import YEARS_V, _r
from .report import sql as report_sql

PCT, N = C.PCT, C.N
ENT = ["type_id", "county_code", "district_code", "school_code"]
ENT_SQL = "type_id, county_code, district_code, school_code"
OK_SQL = "pct_met_and_above IS NOT NULL AND NOT isnan(pct_met_and_above) AND students_tested > 0"
SER = ENT + ["test_id", "student_group_id"]
SER_SQL = ENT_SQL + ", test_id, student_group_id"


@register("a01_weighted_average", with_cells() + f"""
SELECT {SER_SQL}, year, sum(pct_met_and_above * students_tested) / sum(students_tested) AS pct_met_and_above,
       CAST(sum(students_tested) AS DOUBLE) AS students_tested
FROM cells WHERE {OK_SQL} GROUP BY {SER_SQL}, year""", doubles=(PCT, N))
def a01_weighted_average(spark, sf_dir):
    """A1 – weighted average across grades for every entity × subject × group × year."""
    return A.weighted_average(A.dealt(cells(spark, sf_dir), SER + ["year"]), SER + ["year"])


@register("a02_headcount", with_cells() + f"""
SELECT {SER_SQL}, year, CAST(coalesce(sum(students_tested), 0) AS BIGINT) AS students
FROM cells GROUP BY {SER_SQL}, year""")
def a02_headcount(spark, sf_dir):
    """A2 – students tested (suppressed cells included) for every series and year."""
    return A.headcount(A.dealt(cells(spark, sf_dir), SER + ["year"]), SER + ["year"])


@register("a03_mean_by_year", with_cells() + f"""
SELECT {SER_SQL}, year, avg(pct_met_and_above) AS pct_met_and_above FROM cells GROUP BY {SER_SQL}, year""",
          doubles=(PCT,))
def a03_mean_by_year(spark, sf_dir):
    """A3 – unweighted mean over grades per year (null when every cell is suppressed)."""
    return A.mean_by(A.dealt(cells(spark, sf_dir), SER + ["year"]), SER + ["year"])


@register("a04_mean_by_grade", with_cells() + f"""
SELECT {SER_SQL}, grade, avg(pct_met_and_above) AS pct_met_and_above FROM cells GROUP BY {SER_SQL}, grade""",
          doubles=(PCT,))
def a04_mean_by_grade(spark, sf_dir):
    """A4 – unweighted mean over years per grade."""
    return A.mean_by(A.dealt(cells(spark, sf_dir), SER + ["grade"]), SER + ["grade"])


@register("a05_years_per_cohort", with_cells() + f"""
SELECT {SER_SQL}, cohort_year, count(DISTINCT year) AS n_years FROM cells
WHERE pct_met_and_above IS NOT NULL GROUP BY {SER_SQL}, cohort_year""")
def a05_years_per_cohort(spark, sf_dir):
    """A5 – distinct scored years per cohort of every series."""
    scored = cells(spark, sf_dir).filter(F.col(PCT).isNotNull())
    return A.distinct_count(A.dealt(scored, SER + ["cohort_year"]), SER + ["cohort_year"], "year", "n_years")


@register("a06_el_share", with_cells() + f"""
SELECT {ENT_SQL}, test_id, year,
       CAST(coalesce(sum(CASE WHEN student_group_id = 2 THEN students_tested END), 0) AS DOUBLE)
         / NULLIF(coalesce(sum(CASE WHEN student_group_id = 1 THEN students_tested END), 0), 0) * 100 AS share
FROM cells WHERE student_group_id IN (1, 2) GROUP BY {ENT_SQL}, test_id, year
HAVING count(CASE WHEN student_group_id = 2 THEN 1 END) > 0 AND count(CASE WHEN student_group_id = 1 THEN 1 END) > 0""",
    doubles=("share",))
def a06_el_share(spark, sf_dir):
    """A6 – EL share of all students tested for every entity, subject and year (one pass)."""
    g = F.col("student_group_id")
    return A.group_share(cells(spark, sf_dir).filter(g.isin(1, 2)), ENT + ["test_id", "year"], g == 2, g == 1)


@register("a07_bounds", with_cells() + f"""
SELECT {ENT_SQL}, test_id, greatest(0, min(pct_met_and_above) - 5) AS y_lo, least(100, max(pct_met_and_above) + 5) AS y_hi
FROM cells WHERE pct_met_and_above IS NOT NULL AND NOT isnan(pct_met_and_above) GROUP BY {ENT_SQL}, test_id""",
    doubles=("y_lo", "y_hi"))
def a07_bounds(spark, sf_dir):
    """A7 – padded, clamped value bounds per entity and subject."""
    return A.bounds(cells(spark, sf_dir), ENT + ["test_id"], PCT, 5)


_PIVOT_COLS = ", ".join(f'avg(CASE WHEN year = {y} THEN pct_met_and_above END) AS "{y}"' for y in C.YEARS)


@register("a09_heatmap_pivot", report_sql(f"""
p AS (SELECT grade, {_PIVOT_COLS} FROM bygrade WHERE entity = 'focus' AND student_group = {"'" + C.SG_ALL + "'"}
      GROUP BY grade)""", "SELECT g.grade, " + ", ".join(f'p."{y}"' for y in C.YEARS) + """
FROM grades_v g LEFT JOIN p ON p.grade = g.grade"""), doubles=tuple(f'"{y}"' for y in C.YEARS))
def a09_heatmap_pivot(spark, sf_dir):
    """A9 – display pivot grade × year of the focus (all grades of the domain as rows, years as columns)."""
    r = _r(spark, sf_dir)
    piv = A.pivot_mean(r.by_grade(C.SG_ALL, "focus"), "grade", "year", C.YEARS)
    grades = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in C.GRADES])).alias("grade"))
    return grades.join(piv, ["grade"], "left").select("grade", *[F.col(f"`{y}`") for y in C.YEARS])


MIX_ALL = f"""ann AS (SELECT district_code, test_id, student_group_id, year,
    sum(pct_met_and_above * students_tested) / sum(students_tested) AS pct_met_and_above,
    CAST(sum(students_tested) AS DOUBLE) AS students_tested
  FROM cells WHERE type_id = 6 AND student_group_id IN (1, 2, 3) AND {OK_SQL}
  GROUP BY district_code, test_id, student_group_id, year),
mix AS (SELECT * FROM (SELECT district_code, test_id, year,
    max(CASE WHEN student_group_id = 2 THEN pct_met_and_above END) AS el_perf,
    max(CASE WHEN student_group_id = 3 THEN pct_met_and_above END) AS fluent_perf,
    max(CASE WHEN student_group_id = 1 THEN pct_met_and_above END) AS overall_perf,
    max(CASE WHEN student_group_id = 2 THEN students_tested END)
      / max(CASE WHEN student_group_id = 1 AND students_tested > 0 THEN students_tested END) * 100 AS el_pct
  FROM ann GROUP BY district_code, test_id, year) m WHERE el_pct IS NOT NULL AND overall_perf IS NOT NULL)"""


def _mix_all(spark, sf_dir):
    c = cells(spark, sf_dir).filter(F.col("type_id") == C.TYPE_DISTRICT)
    return M.mix_frame(c, ["district_code", "test_id"])


@register("m01_mix_all_districts", with_cells(MIX_ALL) + """
SELECT district_code, test_id, year, el_pct, el_perf, fluent_perf, overall_perf FROM mix""",
          doubles=("el_pct", "el_perf", "fluent_perf", "overall_perf"))
def m01_mix_all_districts(spark, sf_dir):
    """Mix frame (EL share, EL / Fluent / overall performance) for every district and subject."""
    return _mix_all(spark, sf_dir).select("district_code", "test_id", "year", "el_pct", "el_perf", "fluent_perf",
                                          "overall_perf")


@register("a11_mix_regression_all_districts", with_cells(MIX_ALL) + """
SELECT * FROM (SELECT district_code, test_id, regr_slope(overall_perf, el_pct) AS slope,
                      regr_intercept(overall_perf, el_pct) AS intercept, CAST(regr_count(overall_perf, el_pct) AS BIGINT) AS n_points,
                      min(el_pct) AS x_min, max(el_pct) AS x_max
               FROM mix GROUP BY district_code, test_id) r WHERE n_points >= 3""",
    doubles=("slope", "intercept", "x_min", "x_max"))
def a11_mix_regression_all_districts(spark, sf_dir):
    """A11 – OLS of overall performance on EL share, per district and subject (≥ 3 years)."""
    return A.regression(_mix_all(spark, sf_dir), ["district_code", "test_id"], "el_pct", "overall_perf", 3)


def _annual_all(spark, sf_dir):
    return A.weighted_average(cells(spark, sf_dir).filter(F.col("student_group_id") == 1), ENT + ["test_id", "year"])


ANN_ALL = f"""ann AS (SELECT {ENT_SQL}, test_id, year,
    sum(pct_met_and_above * students_tested) / sum(students_tested) AS pct_met_and_above
  FROM cells WHERE student_group_id = 1 AND {OK_SQL} GROUP BY {ENT_SQL}, test_id, year)"""


@register("w01_yoy_spine", with_cells(ANN_ALL, YEARS_V, f"""
s AS (SELECT k.*, y.ord, y.year, a.pct_met_and_above FROM (SELECT DISTINCT {ENT_SQL}, test_id FROM ann) k
      CROSS JOIN years_v y
      LEFT JOIN ann a ON a.type_id = k.type_id AND a.county_code = k.county_code AND a.district_code = k.district_code
       AND a.school_code = k.school_code AND a.test_id = k.test_id AND a.year = y.year)""") + f"""
SELECT * FROM (SELECT {ENT_SQL}, test_id, year,
  pct_met_and_above - lag(pct_met_and_above) OVER (PARTITION BY {ENT_SQL}, test_id ORDER BY ord) AS change FROM s) d
WHERE change IS NOT NULL""", doubles=("change",))
def w01_yoy_spine(spark, sf_dir):
    """W1 – year-over-year change on the complete year domain for every entity and subject (All Students)."""
    ch = SE.change_on_domain(_annual_all(spark, sf_dir), ENT + ["test_id"], "year", C.YEARS)
    return ch.select(*ENT, "test_id", "year", "change")


@register("w02_change_present_years", with_cells(ANN_ALL) + f"""
SELECT * FROM (SELECT {ENT_SQL}, test_id, year,
  pct_met_and_above - lag(pct_met_and_above) OVER (PARTITION BY {ENT_SQL}, test_id ORDER BY year) AS change FROM ann) d
WHERE change IS NOT NULL""", doubles=("change",))
def w02_change_present_years(spark, sf_dir):
    """W2 – change over the present years only (missing years bridged)."""
    return SE.change(_annual_all(spark, sf_dir), ENT + ["test_id"], "year").select(*ENT, "test_id", "year", "change")


@register("w05_index_to_base", with_cells(ANN_ALL) + f"""
SELECT {ENT_SQL}, test_id, year, pct_met_and_above,
       pct_met_and_above / NULLIF(max(CASE WHEN year = 2015 THEN pct_met_and_above END)
                                  OVER (PARTITION BY {ENT_SQL}, test_id), 0) * 100 AS index_value FROM ann""",
    doubles=(PCT, "index_value"))
def w05_index_to_base(spark, sf_dir):
    """W5 – every entity's series indexed to its 2015 value."""
    return SE.index_to_base(_annual_all(spark, sf_dir), ENT + ["test_id"], base=2015, out="index_value") \
        .select(*ENT, "test_id", "year", PCT, "index_value")


@register("w06_cohort_trajectories", with_cells() + f"""
SELECT * FROM (
  SELECT {ENT_SQL}, test_id, cohort_year, grade, year, pct_met_and_above,
         count(*) OVER (PARTITION BY {ENT_SQL}, test_id, cohort_year) AS n_points,
         CAST(row_number() OVER (PARTITION BY {ENT_SQL}, test_id, cohort_year ORDER BY grade, year) AS INTEGER) AS point
  FROM cells WHERE student_group_id = 1 AND pct_met_and_above IS NOT NULL AND cohort_year IS NOT NULL) t
WHERE n_points >= 2""", doubles=(PCT,))
def w06_cohort_trajectories(spark, sf_dir):
    """W6 – cohort trajectories (≥ 2 points) of every entity and subject, All Students."""
    c = cells(spark, sf_dir).filter(F.col("student_group_id") == 1)
    return CO.trajectories(c, ENT + ["test_id"], 2).select(*ENT, "test_id", "cohort_year", "grade", "year", PCT,
                                                           "n_points", "point")
