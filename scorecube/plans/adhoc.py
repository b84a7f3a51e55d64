"""Ad-hoc SQL over the fact table (Q75–Q78), the ingest audit (Q79).

The documented lookups are plain SQL; Spark runs the same text through ``spark.sql`` on a temp view, and the
conjunctive predicates reach the Parquet scan (row groups of the sorted fact are skipped by min/max).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators.aggregate import distinct_small
from ..sources.cells import cells
from .registry import register, with_cells

DISTRICT = "00002"   # NATION_1 in the fixture

LOOKUPS = {
    # one district, one grade, by year
    "q75_district_grade_lookup": f"""
SELECT year, pct_met_and_above, students_tested FROM {{t}}
WHERE type_id = 6 AND district_code = '{DISTRICT}' AND test_id = 1 AND student_group_id = 1 AND grade = 5
ORDER BY year""",
    # state trend, one grade
    "q76_state_grade_trend": """
SELECT year, pct_met_and_above, students_tested FROM {t}
WHERE type_id = 4 AND test_id = 1 AND student_group_id = 1 AND grade = 5
ORDER BY year""",
    # one cohort across grades in a district
    "q77_district_cohort": f"""
SELECT grade, year, pct_met_and_above FROM {{t}}
WHERE cohort_year = 2015 AND district_code = '{DISTRICT}' AND type_id = 6 AND test_id = 1 AND student_group_id = 1
ORDER BY grade""",
    # weighted average across grades for a district in a given year
    "q78_district_weighted_average": f"""
SELECT SUM(pct_met_and_above * students_tested) / SUM(students_tested) AS weighted_pct FROM {{t}}
WHERE type_id = 6 AND district_code = '{DISTRICT}' AND year = 2019 AND test_id = 1 AND student_group_id = 1
  AND pct_met_and_above IS NOT NULL""",
}
DOUBLES = {"q75_district_grade_lookup": (C.PCT,), "q76_state_grade_trend": (C.PCT,),
           "q77_district_cohort": (C.PCT,), "q78_district_weighted_average": ("weighted_pct",)}


def _view(spark, sf_dir) -> str:
    name = "scorecube_cells"
    cells(spark, sf_dir).createOrReplaceTempView(name)
    return name


def _register_lookup(key: str, text: str):
    @register(key, with_cells() + text.format(t="cells"), doubles=DOUBLES[key])
    def lookup(spark, sf_dir):
        return spark.sql(text.format(t=_view(spark, sf_dir)))


for _k, _t in LOOKUPS.items():
    _register_lookup(_k, _t)


@register("q79_audit_by_year", with_cells() + """
SELECT year, count(*) AS rows, count(pct_met_and_above) AS scored_rows FROM cells GROUP BY year""")
def q79_audit_by_year(spark, sf_dir):
    """Rows per year (and non-suppressed rows)."""
    return cells(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("rows"),
                                                    F.count(C.PCT).alias("scored_rows"))


@register("q79_audit_summary", with_cells() + """
SELECT count(*) AS rows, count(DISTINCT year) AS n_years, count(DISTINCT grade) AS n_grades,
       count(DISTINCT test_id) AS n_tests, count(DISTINCT student_group_id) AS n_groups,
       string_agg(DISTINCT CAST(grade AS VARCHAR), ',' ORDER BY CAST(grade AS VARCHAR)) AS grades FROM cells""")
def q79_audit_summary(spark, sf_dir):
    """Totals and distinct domains: bitmaps of the values seen, united across partitions (no row is expanded or shuffled)."""
    g = F.array_sort(F.transform(F.collect_set("grade"), lambda x: x.cast("string")))
    return cells(spark, sf_dir).groupBy().agg(
        F.count(F.lit(1)).alias("rows"), *[distinct_small("year", "n_years"), distinct_small("grade", "n_grades"),
                                           distinct_small("test_id", "n_tests"), distinct_small("student_group_id", "n_groups")],
        F.concat_ws(",", g).alias("grades"))
