"""The single-entity report (Q01–Q66): a focus entity against the state benchmark, one subject.

Each query returns the data series behind one figure of the report as a long DataFrame. The focus and bench
rows come from ONE pruned, filtered scan of the cells table, tagged by side (``tag_sides``); every aggregate
is partitioned by entity, so the same plans run for all entities at once (see ``questions.py``).
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_SPEC as S
from ..functions.exprs import clipped_size, finite, grade_label, pct_label, sign_class, signed_label, start_end_label
from ..operators import aggregate as A
from ..operators import cohort as CO
from ..operators import mix as M
from ..operators import series as SE
from ..operators.select import level_pred, name_contains_pred, only_if_present, scored, subject_pred, tag_sides
from ..sources.cells import cells
from .registry import register, with_cells

PCT, N = C.PCT, C.N


class Report:
    _cache: dict = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, spec: C.ReportSpec = S) -> "Report":
        key = (spark.sparkContext.applicationId, sf_dir, spec)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir, spec)
        return cls._cache[key]

    def __init__(self, spark: SparkSession, sf_dir: str, spec: C.ReportSpec = S):
        self.spark, self.spec = spark, spec
        subj = cells(spark, sf_dir).filter(subject_pred(spec.test_id))
        focus = name_contains_pred(spec.focus_name_col, spec.focus_pattern, spec.focus_level)
        levels = level_pred(tuple(sorted({spec.focus_level, C.TYPE_STATE})))
        self.sides = (tag_sides(subj, {"focus": focus, "bench": level_pred(C.TYPE_STATE)}, prefilter=levels)
                      .select("entity", F.col("student_group_name").alias("student_group"), "test_id", "grade",
                              "year", "cohort_year", "district_code", PCT, N))
        if os.environ.get("SCORECUBE_PERSIST_SIDES", "1") == "1":
            # one subject at two levels: bounded by the entity's key domain, shared by every report query;
            # MEMORY_AND_DISK, recomputed from the fact table if an executor is lost
            self.sides = self.sides.persist(StorageLevel.MEMORY_AND_DISK)

    @classmethod
    def clear(cls, spark: SparkSession) -> None:
        """Release the cached report slices of this session."""
        app = spark.sparkContext.applicationId
        for key in [k for k in cls._cache if k[0] == app]:
            cls._cache.pop(key).sides.unpersist()

    def rows(self, groups, entity: str | None = None) -> DataFrame:
        groups = (groups,) if isinstance(groups, str) else tuple(groups)
        df = self.sides.filter(F.col("student_group").isin(*groups))
        return df.filter(F.col("entity") == entity) if entity else df

    def annual(self, groups, entity: str | None = None) -> DataFrame:
        """`annual(e, g)` – weighted average across grades by year."""
        return A.weighted_average(self.rows(groups, entity), ["entity", "student_group", "year"])

    def by_grade(self, groups, entity: str | None = None) -> DataFrame:
        """`byGrade(e, g)` – the non-suppressed cells by grade and year."""
        return scored(self.rows(groups, entity)).select(
            "entity", "student_group", "test_id", "grade", "year", "cohort_year", PCT, N)


_SPEC = [S]  # the report parameters in effect (jobs may select another focus)


def set_report_spec(spec: C.ReportSpec) -> None:
    """Choose the focus / subject of the registered report queries (their SQL oracles use the default spec)."""
    _SPEC[0] = spec


def _r(spark, sf_dir) -> Report:
    return Report.of(spark, sf_dir, _SPEC[0])


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(name: str, cols: str, rows) -> str:
    body = ", ".join("(" + ", ".join(str(v) if not isinstance(v, str) else _q(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


# ---------------------------------------------------------------------------------------------------------
# SQL building blocks (DuckDB)
# ---------------------------------------------------------------------------------------------------------
SUBJ = f"subj AS (SELECT * FROM cells WHERE test_id = {S.test_id})"
SIDES = f"""sides AS (
  SELECT 'focus' AS entity, * FROM subj
  WHERE type_id = {S.focus_level} AND coalesce(regexp_matches({S.focus_name_col}, {_q('(?i)' + S.focus_pattern)}), false)
  UNION ALL
  SELECT 'bench' AS entity, * FROM subj WHERE type_id = {C.TYPE_STATE})"""
ANNUAL = """annual AS (
  SELECT entity, student_group_name AS student_group, year,
         sum(pct_met_and_above * students_tested) / sum(students_tested) AS pct_met_and_above,
         CAST(sum(students_tested) AS DOUBLE) AS students_tested
  FROM sides
  WHERE pct_met_and_above IS NOT NULL AND NOT isnan(pct_met_and_above) AND students_tested > 0
  GROUP BY entity, student_group_name, year)"""
BYGRADE = """bygrade AS (
  SELECT entity, student_group_name AS student_group, grade, year, cohort_year, pct_met_and_above, students_tested
  FROM sides WHERE pct_met_and_above IS NOT NULL)"""
YEARS_V = _values("years_v", "ord, year", list(enumerate(S.years)))
GRADES_V = _values("grades_v", "gord, grade", list(enumerate(S.grades)))
ENT_V = _values("ent_v", "entity", [("focus",), ("bench",)])
BASE = with_cells(SUBJ, SIDES, ANNUAL, BYGRADE, YEARS_V, GRADES_V, ENT_V)


def sql(*ctes_and_select: str) -> str:
    *ctes, select = ctes_and_select
    return BASE + ("".join(",\n" + c.strip() for c in ctes)) + "\n" + select.strip()


ALL, EL, FL = _q(C.SG_ALL), _q(C.SG_EL), _q(C.SG_FLUENT)


# printf rounds half to even on the exact value of the double
def pct_label_sql(v: str, digits: int = 1) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN printf('%.{digits}f%%', {v}) END"


def signed_label_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN printf('%+.1f', {v}) END"


# ---------------------------------------------------------------------------------------------------------
# Section 1 – overall trends
# ---------------------------------------------------------------------------------------------------------
@register("q01_overall_trend", sql(f"""
SELECT entity, year, pct_met_and_above, students_tested, {pct_label_sql(PCT)} AS label
FROM annual WHERE student_group = {ALL}"""), doubles=(PCT, N))
def q01_overall_trend(spark, sf_dir):
    """Weighted average across grades by year, focus vs bench, with the point annotation (``12.3%``)."""
    return _r(spark, sf_dir).annual(C.SG_ALL).select("entity", "year", PCT, N, pct_label(PCT).alias("label"))


@register("q02_overall_year_domain", sql(f"""
SELECT e.entity, y.year, a.pct_met_and_above
FROM ent_v e CROSS JOIN years_v y
LEFT JOIN annual a ON a.entity = e.entity AND a.year = y.year AND a.student_group = {ALL}"""), doubles=(PCT,))
def q02_overall_year_domain(spark, sf_dir):
    """Q01 on the full year domain (holes null)."""
    r = _r(spark, sf_dir)
    ann = r.annual(C.SG_ALL).select("entity", "year", PCT)
    ents = spark.range(1).select(F.explode(F.array(F.lit("focus"), F.lit("bench"))).alias("entity"))
    return SE.on_spine(ann, ["entity"], "year", S.years, frame=ents).select("entity", "year", PCT)


@register("q03_overall_gap", sql(f"""
SELECT f.year, f.pct_met_and_above AS focus_pct, b.pct_met_and_above AS bench_pct,
       f.pct_met_and_above - b.pct_met_and_above AS gap,
       CASE WHEN f.pct_met_and_above - b.pct_met_and_above >= 0 THEN 'above' ELSE 'below' END AS sign,
       {signed_label_sql('f.pct_met_and_above - b.pct_met_and_above')} AS gap_label
FROM annual f JOIN annual b ON f.year = b.year
WHERE f.entity = 'focus' AND b.entity = 'bench' AND f.student_group = {ALL} AND b.student_group = {ALL}"""),
          doubles=("focus_pct", "bench_pct", "gap"))
def q03_overall_gap(spark, sf_dir):
    r = _r(spark, sf_dir)
    g = SE.gap(r.annual(C.SG_ALL), ["year"], F.col("entity") == "focus", F.col("entity") == "bench", a_name="focus_pct",
               b_name="bench_pct")
    return g.withColumn("sign", sign_class("gap")).withColumn("gap_label", signed_label("gap"))


@register("q04_overall_yoy_change", sql(
    f"""s AS (SELECT y.ord, y.year, a.pct_met_and_above FROM years_v y
        JOIN (SELECT DISTINCT entity FROM annual WHERE entity = 'focus' AND student_group = {ALL}) p ON TRUE
        LEFT JOIN annual a ON a.year = y.year AND a.entity = 'focus' AND a.student_group = {ALL})""",
    "d AS (SELECT year, pct_met_and_above - lag(pct_met_and_above) OVER (ORDER BY ord) AS change FROM s)",
    "SELECT year, change, CASE WHEN change >= 0 THEN 'above' ELSE 'below' END AS sign FROM d WHERE change IS NOT NULL"),
    doubles=("change",))
def q04_overall_yoy_change(spark, sf_dir):
    """Year-over-year change of the focus on the complete year domain (2021 follows 2019)."""
    r = _r(spark, sf_dir)
    ch = SE.change_on_domain(r.annual(C.SG_ALL, "focus"), ["entity"], "year", S.years)
    return ch.select("year", "change").withColumn("sign", sign_class("change"))


@register("q05_overall_indexed", sql(
    f"""s AS (SELECT e.entity, y.year, a.pct_met_and_above FROM ent_v e CROSS JOIN years_v y
        LEFT JOIN annual a ON a.entity = e.entity AND a.year = y.year AND a.student_group = {ALL})""",
    f"""SELECT entity, year, pct_met_and_above,
       pct_met_and_above / NULLIF(max(CASE WHEN year = {S.base_year} THEN pct_met_and_above END)
                                  OVER (PARTITION BY entity), 0) * 100 AS index_value FROM s"""),
    doubles=(PCT, "index_value"))
def q05_overall_indexed(spark, sf_dir):
    """Both sides indexed to the base year (= 100) on the full year domain."""
    r = _r(spark, sf_dir)
    ents = spark.range(1).select(F.explode(F.array(F.lit("focus"), F.lit("bench"))).alias("entity"))
    s = SE.on_spine(r.annual(C.SG_ALL).select("entity", "year", PCT), ["entity"], "year", S.years, frame=ents)
    return SE.index_to_base(s, ["entity"], base=S.base_year, out="index_value").select("entity", "year", PCT,
                                                                                       "index_value")


# ---------------------------------------------------------------------------------------------------------
# Section 2 – same grade over time
# ---------------------------------------------------------------------------------------------------------
@register("q06_12_grade_trends", sql(f"""
SELECT entity, grade, year, pct_met_and_above FROM bygrade
WHERE student_group = {ALL} AND grade IN (SELECT grade FROM bygrade WHERE entity = 'focus' AND student_group = {ALL})"""),
          doubles=(PCT,))
def q06_12_grade_trends(spark, sf_dir):
    """One series pair per grade (grades where the focus has data)."""
    bg = _r(spark, sf_dir).by_grade(C.SG_ALL)
    return only_if_present(bg, bg.filter(F.col("entity") == "focus"), ["grade"]).select("entity", "grade", "year", PCT)


def _with_bounds(df: DataFrame, value: str, pad: float, lo=0.0, hi=100.0, empty=None) -> DataFrame:
    """Attach padded shared bounds (A7). The bounds frame is grouped by ``test_id`` after a one-subject filter,
    so it has at most one row: a broadcast with a structural size bound."""
    kw = dict(empty_lo=-empty, empty_hi=empty) if empty else {}
    b = A.bounds(df, ["test_id"], value, pad, lo, hi, **kw)
    return df.join(F.broadcast(b), ["test_id"], "left")


def _bounds_sql(value: str, pad: float, clamp=True) -> str:
    if clamp:
        return (f"greatest(0, min({value}) OVER () - {pad}) AS y_lo, "
                f"least(100, max({value}) OVER () + {pad}) AS y_hi")
    return f"min({value}) OVER () - {pad} AS y_lo, max({value}) OVER () + {pad} AS y_hi"


@register("q13_grade_facets", sql(f"""
SELECT entity, grade, year, pct_met_and_above, {_bounds_sql(PCT, 5)}
FROM bygrade WHERE student_group = {ALL}"""), doubles=(PCT, "y_lo", "y_hi"))
def q13_grade_facets(spark, sf_dir):
    """All grades, both sides, shared padded bounds."""
    bg = _r(spark, sf_dir).by_grade(C.SG_ALL)
    return _with_bounds(bg, PCT, 5).select("entity", "grade", "year", PCT, "y_lo", "y_hi")


# ---------------------------------------------------------------------------------------------------------
# Section 3/7 – cohorts
# ---------------------------------------------------------------------------------------------------------
def _traj_sql(tag: str, group: str, entity: str = "focus") -> str:
    return (f"c_{tag} AS (SELECT cohort_year, grade, year, pct_met_and_above, students_tested FROM bygrade "
            f"WHERE entity = '{entity}' AND student_group = {group}),\n"
            f"t_{tag} AS (SELECT *, count(*) OVER (PARTITION BY cohort_year) AS n_points, "
            f"CAST(row_number() OVER (PARTITION BY cohort_year ORDER BY grade, year) AS INTEGER) AS point "
            f"FROM c_{tag})")


def _focus_traj(r: Report, group: str) -> DataFrame:
    return CO.trajectories(r.rows(group, "focus"), ["entity"], S.min_cohort_points)


def _register_cohorts(key: str, group: str, gsql: str):
    @register(f"{key}_focus", sql(_traj_sql("f", gsql), """
SELECT cohort_year, grade, year, pct_met_and_above, point, n_points FROM t_f WHERE n_points >= 2"""),
              doubles=(PCT,))
    def focus_only(spark, sf_dir):
        return _focus_traj(_r(spark, sf_dir), group).select("cohort_year", "grade", "year", PCT, "point", "n_points")

    @register(f"{key}_vs_bench", sql(_traj_sql("f", gsql), f"""
SELECT 'focus' AS entity, cohort_year, grade, year, pct_met_and_above FROM t_f WHERE n_points >= 2
UNION ALL
SELECT entity, cohort_year, grade, year, pct_met_and_above FROM bygrade
WHERE entity = 'bench' AND student_group = {gsql}
  AND cohort_year IN (SELECT cohort_year FROM t_f WHERE n_points >= 2)"""), doubles=(PCT,))
    def vs_bench(spark, sf_dir):
        r = _r(spark, sf_dir)
        ft = _focus_traj(r, group)
        bench = CO.paired(ft, r.rows(group, "bench"))
        cols = ["entity", "cohort_year", "grade", "year", PCT]
        return ft.select(*cols).unionByName(bench.select(*cols))


_register_cohorts("q14_cohorts", C.SG_ALL, ALL)          # Q14, Q15
_register_cohorts("q41_el_cohorts", C.SG_EL, EL)         # Q41, Q43
_register_cohorts("q42_fluent_cohorts", C.SG_FLUENT, FL)  # Q42, Q44


@register("q16_cohort_bubbles", sql(_traj_sql("f", ALL), """
SELECT cohort_year, grade, year, pct_met_and_above,
       CAST(least(greatest(coalesce(students_tested, 20) * 3, 20), 800) AS DOUBLE) AS size
FROM t_f WHERE n_points >= 2"""), doubles=(PCT, "size"))
def q16_cohort_bubbles(spark, sf_dir):
    ft = _focus_traj(_r(spark, sf_dir), C.SG_ALL)
    return ft.select("cohort_year", "grade", "year", PCT, clipped_size(N).alias("size"))


@register("q17_recent_cohorts", sql(_traj_sql("f", ALL), f"""
SELECT cohort_year, grade, year, pct_met_and_above, 'recent' AS band FROM t_f
WHERE cohort_year >= {S.recent_cohort_from} AND n_points >= 2
UNION ALL
SELECT cohort_year, grade, year, pct_met_and_above, 'background' AS band FROM c_f
WHERE cohort_year < {S.recent_cohort_from}"""), doubles=(PCT,))
def q17_recent_cohorts(spark, sf_dir):
    """Recent cohorts (≥ 2 points) highlighted; older cohorts as background without the point filter."""
    pts = CO.cohort_points(_r(spark, sf_dir).rows(C.SG_ALL, "focus"))
    recent, older = CO.recent_split(pts, S.recent_cohort_from)
    recent = CO.trajectories(recent, ["entity"], S.min_cohort_points)
    cols = ["cohort_year", "grade", "year", PCT]
    return (recent.select(*cols, F.lit("recent").alias("band"))
            .unionByName(older.select(*cols, F.lit("background").alias("band"))))


def _start_end_sql(g_from: int, g_to: int, group: str = ALL) -> str:
    return f"""se AS (SELECT cohort_year,
         max(CASE WHEN grade = {g_from} THEN pct_met_and_above END) AS start_pct,
         max(CASE WHEN grade = {g_to} THEN pct_met_and_above END) AS end_pct
  FROM bygrade WHERE entity = 'focus' AND student_group = {group} AND NOT isnan(pct_met_and_above)
  GROUP BY cohort_year)"""


def _register_start_end(key: str, g_from: int, g_to: int):
    @register(key, sql(_start_end_sql(g_from, g_to), """
SELECT cohort_year, start_pct, end_pct, end_pct - start_pct AS change,
       """ + f"""'Gr{g_from}=' || printf('%.0f%%', start_pct) || '  →  Gr{g_to}=' || printf('%.0f%%', end_pct) AS label FROM se
WHERE start_pct IS NOT NULL AND end_pct IS NOT NULL"""), doubles=("start_pct", "end_pct", "change"))
    def start_end(spark, sf_dir):
        """Cohort value at the start grade vs the end grade (both required)."""
        se = CO.start_end(_r(spark, sf_dir).rows(C.SG_ALL, "focus"), ["entity"], g_from, g_to)
        return se.select("cohort_year", "start_pct", "end_pct", (F.col("end_pct") - F.col("start_pct")).alias("change"),
                         start_end_label("start_pct", "end_pct", g_from, g_to).alias("label"))

    @register(key.replace("q18_cohort_start_end", "q58_entry_outcome_fit"), sql(_start_end_sql(g_from, g_to), f"""
reg AS (SELECT * FROM (SELECT regr_slope(end_pct, start_pct) AS slope, regr_intercept(end_pct, start_pct) AS intercept,
               regr_count(end_pct, start_pct) AS n, min(start_pct) AS x_min, max(start_pct) AS x_max
        FROM se WHERE start_pct IS NOT NULL AND end_pct IS NOT NULL) WHERE n >= {S.min_regression_points})""", f"""
SELECT CAST(i AS INTEGER) AS i, x_min + i * ((x_max - x_min) / {S.fit_samples - 1}) AS x,
       slope * (x_min + i * ((x_max - x_min) / {S.fit_samples - 1})) + intercept AS y_fit
FROM reg CROSS JOIN range(0, {S.fit_samples}) AS t(i)"""), doubles=("x", "y_fit"))
    def entry_outcome_fit(spark, sf_dir):
        """Q58 – OLS of the end value on the start value across cohorts (only with ≥ 3 cohorts), sampled line."""
        se = CO.start_end(_r(spark, sf_dir).rows(C.SG_ALL, "focus"), ["entity"], g_from, g_to)
        reg = A.regression(se, ["entity"], "start_pct", "end_pct", S.min_regression_points)
        return A.fitted_line(reg, ["entity"], S.fit_samples).select("i", "x", "y_fit")


_register_start_end("q18_cohort_start_end", S.grade_from, S.grade_to)
_register_start_end("q18_cohort_start_end_g5", S.grade_from, 5)


# ---------------------------------------------------------------------------------------------------------
# Section 4 – EL vs Fluent overall
# ---------------------------------------------------------------------------------------------------------
def _register_annual_pair(key: str, group: str, gsql: str, guard: bool = False):
    cond = f" AND EXISTS (SELECT 1 FROM annual WHERE entity = 'focus' AND student_group = {gsql})" if guard else ""

    @register(key, sql(f"""
SELECT entity, year, pct_met_and_above, students_tested FROM annual WHERE student_group = {gsql}{cond}"""),
              doubles=(PCT, N))
    def annual_pair(spark, sf_dir):
        ann = _r(spark, sf_dir).annual(group)
        if guard:  # the figure exists only when the focus has the group
            ann = only_if_present(ann, ann.filter(F.col("entity") == "focus"), ["student_group"])
        return ann.select("entity", "year", PCT, N)


_register_annual_pair("q19_el_trend", C.SG_EL, EL)
_register_annual_pair("q20_fluent_trend", C.SG_FLUENT, FL)
_register_annual_pair("q54_rfep_trend", C.SG_RFEP, _q(C.SG_RFEP), guard=True)
_register_annual_pair("q55_eo_trend", C.SG_EO, _q(C.SG_EO), guard=True)
_register_annual_pair("q57_ltel_trend", C.SG_LTEL, _q(C.SG_LTEL), guard=True)

GROUPS_ELFL = _values("grp_v", "student_group", [(C.SG_EL,), (C.SG_FLUENT,)])


@register("q21_el_vs_fluent_year_domain", sql(GROUPS_ELFL, """
SELECT g.student_group, y.year, a.pct_met_and_above FROM grp_v g CROSS JOIN years_v y
LEFT JOIN annual a ON a.entity = 'focus' AND a.student_group = g.student_group AND a.year = y.year"""),
          doubles=(PCT,))
def q21_el_vs_fluent_year_domain(spark, sf_dir):
    ann = _r(spark, sf_dir).annual([C.SG_EL, C.SG_FLUENT], "focus").select("student_group", "year", PCT)
    grp = spark.range(1).select(F.explode(F.array(F.lit(C.SG_EL), F.lit(C.SG_FLUENT))).alias("student_group"))
    return SE.on_spine(ann, ["student_group"], "year", S.years, frame=grp)


@register("q22_fluent_el_gap", sql(f"""
SELECT f.entity, f.year, f.pct_met_and_above AS fluent_pct, e.pct_met_and_above AS el_pct,
       f.pct_met_and_above - e.pct_met_and_above AS gap
FROM annual f JOIN annual e ON f.entity = e.entity AND f.year = e.year
WHERE f.student_group = {FL} AND e.student_group = {EL}"""), doubles=("fluent_pct", "el_pct", "gap"))
def q22_fluent_el_gap(spark, sf_dir):
    r = _r(spark, sf_dir)
    return SE.gap(r.annual([C.SG_FLUENT, C.SG_EL]), ["entity", "year"], F.col("student_group") == C.SG_FLUENT,
                  F.col("student_group") == C.SG_EL, a_name="fluent_pct", b_name="el_pct")


@register("q23_el_share", sql(f"""
SELECT entity, year,
       CAST(coalesce(sum(CASE WHEN student_group_name = {EL} THEN students_tested END), 0) AS DOUBLE)
         / NULLIF(coalesce(sum(CASE WHEN student_group_name = {ALL} THEN students_tested END), 0), 0) * 100 AS el_share
FROM sides WHERE student_group_name IN ({EL}, {ALL})
GROUP BY entity, year
HAVING count(CASE WHEN student_group_name = {EL} THEN 1 END) > 0
   AND count(CASE WHEN student_group_name = {ALL} THEN 1 END) > 0"""), doubles=("el_share",))
def q23_el_share(spark, sf_dir):
    """EL share of tested students by year (suppressed cells counted)."""
    rows = _r(spark, sf_dir).rows([C.SG_EL, C.SG_ALL])
    g = F.col("student_group")
    return A.group_share(rows, ["entity", "year"], g == C.SG_EL, g == C.SG_ALL, out="el_share")


@register("q24_headcounts", sql(f"""
h AS (SELECT year,
        CAST(coalesce(sum(CASE WHEN student_group_name = {EL} THEN students_tested END), 0) AS BIGINT) AS el_n,
        CAST(coalesce(sum(CASE WHEN student_group_name = {FL} THEN students_tested END), 0) AS BIGINT) AS fl_n,
        CAST(coalesce(sum(CASE WHEN student_group_name = {ALL} THEN students_tested END), 0) AS BIGINT) AS all_n,
        count(CASE WHEN student_group_name IN ({EL}, {FL}) THEN 1 END) > 0 AS has_mix,
        count(CASE WHEN student_group_name = {ALL} THEN 1 END) > 0 AS has_all
      FROM sides WHERE entity = 'focus' AND student_group_name IN ({EL}, {FL}, {ALL}) GROUP BY year)""", """
SELECT 'el' AS series, year, el_n AS students FROM h WHERE has_mix
UNION ALL SELECT 'fluent', year, fl_n FROM h WHERE has_mix
UNION ALL SELECT 'all', year, all_n FROM h WHERE has_all"""))
def q24_headcounts(spark, sf_dir):
    """Students tested by year: EL and Fluent over the years either has (absent = 0), All over its own years
    (suppressed cells counted). One aggregation, then an unpivot."""
    rows = _r(spark, sf_dir).rows([C.SG_EL, C.SG_FLUENT, C.SG_ALL], "focus")
    g = F.col("student_group")

    def hc(name):
        return F.coalesce(F.sum(F.when(g == name, F.col(N))), F.lit(0)).cast("long")
    h = rows.groupBy("year").agg(hc(C.SG_EL).alias("el"), hc(C.SG_FLUENT).alias("fluent"), hc(C.SG_ALL).alias("all"),
                                 (F.count(F.when(g.isin(C.SG_EL, C.SG_FLUENT), 1)) > 0).alias("has_mix"),
                                 (F.count(F.when(g == C.SG_ALL, 1)) > 0).alias("has_all"))
    long = h.unpivot(["year", "has_mix", "has_all"], ["el", "fluent", "all"], "series", "students")
    keep = F.when(F.col("series") == "all", F.col("has_all")).otherwise(F.col("has_mix"))
    return long.filter(keep).select("series", "year", "students")


# ---------------------------------------------------------------------------------------------------------
# Section 5 – EL / Fluent by grade
# ---------------------------------------------------------------------------------------------------------
@register("q25_el_fluent_by_grade_focus", sql(f"""
SELECT student_group, grade, year, pct_met_and_above, {_bounds_sql(PCT, 5)}
FROM bygrade WHERE entity = 'focus' AND student_group IN ({EL}, {FL})"""), doubles=(PCT, "y_lo", "y_hi"))
def q25_el_fluent_by_grade_focus(spark, sf_dir):
    bg = _r(spark, sf_dir).by_grade([C.SG_EL, C.SG_FLUENT], "focus")
    return _with_bounds(bg, PCT, 5).select("student_group", "grade", "year", PCT, "y_lo", "y_hi")


def _register_group_by_grade(key: str, group: str, gsql: str):
    @register(key, sql(f"""
SELECT entity, grade, year, pct_met_and_above, {_bounds_sql(PCT, 5)}
FROM bygrade WHERE student_group = {gsql}"""), doubles=(PCT, "y_lo", "y_hi"))
    def by_grade(spark, sf_dir):
        bg = _r(spark, sf_dir).by_grade(group)
        return _with_bounds(bg, PCT, 5).select("entity", "grade", "year", PCT, "y_lo", "y_hi")


_register_group_by_grade("q26_el_by_grade", C.SG_EL, EL)
_register_group_by_grade("q27_fluent_by_grade", C.SG_FLUENT, FL)


@register("q28_34_grade_four_series", sql(f"""
SELECT entity, student_group, grade, year, pct_met_and_above, {_bounds_sql(PCT, 5)}
FROM bygrade WHERE student_group IN ({EL}, {FL})"""), doubles=(PCT, "y_lo", "y_hi"))
def q28_34_grade_four_series(spark, sf_dir):
    """Per grade: EL/Fluent × focus/bench with shared bounds."""
    bg = _r(spark, sf_dir).by_grade([C.SG_EL, C.SG_FLUENT])
    return _with_bounds(bg, PCT, 5).select("entity", "student_group", "grade", "year", PCT, "y_lo", "y_hi")


# ---------------------------------------------------------------------------------------------------------
# Section 6 – mix and performance
# ---------------------------------------------------------------------------------------------------------
MIX = f"""mix AS (SELECT * FROM (
  SELECT year,
         max(CASE WHEN student_group = {EL} THEN pct_met_and_above END) AS el_perf,
         max(CASE WHEN student_group = {FL} THEN pct_met_and_above END) AS fluent_perf,
         max(CASE WHEN student_group = {ALL} THEN pct_met_and_above END) AS overall_perf,
         max(CASE WHEN student_group = {EL} THEN students_tested END)
           / max(CASE WHEN student_group = {ALL} AND students_tested > 0 THEN students_tested END) * 100 AS el_pct
  FROM annual WHERE entity = 'focus' GROUP BY year) m
  WHERE el_pct IS NOT NULL AND overall_perf IS NOT NULL)"""


def _mix(spark, sf_dir) -> DataFrame:
    r = _r(spark, sf_dir)
    return M.mix_frame(r.rows([C.SG_EL, C.SG_FLUENT, C.SG_ALL], "focus"), ["entity"], group_col="student_group")


@register("q37_mix_frame", sql(MIX, "SELECT year, el_pct, el_perf, fluent_perf, overall_perf FROM mix"),
          doubles=("el_pct", "el_perf", "fluent_perf", "overall_perf"))
def q37_mix_frame(spark, sf_dir):
    """Per year: EL share (of non-suppressed weight), EL, Fluent and overall performance."""
    return _mix(spark, sf_dir).select("year", "el_pct", "el_perf", "fluent_perf", "overall_perf")


@register("q35_mix_fit", sql(MIX, f"""
reg AS (SELECT * FROM (SELECT regr_slope(overall_perf, el_pct) AS slope, regr_intercept(overall_perf, el_pct) AS intercept,
               regr_count(overall_perf, el_pct) AS n, min(el_pct) AS x_min, max(el_pct) AS x_max FROM mix)
        WHERE n >= {S.min_regression_points})""", f"""
SELECT CAST(i AS INTEGER) AS i, x_min + i * ((x_max - x_min) / {S.fit_samples - 1}) AS x,
       slope * (x_min + i * ((x_max - x_min) / {S.fit_samples - 1})) + intercept AS y_fit
FROM reg CROSS JOIN range(0, {S.fit_samples}) AS t(i)"""), doubles=("x", "y_fit"))
def q35_mix_fit(spark, sf_dir):
    """OLS line of overall performance on EL share (≥ 3 years), 50 samples."""
    reg = A.regression(_mix(spark, sf_dir), ["entity"], "el_pct", "overall_perf", S.min_regression_points)
    return A.fitted_line(reg, ["entity"], S.fit_samples).select("i", "x", "y_fit")


@register("q36_mix_deltas", sql(MIX, """
SELECT * FROM (SELECT year, el_pct - lag(el_pct) OVER (ORDER BY year) AS d_el_pct,
                      overall_perf - lag(overall_perf) OVER (ORDER BY year) AS d_overall FROM mix) d
WHERE d_el_pct IS NOT NULL AND d_overall IS NOT NULL"""), doubles=("d_el_pct", "d_overall"))
def q36_mix_deltas(spark, sf_dir):
    """Change of EL share vs change of overall over the present years (missing years bridged)."""
    m = _mix(spark, sf_dir)
    both = SE.change(SE.change(m, ["entity"], "year", "el_pct", out="d_el_pct", drop_first=False),
                     ["entity"], "year", "overall_perf", out="d_overall", drop_first=False)
    return both.dropna(subset=["d_el_pct", "d_overall"]).select("year", "d_el_pct", "d_overall")


@register("q38_counterfactual", sql(MIX, f"""
b AS (SELECT *, max(CASE WHEN year = {S.base_year} THEN el_pct END) OVER () / 100 AS base FROM mix)""", """
SELECT year, overall_perf, base * el_perf + (1 - base) * fluent_perf AS simulated_perf,
       overall_perf - (base * el_perf + (1 - base) * fluent_perf) AS mix_effect FROM b WHERE base IS NOT NULL"""),
    doubles=("overall_perf", "simulated_perf", "mix_effect"))
def q38_counterfactual(spark, sf_dir):
    """Performance had the EL share stayed at its base-year value; difference = effect of the mix change."""
    cf = M.counterfactual(_mix(spark, sf_dir), ["entity"], S.base_year)
    return cf.select("year", "overall_perf", "simulated_perf",
                     (F.col("overall_perf") - F.col("simulated_perf")).alias("mix_effect"))


@register("q39_decomposition", sql(MIX, """
SELECT year, el_pct / 100 * el_perf AS el_contrib, (1 - el_pct / 100) * fluent_perf AS fluent_contrib, overall_perf
FROM mix WHERE el_perf IS NOT NULL AND fluent_perf IS NOT NULL"""),
    doubles=("el_contrib", "fluent_contrib", "overall_perf"))
def q39_decomposition(spark, sf_dir):
    return M.contributions(_mix(spark, sf_dir)).select("year", "el_contrib", "fluent_contrib", "overall_perf")


@register("q40_mix_series", sql(MIX, """
SELECT 'el_perf' AS series, year, el_perf AS value FROM mix
UNION ALL SELECT 'fluent_perf', year, fluent_perf FROM mix
UNION ALL SELECT 'overall_perf', year, overall_perf FROM mix"""), doubles=("value",))
def q40_mix_series(spark, sf_dir):
    return _mix(spark, sf_dir).unpivot(["year"], ["el_perf", "fluent_perf", "overall_perf"], "series", "value") \
        .select("series", "year", "value")


# ---------------------------------------------------------------------------------------------------------
# Section 8 – heatmaps (grade × year, unweighted mean of non-suppressed cells, full domain)
# ---------------------------------------------------------------------------------------------------------
def _heat(r: Report, group: str, **sides: str) -> DataFrame:
    """The grade × year grid with a column for each of ``sides`` (name = entity): one aggregate for all of them."""
    m = r.by_grade(group).groupBy("grade", "year").agg(
        *[F.avg(F.when(F.col("entity") == entity, F.col(PCT))).alias(name) for name, entity in sides.items()])
    grid = r.spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in S.grades])).alias("grade"))
    grid = grid.select("grade", F.explode(F.array(*[F.lit(y) for y in S.years])).alias("year"))
    return grid.join(m, ["grade", "year"], "left")


def _heat_sql(tag: str, gsql: str, entity: str) -> str:
    return (f"h_{tag} AS (SELECT g.grade, y.year, m.v FROM grades_v g CROSS JOIN years_v y LEFT JOIN "
            f"(SELECT grade, year, avg(pct_met_and_above) AS v FROM bygrade WHERE entity = '{entity}' "
            f"AND student_group = {gsql} GROUP BY grade, year) m ON m.grade = g.grade AND m.year = y.year)")


def _register_heat(key: str, group: str, gsql: str, entity: str):
    @register(key, sql(_heat_sql("a", gsql, entity), "SELECT grade, year, v AS pct_met_and_above FROM h_a"),
              doubles=(PCT,))
    def heat(spark, sf_dir):
        return _heat(_r(spark, sf_dir), group, **{PCT: entity}).select("grade", "year", PCT)


def _register_heat_gap(key: str, group: str, gsql: str):
    @register(key, sql(_heat_sql("f", gsql, "focus"), _heat_sql("b", gsql, "bench"), """
SELECT f.grade, f.year, f.v - b.v AS gap FROM h_f f JOIN h_b b ON f.grade = b.grade AND f.year = b.year"""),
              doubles=("gap",))
    def heat_gap(spark, sf_dir):
        both = _heat(_r(spark, sf_dir), group, f="focus", b="bench")
        return both.select("grade", "year", (F.col("f") - F.col("b")).alias("gap"))


_register_heat("q45_heatmap_focus_all", C.SG_ALL, ALL, "focus")
_register_heat("q46_heatmap_bench_all", C.SG_ALL, ALL, "bench")
_register_heat_gap("q47_heatmap_gap_all", C.SG_ALL, ALL)
_register_heat("q48_heatmap_focus_el", C.SG_EL, EL, "focus")
_register_heat("q49_heatmap_focus_fluent", C.SG_FLUENT, FL, "focus")
_register_heat_gap("q50_heatmap_gap_el", C.SG_EL, EL)
_register_heat_gap("q51_heatmap_gap_fluent", C.SG_FLUENT, FL)


# ---------------------------------------------------------------------------------------------------------
# Section 9 – additional analysis
# ---------------------------------------------------------------------------------------------------------
@register("q52_dashboard", sql(MIX, f"""
SELECT 'el_share' AS panel, 'focus' AS entity, year, el_pct AS value FROM mix
UNION ALL SELECT 'el', entity, year, pct_met_and_above FROM annual WHERE student_group = {EL}
UNION ALL SELECT 'fluent', entity, year, pct_met_and_above FROM annual WHERE student_group = {FL}
UNION ALL SELECT 'overall', entity, year, pct_met_and_above FROM annual WHERE student_group = {ALL}"""),
    doubles=("value",))
def q52_dashboard(spark, sf_dir):
    r = _r(spark, sf_dir)
    panel = (F.when(F.col("student_group") == C.SG_EL, "el").when(F.col("student_group") == C.SG_FLUENT, "fluent")
             .otherwise("overall"))
    ann = r.annual([C.SG_EL, C.SG_FLUENT, C.SG_ALL]).select(panel.alias("panel"), "entity", "year",
                                                            F.col(PCT).alias("value"))
    share = _mix(spark, sf_dir).select(F.lit("el_share").alias("panel"), "entity", "year",
                                       F.col("el_pct").alias("value"))
    return share.unionByName(ann)


@register("q53_grade_profile", sql(f"""
SELECT year, grade, 'Grade ' || CAST(grade AS VARCHAR) AS grade_label, pct_met_and_above
FROM bygrade WHERE entity = 'focus' AND student_group = {ALL}"""), doubles=(PCT,))
def q53_grade_profile(spark, sf_dir):
    return _r(spark, sf_dir).by_grade(C.SG_ALL, "focus").select("year", "grade", grade_label().alias("grade_label"),
                                                                 PCT)


@register("q56_everel_neverel", sql(f"""
SELECT entity, student_group, year, pct_met_and_above FROM annual
WHERE student_group IN ({_q(C.SG_EVEREL)}, {_q(C.SG_NEVEREL)})
  AND EXISTS (SELECT 1 FROM annual WHERE entity = 'focus' AND student_group IN ({_q(C.SG_EVEREL)}, {_q(C.SG_NEVEREL)}))"""),
    doubles=(PCT,))
def q56_everel_neverel(spark, sf_dir):
    r = _r(spark, sf_dir)
    rows = r.rows([C.SG_EVEREL, C.SG_NEVEREL])
    ann = A.weighted_average(rows, ["test_id", "entity", "student_group", "year"])
    ann = only_if_present(ann, ann.filter(F.col("entity") == "focus"), ["test_id"])
    return ann.select("entity", "student_group", "year", PCT)


GRP_V4 = _values("grp4_v", "entity, student_group",
                 [(e, g) for e in ("focus", "bench") for g in (C.SG_EL, C.SG_FLUENT)])


@register("q59_mean_by_grade", sql(GRP_V4, f"""
SELECT v.entity, v.student_group, g.grade, m.pct_met_and_above
FROM grp4_v v CROSS JOIN grades_v g
LEFT JOIN (SELECT entity, student_group_name, grade, avg(pct_met_and_above) AS pct_met_and_above FROM sides
           WHERE student_group_name IN ({EL}, {FL}) GROUP BY entity, student_group_name, grade) m
  ON m.entity = v.entity AND m.student_group_name = v.student_group AND m.grade = g.grade"""), doubles=(PCT,))
def q59_mean_by_grade(spark, sf_dir):
    """Unweighted mean by grade over all years, EL/Fluent × focus/bench, full grade domain."""
    r = _r(spark, sf_dir)
    m = A.mean_by(r.rows([C.SG_EL, C.SG_FLUENT]), ["entity", "student_group", "grade"])
    combos = spark.range(1).select(F.explode(F.array(F.lit("focus"), F.lit("bench"))).alias("entity"),
                                   ).select("entity", F.explode(F.array(F.lit(C.SG_EL), F.lit(C.SG_FLUENT)))
                                            .alias("student_group"))
    return SE.on_spine(m, ["entity", "student_group"], "grade", S.grades, frame=combos) \
        .select("entity", "student_group", "grade", PCT)


@register("q60_el_gap_by_grade", sql(f"""
g AS (SELECT f.grade, f.year, f.pct_met_and_above AS focus_pct, b.pct_met_and_above AS bench_pct,
             f.pct_met_and_above - b.pct_met_and_above AS gap
      FROM bygrade f JOIN bygrade b ON f.grade = b.grade AND f.year = b.year
      WHERE f.entity = 'focus' AND b.entity = 'bench' AND f.student_group = {EL} AND b.student_group = {EL})""", f"""
SELECT grade, year, focus_pct, bench_pct, gap, CASE WHEN gap >= 0 THEN 'above' ELSE 'below' END AS sign,
       {_bounds_sql('gap', 3, clamp=False)} FROM g"""),
    doubles=("focus_pct", "bench_pct", "gap", "y_lo", "y_hi"))
def q60_el_gap_by_grade(spark, sf_dir):
    """Focus EL − bench EL by grade and year, unclamped bounds ±3 (±15 when empty)."""
    r = _r(spark, sf_dir)
    g = SE.gap(r.by_grade(C.SG_EL), ["test_id", "grade", "year"], F.col("entity") == "focus", F.col("entity") == "bench",
               a_name="focus_pct", b_name="bench_pct")
    g = _with_bounds(g, "gap", 3, lo=None, hi=None, empty=15)
    return g.select("grade", "year", "focus_pct", "bench_pct", "gap", sign_class("gap").alias("sign"), "y_lo", "y_hi")


@register("q61_el_fluent_common_cohorts", sql(f"""
cc AS (SELECT cohort_year FROM bygrade WHERE entity = 'focus' AND student_group = {EL}
       INTERSECT SELECT cohort_year FROM bygrade WHERE entity = 'focus' AND student_group = {FL})""", f"""
t AS (SELECT student_group, cohort_year, grade, year, pct_met_and_above,
             count(*) OVER (PARTITION BY student_group, cohort_year) AS n_points
      FROM bygrade WHERE entity = 'focus' AND student_group IN ({EL}, {FL}) AND cohort_year IN (SELECT cohort_year FROM cc))""",
    "SELECT student_group, cohort_year, grade, year, pct_met_and_above FROM t WHERE n_points >= 2"), doubles=(PCT,))
def q61_el_fluent_common_cohorts(spark, sf_dir):
    r = _r(spark, sf_dir)
    groups = (C.SG_EL, C.SG_FLUENT)
    both = CO.common_cohorts(CO.cohort_points(r.rows(groups, "focus")), "student_group", groups)
    return CO.trajectories(both, ["student_group"], S.min_cohort_points) \
        .select("student_group", "cohort_year", "grade", "year", PCT)


@register("q62_fluency_groups_focus", sql(f"""
SELECT student_group, year, pct_met_and_above FROM annual
WHERE entity = 'focus' AND student_group IN ({EL}, {_q(C.SG_RFEP)}, {_q(C.SG_EO)}, {ALL})"""), doubles=(PCT,))
def q62_fluency_groups_focus(spark, sf_dir):
    return _r(spark, sf_dir).annual([C.SG_EL, C.SG_RFEP, C.SG_EO, C.SG_ALL], "focus").select("student_group", "year", PCT)


@register("q63_focus_el_vs_state_all", sql(f"""
SELECT e.year, e.pct_met_and_above AS focus_el, a.pct_met_and_above AS bench_all
FROM annual e JOIN annual a ON e.year = a.year
WHERE e.entity = 'focus' AND e.student_group = {EL} AND a.entity = 'bench' AND a.student_group = {ALL}"""),
    doubles=("focus_el", "bench_all"))
def q63_focus_el_vs_state_all(spark, sf_dir):
    r = _r(spark, sf_dir)
    entity, group = F.col("entity"), F.col("student_group")
    return SE.pivot_sides(r.annual([C.SG_EL, C.SG_ALL]), ["year"], {
        "focus_el": (entity == "focus") & (group == C.SG_EL), "bench_all": (entity == "bench") & (group == C.SG_ALL)})


@register("q64_el_enrolment_length", sql(f"""
SELECT student_group, year, pct_met_and_above FROM annual
WHERE entity = 'focus' AND student_group IN ({_q(C.SG_EL_12)}, {_q(C.SG_EL_L12)}, {EL})
  AND EXISTS (SELECT 1 FROM annual WHERE entity = 'focus' AND student_group = {_q(C.SG_EL_12)})"""), doubles=(PCT,))
def q64_el_enrolment_length(spark, sf_dir):
    r = _r(spark, sf_dir)
    ann = A.weighted_average(r.rows([C.SG_EL_12, C.SG_EL_L12, C.SG_EL], "focus"), ["test_id", "student_group", "year"])
    ann = only_if_present(ann, ann.filter(F.col("student_group") == C.SG_EL_12), ["test_id"])
    return ann.select("student_group", "year", PCT)


@register("q65_overview", sql(f"""
SELECT entity, student_group, year, pct_met_and_above FROM annual
WHERE (entity = 'focus' AND student_group IN ({EL}, {FL}, {_q(C.SG_RFEP)}, {ALL}))
   OR (entity = 'bench' AND student_group = {ALL})"""), doubles=(PCT,))
def q65_overview(spark, sf_dir):
    r = _r(spark, sf_dir)
    ann = r.annual([C.SG_EL, C.SG_FLUENT, C.SG_RFEP, C.SG_ALL])
    keep = (F.col("entity") == "focus") | (F.col("student_group") == C.SG_ALL)
    return ann.filter(keep).select("entity", "student_group", "year", PCT)


@register("q66_story", sql(MIX, f"""
SELECT 'el_share' AS panel, 'focus' AS entity, year, el_pct AS value FROM mix
UNION ALL SELECT 'el_perf', 'focus', year, el_perf FROM mix
UNION ALL SELECT 'fluent_perf', 'focus', year, fluent_perf FROM mix
UNION ALL SELECT 'overall_perf', 'focus', year, overall_perf FROM mix
UNION ALL SELECT 'overall_perf', 'bench', a.year, a.pct_met_and_above FROM annual a
  WHERE a.entity = 'bench' AND a.student_group = {ALL} AND a.year IN (SELECT year FROM mix)"""), doubles=("value",))
def q66_story(spark, sf_dir):
    """EL share, EL/Fluent performance, overall vs bench on the mix years (bench semi-joined to them)."""
    r = _r(spark, sf_dir)
    mix = _mix(spark, sf_dir)
    focus = (mix.unpivot(["entity", "year"], [F.col("el_pct").alias("el_share"), "el_perf", "fluent_perf",
                                              "overall_perf"], "panel", "value"))
    bench = (r.annual(C.SG_ALL, "bench").join(mix.select("year"), ["year"], "left_semi")
             .select(F.lit("overall_perf").alias("panel"), "entity", "year", F.col(PCT).alias("value")))
    return focus.select("panel", "entity", "year", "value").unionByName(bench)


# ---------------------------------------------------------------------------------------------------------
# F6 contains semantics at district level: the pattern matches several districts (NATION_1, NATION_10 … 19),
# whose cells are pooled into one weighted average – as a substring selection does.
# ---------------------------------------------------------------------------------------------------------
DISTRICT_SPEC = C.ReportSpec(focus_level=C.TYPE_DISTRICT, focus_name_col="district_name", focus_pattern="NATION_1")


@register("q01_district_focus_contains", with_cells(SUBJ, f"""
sides_d AS (
  SELECT 'focus' AS entity, * FROM subj
  WHERE type_id = {C.TYPE_DISTRICT} AND coalesce(regexp_matches(district_name, {_q('(?i)' + DISTRICT_SPEC.focus_pattern)}), false)
  UNION ALL
  SELECT 'bench' AS entity, * FROM subj WHERE type_id = {C.TYPE_STATE})""") + f"""
SELECT entity, year, sum(pct_met_and_above * students_tested) / sum(students_tested) AS pct_met_and_above,
       CAST(sum(students_tested) AS DOUBLE) AS students_tested,
       CAST(count(DISTINCT district_code) AS BIGINT) AS entities
FROM sides_d WHERE student_group_name = {ALL} AND {'pct_met_and_above IS NOT NULL AND NOT isnan(pct_met_and_above) AND students_tested > 0'}
GROUP BY entity, year""", doubles=(PCT, N))
def q01_district_focus_contains(spark, sf_dir):
    """Q01 with a district focus chosen by substring: every matching district is pooled (and counted)."""
    rows = Report.of(spark, sf_dir, DISTRICT_SPEC).rows(C.SG_ALL)
    v, n = F.col(PCT), F.col(N)
    ok = rows.filter(finite(v) & n.isNotNull() & (n > 0))
    return ok.groupBy("entity", "year").agg((F.sum(v * n) / F.sum(n)).alias(PCT), F.sum(n).cast("double").alias(N),
                                            F.countDistinct("district_code").alias("entities"))
