"""Explorer queries (Q67–Q74): selector lists, label → entity selection, cohort and grade comparison grids of a
selected entity against the state, run status. The selected entity, subject and group are parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import district_label, school_label, subject_id
from ..operators import aggregate as A
from ..operators.ordinal import with_ordinal
from ..operators.select import label_pred, level_pred, nonblank, tag_sides
from ..sources.cells import cells
from .registry import register, with_cells


@dataclass(frozen=True)
class ExplorerSpec:
    entity_type: str = "District"        # State | District | School
    label: str | None = None             # a selector label; else the entity of the name below
    district_name: str = "NATION_1"
    school_name: str = "Supplier#000000001"
    test_name: str = "Mathematics"
    student_group_id: int = 1
    min_state_years: int = 2


X = ExplorerSpec(label="NATION_1 (AMERICA)")  # the default selection (the SQL oracles are written for it)
_XS = [X]                # the selection in effect


def set_explorer_spec(spec: ExplorerSpec) -> None:
    _XS[0] = spec


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------------------------------------
# Selector lists
# ---------------------------------------------------------------------------------------------------------
def district_choices(df: DataFrame) -> DataFrame:
    d = nonblank(df.filter(level_pred(C.TYPE_DISTRICT)).select("district_name", "county_name").distinct(),
                 "district_name")
    return d.select(district_label().alias("label"))


def school_choices(df: DataFrame) -> DataFrame:
    s = nonblank(df.filter(level_pred(C.TYPE_SCHOOL)).select("school_name", "district_name", "county_name").distinct(),
                 "school_name")
    return s.select(school_label().alias("label"))


def group_choices(df: DataFrame) -> DataFrame:
    """First row per group id (in the fact's year order), an aggregate (min_by). Its buffers hold strings, so it sorts its input: the
    few distinct names of an id and year are told apart first, by hashing, and only they are sorted."""
    named = df.select("student_group_id", "year", "student_group_name", "student_group_category").distinct()
    first = F.min_by(F.struct("student_group_name", "student_group_category"), F.struct("year", "student_group_name"))
    return (named.groupBy("student_group_id").agg(first.alias("f"))
            .select("student_group_id", "f.student_group_name", "f.student_group_category").dropna(subset=["student_group_name"]))


DISTRICT_LABEL_SQL = """CASE WHEN county_name IS NOT NULL AND trim(county_name) <> ''
  THEN district_name || ' (' || county_name || ')' ELSE district_name END"""
SCHOOL_LABEL_SQL = """CASE WHEN district_name IS NOT NULL AND trim(district_name) <> ''
  THEN school_name || ' — ' || district_name || ' (' || county_name || ')' ELSE school_name END"""


@register("q67_district_choices", with_cells(f"""
d AS (SELECT DISTINCT district_name, county_name FROM cells WHERE type_id = {C.TYPE_DISTRICT})""") + f"""
SELECT label, row_number() OVER (ORDER BY label) AS ordinal
FROM (SELECT {DISTRICT_LABEL_SQL} AS label FROM d WHERE district_name IS NOT NULL AND trim(district_name) <> '') AS l""")
def q67_district_choices(spark, sf_dir):
    return with_ordinal(district_choices(cells(spark, sf_dir)), "label")


@register("q68_school_choices", with_cells(f"""
s AS (SELECT DISTINCT school_name, district_name, county_name FROM cells WHERE type_id IN (7, 9))""") + f"""
SELECT label, row_number() OVER (ORDER BY label) AS ordinal
FROM (SELECT {SCHOOL_LABEL_SQL} AS label FROM s WHERE school_name IS NOT NULL AND trim(school_name) <> '') AS l""")
def q68_school_choices(spark, sf_dir):
    return with_ordinal(school_choices(cells(spark, sf_dir)), "label")


@register("q69_group_choices", with_cells("""
r AS (SELECT student_group_id, student_group_name, student_group_category,
             row_number() OVER (PARTITION BY student_group_id ORDER BY year, student_group_name) AS rn FROM cells)""") + """
SELECT student_group_id, student_group_name, student_group_category,
       row_number() OVER (ORDER BY student_group_category NULLS LAST, student_group_name, student_group_id) AS ordinal FROM r
WHERE rn = 1 AND student_group_name IS NOT NULL""")
def q69_group_choices(spark, sf_dir):
    return with_ordinal(group_choices(cells(spark, sf_dir)), "student_group_category", "student_group_name", "student_group_id")


@register("q70_test_choices", with_cells() + """
SELECT *, row_number() OVER (ORDER BY test_id, test_name) AS ordinal FROM (
  SELECT DISTINCT test_id, test_name,
         CASE WHEN contains(test_name, 'English') OR contains(test_name, 'ELA') THEN 1 ELSE 2 END AS resolved_test_id
  FROM cells WHERE test_id IN (1, 2) AND test_name IS NOT NULL) AS t""")
def q70_test_choices(spark, sf_dir):
    t = (cells(spark, sf_dir).filter(F.col("test_id").isin(*C.TEST_IDS_KEPT) & F.col("test_name").isNotNull())
         .select("test_id", "test_name").distinct())
    return with_ordinal(t.withColumn("resolved_test_id", subject_id("test_name")), "test_id", "test_name")


# ---------------------------------------------------------------------------------------------------------
# Selection by label and comparison grids
# ---------------------------------------------------------------------------------------------------------
def _selected_pred(spec: ExplorerSpec):
    """The rows of the selected entity: those of its label (parsed here into literals), or, without a label, those that the choices
    offered for the configured name stand for. A choice's label names the entity by the fact's own names, so that is the
    name itself."""
    if spec.entity_type == "State":
        return level_pred(C.TYPE_STATE)
    if spec.label is not None:
        return label_pred(spec.label, spec.entity_type)
    if spec.entity_type == "District":
        return level_pred(C.TYPE_DISTRICT) & (F.col("district_name") == spec.district_name)
    return level_pred(C.TYPE_SCHOOL) & (F.col("school_name") == spec.school_name)


def _subject_group(df: DataFrame, spec: ExplorerSpec) -> DataFrame:
    # Subject resolved from the test name, as the explorer does
    tid = 1 if ("English" in spec.test_name or "ELA" in spec.test_name) else 2
    return df.filter((F.col("test_id") == tid) & (F.col("student_group_id") == spec.student_group_id))


SUBJ_X = f"""sg AS (SELECT * FROM cells WHERE test_id = {1 if ('English' in X.test_name or 'ELA' in X.test_name) else 2}
  AND student_group_id = {X.student_group_id})"""
SEL_DISTRICT = f"""sel AS (SELECT * FROM sg WHERE type_id = 6 AND {DISTRICT_LABEL_SQL} = {_q(X.label)})"""
STATE_X = "st AS (SELECT * FROM sg WHERE type_id = 4)"


def _register_selection(key: str, entity_type: str, sel_sql: str):
    @register(key, with_cells(SUBJ_X, sel_sql) + """
SELECT type_id, county_code, district_code, school_code, year, grade, pct_met_and_above, students_tested FROM sel""",
              doubles=(C.PCT,))
    def selection(spark, sf_dir):
        spec = _XS[0] if entity_type == "District" else replace(_XS[0], entity_type=entity_type, label=None)
        rows = _subject_group(cells(spark, sf_dir), spec).filter(_selected_pred(spec))
        return rows.select("type_id", "county_code", "district_code", "school_code", "year", "grade", C.PCT, C.N)


SEL_SCHOOL = f"""sel AS (SELECT * FROM sg WHERE type_id IN (7, 9) AND school_name = {_q(X.school_name)})"""
_register_selection("q71_select_district_by_label", "District", SEL_DISTRICT)
_register_selection("q71_select_school_by_label", "School", SEL_SCHOOL)


def _state_and_selected(spark, sf_dir, spec: ExplorerSpec | None = None) -> DataFrame:
    """State rows and the selected entity's rows, tagged by side, from ONE scan (State selected: both sides are the state)."""
    spec = spec or _XS[0]
    levels = {"District": (C.TYPE_DISTRICT,), "School": C.TYPE_SCHOOL}.get(spec.entity_type, ())
    return tag_sides(_subject_group(cells(spark, sf_dir), spec),
                     {"state": level_pred(C.TYPE_STATE), "selected": _selected_pred(spec)}, tag="side",
                     prefilter=level_pred((C.TYPE_STATE, *levels)))


def _side_means(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: unweighted mean of either side, one aggregate."""
    return rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("side") == "state", F.col(C.PCT))).alias("state_value"),
        F.avg(F.when(F.col("side") == "selected", F.col(C.PCT))).alias("selected_value"),
        F.count_if(F.col("side") == "state").alias("state_rows"))


def cohort_grid(spark, sf_dir, spec: ExplorerSpec | None = None) -> DataFrame:
    """Q72 – per cohort with ≥ 2 state years: unweighted mean by year, state vs selected (full outer on years).

    A cohort's years with state rows are counted in a window over its (at most ten) years."""
    spec = spec or _XS[0]
    means = _side_means(_state_and_selected(spark, sf_dir, spec).dropna(subset=["cohort_year", "year"]), "cohort_year", "year")
    years = F.count_if(F.col("state_rows") > 0).over(Window.partitionBy("cohort_year"))
    return means.withColumn("n_years", years).filter(F.col("n_years") >= spec.min_state_years).drop("state_rows", "n_years")


def grade_grid(spark, sf_dir, spec: ExplorerSpec | None = None) -> DataFrame:
    """Q73 – per grade on the year domain: unweighted mean, state vs selected. A grade's years are gathered into a map (at most
    ten entries) and laid out on the domain, so the grid needs no join."""
    rows = _state_and_selected(spark, sf_dir, spec).dropna(subset=["grade"])
    means = _side_means(rows, "grade", "year").groupBy("grade").agg(F.map_from_entries(F.collect_list(F.when(
        F.col("year").isNotNull(), F.struct("year", F.struct("state_value", "selected_value"))))).alias("by_year"))
    grid = means.select("grade", "by_year", F.explode(F.array(*[F.lit(y) for y in C.YEARS])).alias("year"))
    value = F.try_element_at("by_year", F.col("year"))
    return grid.select("grade", "year", value["state_value"].alias("state_value"), value["selected_value"].alias("selected_value"))


def run_status(spark, sf_dir, spec: ExplorerSpec | None = None) -> DataFrame:
    """Q74 – state rows, selected rows, sorted state years."""
    rows = _state_and_selected(spark, sf_dir, spec)
    sides = A.selection_status(rows, ["side"])

    def of(side, column):
        return F.max(F.when(F.col("side") == side, F.col(column)))
    zero = F.lit(0).cast("long")
    return sides.groupBy().agg(
        F.coalesce(of("state", "rows"), zero).alias("state_rows"), F.coalesce(of("selected", "rows"), zero).alias("selected_rows"),
        F.concat_ws(",", F.transform(of("state", "years"), lambda y: y.cast("string"))).alias("years"))


def _grid_sql(sel_sql: str) -> dict:
    q72 = with_cells(SUBJ_X, sel_sql, STATE_X, f"""
ok AS (SELECT cohort_year FROM st WHERE cohort_year IS NOT NULL GROUP BY cohort_year
       HAVING count(DISTINCT year) >= {X.min_state_years})""", """
sv AS (SELECT cohort_year, year, avg(pct_met_and_above) AS state_value FROM st GROUP BY cohort_year, year)""", """
lv AS (SELECT cohort_year, year, avg(pct_met_and_above) AS selected_value FROM sel GROUP BY cohort_year, year)""") + """
SELECT coalesce(sv.cohort_year, lv.cohort_year) AS cohort_year, coalesce(sv.year, lv.year) AS year,
       sv.state_value, lv.selected_value
FROM sv FULL OUTER JOIN lv ON sv.cohort_year = lv.cohort_year AND sv.year = lv.year
WHERE coalesce(sv.cohort_year, lv.cohort_year) IN (SELECT cohort_year FROM ok)"""
    q73 = with_cells(SUBJ_X, sel_sql, STATE_X, """
gr AS (SELECT grade FROM st UNION SELECT grade FROM sel)""",
                     "yv(year) AS (VALUES " + ", ".join(f"({y})" for y in C.YEARS) + ")", """
sv AS (SELECT grade, year, avg(pct_met_and_above) AS state_value FROM st GROUP BY grade, year)""", """
lv AS (SELECT grade, year, avg(pct_met_and_above) AS selected_value FROM sel GROUP BY grade, year)""") + """
SELECT g.grade, y.year, sv.state_value, lv.selected_value
FROM gr g CROSS JOIN yv y
LEFT JOIN sv ON sv.grade = g.grade AND sv.year = y.year
LEFT JOIN lv ON lv.grade = g.grade AND lv.year = y.year
WHERE g.grade IS NOT NULL"""
    q74 = with_cells(SUBJ_X, sel_sql, STATE_X) + """
SELECT (SELECT count(*) FROM st) AS state_rows, (SELECT count(*) FROM sel) AS selected_rows,
       (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (SELECT DISTINCT year FROM st WHERE year IS NOT NULL)) AS years"""
    return {"q72": q72, "q73": q73, "q74": q74}


SEL_STATE = "sel AS (SELECT * FROM sg WHERE type_id = 4)"


def _register_grids(suffix: str, spec: ExplorerSpec | None, sel_sql: str):
    sqls = _grid_sql(sel_sql)

    @register(f"q72_cohort_grid{suffix}", sqls["q72"], doubles=("state_value", "selected_value"))
    def q72(spark, sf_dir):
        return cohort_grid(spark, sf_dir, spec)

    @register(f"q73_grade_grid{suffix}", sqls["q73"], doubles=("state_value", "selected_value"))
    def q73(spark, sf_dir):
        return grade_grid(spark, sf_dir, spec)

    @register(f"q74_run_status{suffix}", sqls["q74"])
    def q74(spark, sf_dir):
        return run_status(spark, sf_dir, spec)


_register_grids("", None, SEL_DISTRICT)                                      # the selection in effect (District)
_register_grids("_state", ExplorerSpec(entity_type="State"), SEL_STATE)      # State selected: both sides state
_register_grids("_school", ExplorerSpec(entity_type="School"), SEL_SCHOOL)   # a school by its label
