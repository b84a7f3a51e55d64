"""The advertised questions (N1–N11), answered for EVERY entity at once over the whole fact table.

Scale notes: pairs on the same key (EL vs Fluent, ELA vs Math, 2019 vs 2021) are conditional aggregations –
one shuffle, no self join; first/last values are ``min_by``/``max_by`` aggregates (map-side combined, a hot
entity never sorts in one task); windows are partitioned by entity × series (≤ one row per year); the state
series is keyed by the (test, group, year[, grade]) domain and broadcast only after a row-count check; top-k
uses ``row_number() <= k`` (partial WindowGroupLimit before the shuffle); peers are compared through their
bucket aggregate, never pairwise.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import finite
from ..operators import aggregate as A
from ..operators.joins import top_k
from ..sources.cells import cells
from .registry import register, with_cells

PCT, N = C.PCT, C.N
ENT = ["type_id", "county_code", "district_code", "school_code"]
ENT_SQL = "type_id, county_code, district_code, school_code"
TOP_K = 10
OK_SQL = "pct_met_and_above IS NOT NULL AND NOT isnan(pct_met_and_above) AND students_tested > 0"


def _ann(df, keys):
    return A.weighted_average(df, keys)


def _ann_sql(name: str, where: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, sum(pct_met_and_above * students_tested) / sum(students_tested) AS pct_met_and_above
  FROM cells WHERE {where} AND {OK_SQL} GROUP BY {keys})"""


# N1 -------------------------------------------------------------------------------------------------------
@register("n01_first_to_last_change", with_cells(
    _ann_sql("ann", "type_id = 6 AND student_group_id = 1", f"{ENT_SQL}, test_id, year")) + f"""
SELECT {ENT_SQL}, test_id, min(year) AS first_year, arg_min(pct_met_and_above, year) AS first_pct,
       max(year) AS last_year, arg_max(pct_met_and_above, year) AS last_pct,
       arg_max(pct_met_and_above, year) - arg_min(pct_met_and_above, year) AS change
FROM ann GROUP BY {ENT_SQL}, test_id""", doubles=("first_pct", "last_pct", "change"))
def n01_first_to_last_change(spark, sf_dir):
    """Per district and subject: weighted average across grades, first vs last year."""
    c = cells(spark, sf_dir).filter((F.col("type_id") == C.TYPE_DISTRICT) & (F.col("student_group_id") == 1))
    ann = _ann(c, ENT + ["test_id", "year"])
    out = ann.groupBy(*ENT, "test_id").agg(
        F.min("year").alias("first_year"), F.min_by(PCT, "year").alias("first_pct"),
        F.max("year").alias("last_year"), F.max_by(PCT, "year").alias("last_pct"))
    return out.withColumn("change", F.col("last_pct") - F.col("first_pct"))


# N2 -------------------------------------------------------------------------------------------------------
@register("n02_decline_recovery_topk", with_cells(
    _ann_sql("ann", "type_id = 6 AND student_group_id = 1", "district_code, district_name, test_id, year"), """
d AS (SELECT district_code, district_name, test_id,
             max(CASE WHEN year = 2021 THEN pct_met_and_above END) - max(CASE WHEN year = 2019 THEN pct_met_and_above END) AS decline,
             arg_max(pct_met_and_above, year) - max(CASE WHEN year = 2021 THEN pct_met_and_above END) AS recovery
      FROM ann GROUP BY district_code, district_name, test_id)""", f"""
r AS (SELECT 'decline' AS kind, test_id, district_code, district_name, decline AS value,
             CAST(row_number() OVER (PARTITION BY test_id ORDER BY decline, district_code) AS INTEGER) AS rank
      FROM d WHERE decline IS NOT NULL
      UNION ALL
      SELECT 'recovery', test_id, district_code, district_name, recovery,
             CAST(row_number() OVER (PARTITION BY test_id ORDER BY recovery DESC, district_code) AS INTEGER)
      FROM d WHERE recovery IS NOT NULL)""") + f"""
SELECT kind, test_id, rank, district_code, district_name, value FROM r WHERE rank <= {TOP_K}""", doubles=("value",))
def n02_decline_recovery_topk(spark, sf_dir):
    """Steepest 2019→2021 decline and fastest recovery since 2021, top-k districts per subject."""
    c = cells(spark, sf_dir).filter((F.col("type_id") == C.TYPE_DISTRICT) & (F.col("student_group_id") == 1))
    ann = _ann(c, ["district_code", "district_name", "test_id", "year"])
    p21 = F.max(F.when(F.col("year") == 2021, F.col(PCT)))
    d = ann.groupBy("district_code", "district_name", "test_id").agg(
        (p21 - F.max(F.when(F.col("year") == 2019, F.col(PCT)))).alias("decline"),
        (F.max_by(PCT, "year") - p21).alias("recovery"))
    cols = ["kind", "test_id", "rank", "district_code", "district_name", "value"]
    dec = top_k(d.filter(F.col("decline").isNotNull()), ["test_id"], [F.col("decline"), F.col("district_code")], TOP_K)
    rec = top_k(d.filter(F.col("recovery").isNotNull()), ["test_id"],
                [F.col("recovery").desc(), F.col("district_code")], TOP_K)
    return (dec.select(F.lit("decline").alias("kind"), "test_id", "rank", "district_code", "district_name",
                       F.col("decline").alias("value"))
            .unionByName(rec.select(F.lit("recovery").alias("kind"), "test_id", "rank", "district_code",
                                    "district_name", F.col("recovery").alias("value")))
            .select(*cols))


# N3 -------------------------------------------------------------------------------------------------------
@register("n03_subject_gap_by_county", with_cells(f"""
g AS (SELECT county_code, county_name, year,
         sum(CASE WHEN test_id = 1 THEN pct_met_and_above * students_tested END) / sum(CASE WHEN test_id = 1 THEN students_tested END) AS ela_pct,
         sum(CASE WHEN test_id = 2 THEN pct_met_and_above * students_tested END) / sum(CASE WHEN test_id = 2 THEN students_tested END) AS math_pct
      FROM cells WHERE type_id = 5 AND student_group_id = 1 AND {OK_SQL} GROUP BY county_code, county_name, year)""", """
h AS (SELECT *, ela_pct - math_pct AS gap FROM g WHERE ela_pct IS NOT NULL AND math_pct IS NOT NULL)""") + """
SELECT county_code, county_name, year, ela_pct, math_pct, gap,
       gap - lag(gap) OVER (PARTITION BY county_code ORDER BY year) AS gap_change FROM h""",
    doubles=("ela_pct", "math_pct", "gap", "gap_change"))
def n03_subject_gap_by_county(spark, sf_dir):
    """ELA − Math weighted average per county and year (both subjects in one aggregation) and its change."""
    c = cells(spark, sf_dir).filter((F.col("type_id") == C.TYPE_COUNTY) & (F.col("student_group_id") == 1))
    v, n = F.col(PCT), F.col(N)
    c = c.filter(finite(v) & (n > 0))

    def wavg(t):
        return F.sum(F.when(F.col("test_id") == t, v * n)) / F.sum(F.when(F.col("test_id") == t, n))
    g = (c.groupBy("county_code", "county_name", "year").agg(wavg(1).alias("ela_pct"), wavg(2).alias("math_pct"))
         .dropna(subset=["ela_pct", "math_pct"]).withColumn("gap", F.col("ela_pct") - F.col("math_pct")))
    w = Window.partitionBy("county_code").orderBy("year")
    return g.withColumn("gap_change", F.col("gap") - F.lag("gap").over(w))


# N4 -------------------------------------------------------------------------------------------------------
@register("n04_complementary_group_gap", with_cells(f"""
p AS (SELECT {ENT_SQL}, test_id, grade, year,
             max(CASE WHEN student_group_id = 2 THEN pct_met_and_above END) AS el_pct,
             max(CASE WHEN student_group_id = 3 THEN pct_met_and_above END) AS fluent_pct
      FROM cells WHERE student_group_id IN (2, 3) AND pct_met_and_above IS NOT NULL
      GROUP BY {ENT_SQL}, test_id, grade, year)""") + f"""
SELECT {ENT_SQL}, test_id, grade, year, el_pct, fluent_pct, fluent_pct - el_pct AS gap
FROM p WHERE el_pct IS NOT NULL AND fluent_pct IS NOT NULL""", doubles=("el_pct", "fluent_pct", "gap"))
def n04_complementary_group_gap(spark, sf_dir):
    """Fluent − EL for every entity, subject, grade and year (the pair shares its key: one aggregation)."""
    c = cells(spark, sf_dir).filter(F.col("student_group_id").isin(2, 3) & F.col(PCT).isNotNull())
    g = F.col("student_group_id")
    p = c.groupBy(*ENT, "test_id", "grade", "year").agg(
        F.max(F.when(g == 2, F.col(PCT))).alias("el_pct"), F.max(F.when(g == 3, F.col(PCT))).alias("fluent_pct"))
    return p.dropna(subset=["el_pct", "fluent_pct"]).withColumn("gap", F.col("fluent_pct") - F.col("el_pct"))


# N5 -------------------------------------------------------------------------------------------------------
@register("n05_group_vs_state", with_cells(
    _ann_sql("ann", "type_id IN (4, 6)", f"{ENT_SQL}, test_id, student_group_id, year"), """
j AS (SELECT d.district_code, d.test_id, d.student_group_id, d.year, d.pct_met_and_above, s.pct_met_and_above AS state_pct,
             d.pct_met_and_above - s.pct_met_and_above AS gap
      FROM ann d JOIN ann s ON d.test_id = s.test_id AND d.student_group_id = s.student_group_id AND d.year = s.year
      WHERE d.type_id = 6 AND s.type_id = 4)""") + """
SELECT *, gap - lag(gap) OVER (PARTITION BY district_code, test_id, student_group_id ORDER BY year) AS gap_change FROM j""",
    doubles=(PCT, "state_pct", "gap", "gap_change"))
def n05_group_vs_state(spark, sf_dir):
    """Every district × group vs the state average of that group, and the change of that gap."""
    c = cells(spark, sf_dir).filter(F.col("type_id").isin(C.TYPE_STATE, C.TYPE_DISTRICT))
    ann = _ann(c, ENT + ["test_id", "student_group_id", "year"])
    keys = ["test_id", "student_group_id", "year"]
    state = ann.filter(F.col("type_id") == C.TYPE_STATE).select(*keys, F.col(PCT).alias("state_pct"))
    d = ann.filter(F.col("type_id") == C.TYPE_DISTRICT).select("district_code", *keys, PCT)
    j = d.join(state, keys).withColumn("gap", F.col(PCT) - F.col("state_pct"))
    w = Window.partitionBy("district_code", "test_id", "student_group_id").orderBy("year")
    return j.withColumn("gap_change", F.col("gap") - F.lag("gap").over(w)).select(
        "district_code", "test_id", "student_group_id", "year", PCT, "state_pct", "gap", "gap_change")


# N6 -------------------------------------------------------------------------------------------------------
def _gaps_sql(type_ids: str, code: str, name: str) -> str:
    return with_cells(f"""
p AS (SELECT type_id, {code}, {name}, test_id, year,
         sum(CASE WHEN student_group_id = 2 THEN pct_met_and_above * students_tested END) / sum(CASE WHEN student_group_id = 2 THEN students_tested END) AS el_pct,
         sum(CASE WHEN student_group_id = 3 THEN pct_met_and_above * students_tested END) / sum(CASE WHEN student_group_id = 3 THEN students_tested END) AS fluent_pct
      FROM cells WHERE type_id IN ({type_ids}) AND student_group_id IN (2, 3) AND {OK_SQL}
      GROUP BY type_id, {code}, {name}, test_id, year)""", f"""
r AS (SELECT *, fluent_pct - el_pct AS gap,
             CAST(row_number() OVER (PARTITION BY test_id, year ORDER BY abs(fluent_pct - el_pct), {code}, type_id) AS INTEGER) AS rank
      FROM p WHERE el_pct IS NOT NULL AND fluent_pct IS NOT NULL)""") + f"""
SELECT test_id, year, rank, type_id, {code}, {name}, el_pct, fluent_pct, gap FROM r WHERE rank <= {TOP_K}"""


def _smallest_gaps(spark, sf_dir, type_ids, code: str, name: str):
    """Entities with the smallest Fluent − EL gap per subject and year (top-k by |gap|, ties by code)."""
    v, n, g = F.col(PCT), F.col(N), F.col("student_group_id")
    c = cells(spark, sf_dir).filter(F.col("type_id").isin(*type_ids) & g.isin(2, 3)
                                    & finite(v) & (n > 0))

    def wavg(gid):
        return F.sum(F.when(g == gid, v * n)) / F.sum(F.when(g == gid, n))
    p = (c.groupBy("type_id", code, name, "test_id", "year")
         .agg(wavg(2).alias("el_pct"), wavg(3).alias("fluent_pct"))
         .dropna(subset=["el_pct", "fluent_pct"]).withColumn("gap", F.col("fluent_pct") - F.col("el_pct")))
    r = top_k(p, ["test_id", "year"], [F.abs("gap"), F.col(code), F.col("type_id")], TOP_K)
    return r.select("test_id", "year", "rank", "type_id", code, name, "el_pct", "fluent_pct", "gap")


@register("n06_smallest_school_gaps", _gaps_sql("7, 9", "school_code", "school_name"),
          doubles=("el_pct", "fluent_pct", "gap"))
def n06_smallest_school_gaps(spark, sf_dir):
    """Schools with the smallest Fluent − EL gap per subject and year (empty when every school EL cell is
    suppressed, as in the small test tables)."""
    return _smallest_gaps(spark, sf_dir, C.TYPE_SCHOOL, "school_code", "school_name")


@register("n06_smallest_district_gaps", _gaps_sql("6", "district_code", "district_name"),
          doubles=("el_pct", "fluent_pct", "gap"))
def n06_smallest_district_gaps(spark, sf_dir):
    """The same ranking one level up (districts), where the test tables leave EL cells unsuppressed."""
    return _smallest_gaps(spark, sf_dir, (C.TYPE_DISTRICT,), "district_code", "district_name")


# N7 -------------------------------------------------------------------------------------------------------
@register("n07_cohort_progress", with_cells() + f"""
SELECT * FROM (
  SELECT {ENT_SQL}, test_id, cohort_year, min(grade) AS first_grade, arg_min(pct_met_and_above, grade) AS first_pct,
         max(grade) AS last_grade, arg_max(pct_met_and_above, grade) AS last_pct,
         arg_max(pct_met_and_above, grade) - arg_min(pct_met_and_above, grade) AS change, count(*) AS n_points
  FROM cells WHERE student_group_id = 1 AND pct_met_and_above IS NOT NULL AND cohort_year IS NOT NULL
  GROUP BY {ENT_SQL}, test_id, cohort_year) t WHERE n_points >= 2""",
    doubles=("first_pct", "last_pct", "change"))
def n07_cohort_progress(spark, sf_dir):
    """Every entity's cohorts: first vs last grade value (aggregate, not a per-cohort window)."""
    c = cells(spark, sf_dir).filter((F.col("student_group_id") == 1) & F.col(PCT).isNotNull()
                                    & F.col("cohort_year").isNotNull())
    out = c.groupBy(*ENT, "test_id", "cohort_year").agg(
        F.min("grade").alias("first_grade"), F.min_by(PCT, "grade").alias("first_pct"),
        F.max("grade").alias("last_grade"), F.max_by(PCT, "grade").alias("last_pct"),
        F.count(F.lit(1)).alias("n_points"))
    return out.filter(F.col("n_points") >= 2).withColumn("change", F.col("last_pct") - F.col("first_pct"))


# N8 -------------------------------------------------------------------------------------------------------
@register("n08_cohorts_hit_by_gap_year", with_cells("""
p AS (SELECT district_code, test_id, cohort_year,
             max(CASE WHEN year = 2019 THEN pct_met_and_above END) AS pct_2019,
             max(CASE WHEN year = 2021 THEN pct_met_and_above END) AS pct_2021
      FROM cells WHERE type_id = 6 AND student_group_id = 1 AND pct_met_and_above IS NOT NULL AND year IN (2019, 2021)
      GROUP BY district_code, test_id, cohort_year)""", """
r AS (SELECT *, pct_2021 - pct_2019 AS change,
             CAST(row_number() OVER (PARTITION BY test_id ORDER BY pct_2021 - pct_2019, district_code, cohort_year) AS INTEGER) AS rank
      FROM p WHERE pct_2019 IS NOT NULL AND pct_2021 IS NOT NULL)""") + f"""
SELECT test_id, rank, district_code, cohort_year, pct_2019, pct_2021, change FROM r WHERE rank <= {TOP_K}""",
    doubles=("pct_2019", "pct_2021", "change"))
def n08_cohorts_hit_by_gap_year(spark, sf_dir):
    """Same cohort across the untested year (2019 → 2021, two grades apart): most negative changes per subject."""
    c = cells(spark, sf_dir).filter((F.col("type_id") == C.TYPE_DISTRICT) & (F.col("student_group_id") == 1)
                                    & F.col(PCT).isNotNull() & F.col("year").isin(2019, 2021))
    y = F.col("year")
    p = (c.groupBy("district_code", "test_id", "cohort_year")
         .agg(F.max(F.when(y == 2019, F.col(PCT))).alias("pct_2019"), F.max(F.when(y == 2021, F.col(PCT))).alias("pct_2021"))
         .dropna(subset=["pct_2019", "pct_2021"]).withColumn("change", F.col("pct_2021") - F.col("pct_2019")))
    r = top_k(p, ["test_id"], [F.col("change"), F.col("district_code"), F.col("cohort_year")], TOP_K)
    return r.select("test_id", "rank", "district_code", "cohort_year", "pct_2019", "pct_2021", "change")


# N9 -------------------------------------------------------------------------------------------------------
@register("n09_vs_state_every_cell", with_cells("""
s AS (SELECT year, grade, test_id, student_group_id, pct_met_and_above AS state_pct FROM cells WHERE type_id = 4)""") + f"""
SELECT c.type_id, c.county_code, c.district_code, c.school_code, c.year, c.grade, c.test_id, c.student_group_id,
       c.pct_met_and_above, s.state_pct, c.pct_met_and_above - s.state_pct AS diff
FROM cells c JOIN s ON c.year = s.year AND c.grade = s.grade AND c.test_id = s.test_id AND c.student_group_id = s.student_group_id
WHERE c.type_id <> 4 AND c.pct_met_and_above IS NOT NULL""", doubles=(PCT, "state_pct", "diff"))
def n09_vs_state_every_cell(spark, sf_dir):
    """Every county/district/school cell against the state cell with the same year, grade, test and group."""
    c = cells(spark, sf_dir)
    keys = ["year", "grade", "test_id", "student_group_id"]
    state = c.filter(F.col("type_id") == C.TYPE_STATE).select(*keys, F.col(PCT).alias("state_pct"))
    rows = c.filter((F.col("type_id") != C.TYPE_STATE) & F.col(PCT).isNotNull()).select(*ENT, *keys, PCT)
    return rows.join(state, keys).withColumn("diff", F.col(PCT) - F.col("state_pct"))


# N10 ------------------------------------------------------------------------------------------------------
@register("n10_peer_schools", with_cells(f"""
s AS (SELECT type_id, school_code, test_id, year,
         sum(CASE WHEN student_group_id = 1 AND {OK_SQL} THEN pct_met_and_above * students_tested END)
           / sum(CASE WHEN student_group_id = 1 AND {OK_SQL} THEN students_tested END) AS pct_met_and_above,
         coalesce(sum(CASE WHEN student_group_id = 1 THEN students_tested END), 0) AS all_n,
         coalesce(sum(CASE WHEN student_group_id = 2 THEN students_tested END), 0) AS el_n
      FROM cells WHERE type_id IN (7, 9) AND student_group_id IN (1, 2)
      GROUP BY type_id, school_code, test_id, year)""", """
b AS (SELECT *, CAST(length(bin(all_n)) - 1 AS INTEGER) AS size_bucket, CAST((el_n * 10) // all_n AS INTEGER) AS share_bucket
      FROM s WHERE all_n > 0 AND pct_met_and_above IS NOT NULL)""", """
p AS (SELECT test_id, year, size_bucket, share_bucket, avg(pct_met_and_above) AS peer_avg, count(*) AS peers
      FROM b GROUP BY test_id, year, size_bucket, share_bucket)""") + """
SELECT b.type_id, b.school_code, b.test_id, b.year, b.size_bucket, b.share_bucket, b.pct_met_and_above,
       p.peer_avg, p.peers, b.pct_met_and_above - p.peer_avg AS diff
FROM b JOIN p USING (test_id, year, size_bucket, share_bucket)""", doubles=(PCT, "peer_avg", "diff"))
def n10_peer_schools(spark, sf_dir):
    """Schools against peers of similar size (log2 bucket) and EL share (decile); peers via bucket aggregates."""
    v, n, g = F.col(PCT), F.col(N), F.col("student_group_id")
    ok = finite(v) & (n > 0)
    c = cells(spark, sf_dir).filter(F.col("type_id").isin(*C.TYPE_SCHOOL) & g.isin(1, 2))
    s = c.groupBy("type_id", "school_code", "test_id", "year").agg(
        (F.sum(F.when((g == 1) & ok, v * n)) / F.sum(F.when((g == 1) & ok, n))).alias(PCT),
        F.coalesce(F.sum(F.when(g == 1, n)), F.lit(0)).alias("all_n"),
        F.coalesce(F.sum(F.when(g == 2, n)), F.lit(0)).alias("el_n"))
    b = (s.filter((F.col("all_n") > 0) & F.col(PCT).isNotNull())
         .withColumn("size_bucket", (F.length(F.bin("all_n")) - 1).cast("int"))
         .withColumn("share_bucket", F.expr("(el_n * 10) div all_n").cast("int")))
    keys = ["test_id", "year", "size_bucket", "share_bucket"]
    peers = b.groupBy(*keys).agg(F.avg(PCT).alias("peer_avg"), F.count(F.lit(1)).alias("peers"))
    j = b.join(peers, keys)
    return j.select("type_id", "school_code", "test_id", "year", "size_bucket", "share_bucket", PCT, "peer_avg",
                    "peers", (F.col(PCT) - F.col("peer_avg")).alias("diff"))


# N11 ------------------------------------------------------------------------------------------------------
@register("n11_vs_own_history", with_cells() + f"""
SELECT * , pct_met_and_above - hist_avg AS vs_history FROM (
  SELECT {ENT_SQL}, test_id, student_group_id, grade, year, pct_met_and_above,
         avg(pct_met_and_above) OVER (PARTITION BY {ENT_SQL}, test_id, student_group_id, grade ORDER BY year
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist_avg
  FROM cells WHERE pct_met_and_above IS NOT NULL) t""", doubles=(PCT, "hist_avg", "vs_history"))
def n11_vs_own_history(spark, sf_dir):
    """Each cell against the mean of the same series' earlier years (window bounded by the year domain)."""
    series = [*ENT, "test_id", "student_group_id", "grade"]
    c = A.dealt(cells(spark, sf_dir).filter(F.col(PCT).isNotNull()), series)
    w = (Window.partitionBy(*series).orderBy("year")
         .rowsBetween(Window.unboundedPreceding, -1))
    out = c.select(*ENT, "test_id", "student_group_id", "grade", "year", PCT).withColumn("hist_avg", F.avg(PCT).over(w))
    return out.withColumn("vs_history", F.col(PCT) - F.col("hist_avg"))
