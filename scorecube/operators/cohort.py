"""Cohort operators.

A cohort is the set of cells sharing ``cohort_year`` within one entity; trajectories are windows partitioned by
(entity keys, cohort_year) and ordered by grade – the partition is bounded by the grade domain (7 rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import finite
from .select import min_points


def cohort_points(df: DataFrame) -> DataFrame:
    """F8 – cells usable in a trajectory (score and cohort present)."""
    return df.dropna(subset=[C.PCT, "cohort_year"])


def trajectories(df: DataFrame, keys=(), min_n: int = 2) -> DataFrame:
    """W6 + F12 – per (keys, cohort) the points ordered by grade, with ``point`` index and ``n_points``;
    cohorts with fewer than ``min_n`` points are dropped."""
    part = list(keys) + ["cohort_year"]
    pts = min_points(cohort_points(df), part, min_n)
    w = Window.partitionBy(*part).orderBy("grade", "year")
    return pts.withColumn("point", F.row_number().over(w))


def qualifying_cohorts(traj: DataFrame, keys=()) -> DataFrame:
    return traj.select(*keys, "cohort_year").distinct()


def paired(focus_traj: DataFrame, other: DataFrame, keys=()) -> DataFrame:
    """J18 – rows of ``other`` only for cohorts that qualify in ``focus_traj`` (left semi)."""
    return cohort_points(other).join(qualifying_cohorts(focus_traj, keys), list(keys) + ["cohort_year"], "left_semi")


def start_end(df: DataFrame, keys=(), g_from: int = 3, g_to: int = 8, value: str = C.PCT,
              order=("year", "district_code", "school_code")) -> DataFrame:
    """J13/W7 – per cohort, the value at ``g_from`` and at ``g_to`` (both required) by conditional aggregation.

    When a grade repeats within a cohort (a focus matching several entities), the first row in the fact's sort
    order wins: ``min_by`` on (year, district, school) – those of the columns present."""
    part = list(keys) + ["cohort_year"]
    g = F.col("grade")
    ordk = F.struct(*[F.col(c) for c in order if c in df.columns])
    s = F.min_by(F.when(g == g_from, F.col(value)), F.when(g == g_from, ordk))
    e = F.min_by(F.when(g == g_to, F.col(value)), F.when(g == g_to, ordk))
    return (df.dropna(subset=["cohort_year"]).filter(finite(value) & g.isin(g_from, g_to)).groupBy(*part)
            .agg(s.alias("start_pct"), e.alias("end_pct"))
            .dropna(subset=["start_pct", "end_pct"]))


def recent_split(df: DataFrame, from_year: int) -> tuple[DataFrame, DataFrame]:
    """F14/J17/U7 – (recent cohorts, older cohorts): a cohort is recent by its own year, so the sets are complements."""
    return df.filter(F.col("cohort_year") >= from_year), df.filter(F.col("cohort_year") < from_year)


def common_cohorts(df: DataFrame, side: str, sides, keys=()) -> DataFrame:
    """U4 – the rows of cohorts that every one of ``sides`` (values of the column ``side``) has: a mask of sides per cohort, over a
    window of the cohort's few rows, instead of an intersection and a semi join."""
    bit = F.lit(0)
    for i, value in enumerate(sides):
        bit = bit.bitwiseOR(F.when(F.col(side) == value, F.lit(1 << i)).otherwise(F.lit(0)))
    mask = F.bit_or(bit).over(Window.partitionBy(*keys, "cohort_year"))
    return df.withColumn("_mask", mask).filter(F.col("_mask") == (1 << len(sides)) - 1).drop("_mask")
