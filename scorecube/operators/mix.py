"""Group-mix operators (P18, P19, the mix frame behind Q35–Q40, Q52, Q66).

The mix frame per (keys, year): el_pct = Σn(EL)/Σn(All)·100 over NON-suppressed cells (weights of the weighted
averages – unlike ``group_share``), el_perf, fluent_perf, overall_perf; rows lacking el_pct or overall dropped.
Built from one weighted-average pass over the three groups, pivoted with conditional aggregation (no joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .aggregate import weighted_average


def mix_frame(df: DataFrame, keys=(), part: str = C.SG_EL, rest: str = C.SG_FLUENT, whole: str = C.SG_ALL,
              group_col: str = "student_group_name") -> DataFrame:
    keys = list(keys)
    wa = weighted_average(df.filter(F.col(group_col).isin(part, rest, whole)), keys + [group_col, "year"])

    def pick(name, col):
        return F.max(F.when(F.col(group_col) == name, F.col(col)))

    m = (wa.groupBy(*keys, "year")
         .agg(pick(part, C.PCT).alias("el_perf"), pick(rest, C.PCT).alias("fluent_perf"),
              pick(whole, C.PCT).alias("overall_perf"), pick(part, C.N).alias("_el_n"),
              pick(whole, C.N).alias("_all_n")))
    el_pct = F.when(F.col("_all_n") > 0, F.col("_el_n") / F.col("_all_n") * 100)
    return (m.withColumn("el_pct", el_pct).drop("_el_n", "_all_n")
            .dropna(subset=["el_pct", "overall_perf"]))


def counterfactual(mix: DataFrame, keys, base_year: int = C.YEARS[0]) -> DataFrame:
    """P19 – performance had the part share stayed at its base-year value; a series without the base year has no rows."""
    if not keys:
        raise ValueError("counterfactual needs the series keys (a keyless window would run in one task)")
    w = Window.partitionBy(*keys)
    base = F.max(F.when(F.col("year") == base_year, F.col("el_pct"))).over(w) / 100
    mix = mix.withColumn("_base", base).filter(F.col("_base").isNotNull())
    return mix.withColumn("simulated_perf", F.col("_base") * F.col("el_perf") + (1 - F.col("_base")) * F.col("fluent_perf")).drop("_base")


def contributions(mix: DataFrame) -> DataFrame:
    """P18 – part share × part perf and (1 − share) × rest perf (rows with all three inputs)."""
    m = mix.dropna(subset=["el_pct", "el_perf", "fluent_perf"])
    return (m.withColumn("el_contrib", F.col("el_pct") / 100 * F.col("el_perf"))
            .withColumn("fluent_contrib", (1 - F.col("el_pct") / 100) * F.col("fluent_perf")))
