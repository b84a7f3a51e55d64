"""Aggregation operators (A1–A14). All algebraic (sum/count/min/max/regr_*), so Spark combines map-side and a
hot key (e.g. the state level, a third of all rows) never lands whole in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import finite
from ..session import task_count


def dealt(df: DataFrame, keys) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its rows need, for groups of a few rows each (an entity's series): a map side that
    combines them holds nearly every row of its split and saves nothing. Counts ``df`` first, so it should be cheap to count."""
    return df.repartition(task_count(df.count()), *keys)


def weighted_average(df: DataFrame, keys, value: str = C.PCT, weight: str = C.N,
                     out: str = C.PCT, out_weight: str = C.N) -> DataFrame:
    """A1 – Σ(value·weight)/Σweight per key over rows with value, weight present and weight > 0.

    Keys with no surviving row are absent; null keys are dropped (as a pandas groupby would)."""
    keys = list(keys)
    v, w = F.col(value), F.col(weight)
    ok = finite(v) & w.isNotNull() & (w > 0)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return (df.filter(ok).groupBy(*keys)
            .agg((F.sum(v * w) / F.sum(w)).alias(out), F.sum(w).cast("double").alias(out_weight)))


def headcount(df: DataFrame, keys, weight: str = C.N, out: str = "students") -> DataFrame:
    """A2 – Σ students per key, suppressed cells included; an all-null sum is 0."""
    keys = list(keys)
    return (df.dropna(subset=keys).groupBy(*keys)
            .agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias(out)))


def mean_by(df: DataFrame, keys, value: str = C.PCT, out: str = C.PCT) -> DataFrame:
    """A3/A4 – unweighted mean (nulls skipped) per key; keys whose values are all null yield null."""
    keys = list(keys)
    return df.dropna(subset=keys).groupBy(*keys).agg(F.avg(value).alias(out))


def distinct_count(df: DataFrame, keys, col: str, out: str) -> DataFrame:
    """A5."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.countDistinct(col).alias(out))


def group_share(df: DataFrame, keys, part, whole, weight: str = C.N, out: str = "share") -> DataFrame:
    """A6 – Σweight(part) / Σweight(whole) × 100 per key in one pass; keys lacking either side are absent."""
    keys = list(keys)
    num = F.coalesce(F.sum(F.when(part, F.col(weight))), F.lit(0))
    den = F.coalesce(F.sum(F.when(whole, F.col(weight))), F.lit(0))
    has = F.max(F.when(part, 1)).isNotNull() & F.max(F.when(whole, 1)).isNotNull()
    return (df.filter(part | whole).dropna(subset=keys).groupBy(*keys)
            .agg(has.alias("_has"), (F.try_divide(num.cast("double"), den) * 100).alias(out))
            .filter("_has").drop("_has"))


def bounds(df: DataFrame, keys, value: str, pad: float, lo: float | None = 0.0, hi: float | None = 100.0,
           empty_lo: float | None = None, empty_hi: float | None = None) -> DataFrame:
    """A7 – padded bounds max(lo, min − pad), min(hi, max + pad) per key (clamps optional)."""
    vmin, vmax = F.min(value) - pad, F.max(value) + pad
    y_lo = F.greatest(F.lit(lo), vmin) if lo is not None else vmin
    y_hi = F.least(F.lit(hi), vmax) if hi is not None else vmax
    if empty_lo is not None:
        y_lo, y_hi = F.coalesce(y_lo, F.lit(float(empty_lo))), F.coalesce(y_hi, F.lit(float(empty_hi)))
    return (df.filter(finite(value)).groupBy(*keys)
            .agg(y_lo.cast("double").alias("y_lo"), y_hi.cast("double").alias("y_hi")))


def regression(df: DataFrame, keys, x: str, y: str, min_points: int = 3) -> DataFrame:
    """A11 – ordinary least squares y = slope·x + intercept per key (built-in regr_*), only with enough points."""
    keys = list(keys)
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = ok.groupBy(*keys) if keys else ok.groupBy()
    return (g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_count(y, x).alias("n_points"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))
            .filter(F.col("n_points") >= min_points))


def fitted_line(reg: DataFrame, keys=(), samples: int = 50) -> DataFrame:
    """A12 – ``samples`` evenly spaced x in [x_min, x_max] and the fitted y (one generator per fit row)."""
    step = F.when(F.lit(samples) > 1, (F.col("x_max") - F.col("x_min")) / (samples - 1)).otherwise(F.lit(0.0))
    out = reg.select(*keys, "slope", "intercept", "x_min", step.alias("step"),
                     F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
    x = F.col("x_min") + F.col("i") * F.col("step")
    return out.select(*keys, "i", x.alias("x"), (F.col("slope") * x + F.col("intercept")).alias("y_fit"))


def pivot_mean(df: DataFrame, row: str, col: str, values, value: str = C.PCT) -> DataFrame:
    """A9 – display pivot (row × listed column values) of the unweighted mean."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.avg(value))


def selection_status(df: DataFrame, keys, year: str = "year") -> DataFrame:
    """A13 – rows and sorted distinct years per key."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"),
                                  F.array_sort(F.collect_set(year)).alias("years")))


def distinct_small(column: str, name: str):
    """A10 – how many distinct values a 16-bit integer column has, as one aggregate over bitmaps: a bit for each value, in one bitmap
    of 32,768 bits for the values from 0 on and one for those below. Bitmaps unite in any order, so the aggregate is partial on
    the map side and needs no ``Expand`` beside others."""
    def ones(cond: str, shift: int) -> str:
        return f"bitmap_count(bitmap_construct_agg(bitmap_bit_position(int({column}) + {shift})) FILTER (WHERE {column} {cond}))"
    return F.expr(f"{ones('>= 0', 1)} + {ones('< 0', 32769)}").alias(name)
