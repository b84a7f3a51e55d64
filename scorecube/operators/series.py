"""Ordered-series operators: spines, gaps, change, base-year index.

Series are long DataFrames partitioned by entity keys; every window is ``partitionBy(entity keys)`` so the work
spreads over entities. Spines are generated from the parameter domain with ``explode`` over the distinct
partition keys (no join against a driver-built table, no cross join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def on_spine(df: DataFrame, keys, axis: str, domain, ord_col: str | None = None,
             frame: DataFrame | None = None) -> DataFrame:
    """J10/J11 – complete each ``keys`` partition to the ordered ``domain`` of ``axis``; holes are null.

    Partitions come from ``frame`` (default: ``df``). ``ord_col`` keeps the domain position."""
    keys = list(keys)
    parts = (frame if frame is not None else df).select(*keys).distinct() if keys else None
    dom = F.array(*[F.lit(v) for v in domain])
    if parts is None:
        grid = df.sparkSession.range(1).select(F.posexplode(dom).alias("_ord", axis))
    else:
        grid = parts.select(*keys, F.posexplode(dom).alias("_ord", axis))
    out = grid.join(df, keys + [axis], "left")
    return out.withColumnRenamed("_ord", ord_col) if ord_col else out.drop("_ord")


def pivot_sides(df: DataFrame, keys, sides: dict, value: str = C.PCT) -> DataFrame:
    """J6/J8/J9 – per key one row with a column for each side: ``sides`` maps its name to the condition of its rows.

    One aggregate instead of a self join; a key needs a row on every side (an inner alignment): each side sets its bit in a mask,
    and only full masks stay. Rows must be unique in (keys, side)."""
    names = list(sides)
    bits = F.lit(0)
    for i, cond in enumerate(sides.values()):
        bits = bits.bitwiseOR(F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)))
    out = df.groupBy(*keys).agg(*[F.max(F.when(sides[n], F.col(value))).alias(n) for n in names], F.bit_or(bits).alias("_mask"))
    return out.filter(F.col("_mask") == (1 << len(names)) - 1).drop("_mask")


def gap(df: DataFrame, keys, a_side, b_side, value: str = C.PCT, a_name: str = "a", b_name: str = "b",
        out: str = "gap") -> DataFrame:
    """J6/J8 – a − b aligned on ``keys``, rows with a missing side dropped; ``a_side`` and ``b_side`` are conditions on the rows.

    The b value (one row for a key) reaches the key's a rows through a window over the key's few rows: one shuffle, no self join."""
    b = F.max(F.when(b_side, F.col(value))).over(Window.partitionBy(*keys))
    return (df.withColumn(b_name, b).filter(a_side).select(*keys, F.col(value).alias(a_name), b_name)
            .dropna(subset=[a_name, b_name]).withColumn(out, F.col(a_name) - F.col(b_name)))


def change(df: DataFrame, keys, order: str, value: str = C.PCT, out: str = "change",
           drop_first: bool = True) -> DataFrame:
    """W1/W2 – value − previous value within each partition, ordered by ``order``; first/undefined rows dropped.

    On a completed spine (``on_spine``) a missing year also removes the following year's change (W1); on the
    present rows only, missing years are bridged (W2)."""
    w = Window.partitionBy(*keys).orderBy(order)
    out_df = df.withColumn(out, F.col(value) - F.lag(value).over(w))
    return out_df.filter(F.col(out).isNotNull()) if drop_first else out_df


def change_on_domain(df: DataFrame, keys, axis: str = "year", domain=C.YEARS, value: str = C.PCT,
                     out: str = "change") -> DataFrame:
    """W1 without materialising the spine: value − previous value only when the previous present row is the
    immediately preceding position of the domain (so 2021 follows 2019, and a missing year also voids the next
    year's change). One window per partition; no distinct, no join."""
    pos = F.array_position(F.array(*[F.lit(v) for v in domain]), F.col(axis))
    w = Window.partitionBy(*keys).orderBy("_pos")
    d = df.withColumn("_pos", pos).filter(F.col("_pos") > 0)
    adjacent = F.lag("_pos").over(w) == F.col("_pos") - 1
    d = d.withColumn(out, F.when(adjacent, F.col(value) - F.lag(value).over(w)))
    return d.filter(F.col(out).isNotNull()).drop("_pos")


def index_to_base(df: DataFrame, keys, value: str = C.PCT, axis: str = "year", base=C.YEARS[0],
                  out: str = "index") -> DataFrame:
    """W5 – value / value(base) × 100 per partition; a missing base makes the whole partition null."""
    w = Window.partitionBy(*keys)
    base_v = F.max(F.when(F.col(axis) == base, F.col(value))).over(w)
    return df.withColumn(out, F.try_divide(F.col(value), base_v) * 100)
