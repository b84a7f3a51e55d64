"""O4/O5 – ordered results: a distributed ordinal.

Rows are range-partitioned on the order and sorted inside their partitions; a row's place is its place in the partition plus
the rows of all partitions before it. Those are prefix sums over one count for a partition, so no task sees more than its own range
(a window without partition keys would sort the whole table in one task)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def with_ordinal(df: DataFrame, *order, name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1 for the first row in ``order`` (columns, ascending with nulls last unless they say otherwise), 2 for the
    next, and so on. ``order`` should be total: rows equal in it are numbered in any order."""
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    # the number within a partition: the lower 33 bits
    placed = ranged.sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"))
    shared_dir(df.sparkSession)
    placed = placed.checkpoint()  # counts and rows must come from the same ranges
    counts = dict(placed.groupBy("_part").count().collect())  # a number for a partition
    parts = sorted(counts)
    before = dict(zip(parts, accumulate([0, *[counts[p] for p in parts[:-1]]])))
    if not before:
        return placed.drop("_part", "_place").withColumn(name, F.lit(0).cast("long"))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part"))
    return placed.withColumn(name, (base + F.col("_place") + 1).cast("long")).drop("_part", "_place")
