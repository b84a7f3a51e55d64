"""Top-k per key. Joins are plain: adaptive execution picks the strategy by the measured size of the sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, partition, order, k: int, rank_col: str = "rank") -> DataFrame:
    """O6 – first ``k`` rows per partition by ``order`` (deterministic: callers end ``order`` with a unique key).

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit before the shuffle, so each map task
    ships at most k rows per partition key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
