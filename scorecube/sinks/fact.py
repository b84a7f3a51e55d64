"""K1 – the sorted fact write.

One range shuffle on the six sort keys (the code columns split the few-valued leading keys, so no range is
hot), sort within partitions with nulls first, zstd, bounded row groups so readers skip row groups by min/max.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import ROWS_PER_TASK, task_count

ROW_GROUP_ROWS = 100_000
#: code columns looked up by value: a row group's Bloom filter tells which of them it can't hold (F15). The size is for
#: BLOOM_CODES distinct codes in a row group; more only make it less selective.
BLOOM_COLUMNS = ("district_code", "school_code")
BLOOM_CODES = 20_000


def sorted_for_fact(df: DataFrame, keys=C.FACT_SORT_KEYS, partitions: int | None = None) -> DataFrame:
    order = [F.col(k).asc_nulls_first() for k in keys]
    parted = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return parted.sortWithinPartitions(*order)


def write_sorted_fact(df: DataFrame, path: str, keys=C.FACT_SORT_KEYS, partitions: int | None = None,
                      mode: str = "errorifexists", row_group_rows: int = ROW_GROUP_ROWS,
                      partition_by: tuple = (), finish=None) -> None:
    """``partition_by=("year",)`` adds directory pruning for year predicates; the range partitioning on the sort
    keys (year first) means each task writes into one or two year directories.

    ``partitions``: by default as many as the rows need (``task_count``; counted first, so ``df`` should be cheap to count, as a read
    table is). ``finish``: a row-wise step after the sort, for columns that need not be dealt."""
    table = sorted_for_fact(df, keys, partitions or task_count(df.count()))
    table = finish(table) if finish else table
    w = (table.write.mode(mode)
         .option("compression", "zstd")
         .option("parquet.block.row.count.limit", row_group_rows)
         .option("maxRecordsPerFile", ROWS_PER_TASK))  # readers' tasks go by bytes and files: rows compress to three bytes
    for c in BLOOM_COLUMNS:
        if c in table.columns:
            w = (w.option(f"parquet.bloom.filter.enabled#{c}", "true")
                 .option(f"parquet.bloom.filter.expected.ndv#{c}", BLOOM_CODES))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
