"""Named queries: a Spark plan plus (optionally) an equivalent DuckDB SQL oracle.

Double outputs are rounded to 6 decimals on both sides (floating sums depend on evaluation order).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..sources.cells import CELLS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def with_cells(*ctes: str) -> str:
    """``WITH`` prefix holding the cells derivation and further CTEs."""
    return "WITH " + ",\n".join([CELLS_SQL.strip()] + [c.strip() for c in ctes])


def rounded_sql(body: str, doubles=()) -> str:
    if not doubles:
        return body
    # "+ 0.0" turns a rounded -0.0 into 0.0 (Spark's round already yields 0.0 there)
    rep = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS q"


def register(name: str, sql: str | None = None, doubles=()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(sql, doubles)
        return fn
    return deco
