"""The operators that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from conftest import SF_SMALL
from scorecube.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF_SMALL).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
