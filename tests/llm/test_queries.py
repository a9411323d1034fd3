"""The queries that SQL can express, against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from cubespark.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "conversations", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    have = sorted(str(tuple(r)) for r in got.select(columns).collect())
    assert have and have == sorted(map(str, want.fetchall()))
