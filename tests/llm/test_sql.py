"""Queries of the operators that SQL can express, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tracefold.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.queries()[name](spark, str(DATA))
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(result.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want and want
