"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tracefold.plans import catalogue, catalogue_more  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    result = db.execute(catalogue.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns, want) == canonical(result.fetchall(), columns, want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).limit(1).count() == 1
