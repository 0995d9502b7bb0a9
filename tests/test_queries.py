"""Every query with SQL gives, on a small scale, what DuckDB gives."""

import os

import duckdb
import pytest

from recollect.plans import flows, read, write

SF = "/root/testdata/sf0.01"
QUERIES = read.R.queries | write.R.queries | flows.R.queries
SQL = read.R.sql | write.R.sql | flows.R.sql


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def norm(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({SQL[name]})")
    assert norm(map(tuple, df.select(columns).collect())) == norm(want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
