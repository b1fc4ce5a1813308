"""Every registered query runs, and those with a DuckDB twin give its rows (small scale factor)."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows_of(columns, cur.fetchall())
