"""Every query of the engine against its SQL twin in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from colloquy.plans import answer_queries, date_queries, line_queries, queries, signal_queries, store_queries

QUERIES = queries.QUERIES | store_queries.QUERIES | line_queries.QUERIES | answer_queries.QUERIES | signal_queries.QUERIES | date_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | store_queries.ORACLE_SQL | line_queries.ORACLE_SQL | answer_queries.ORACLE_SQL | signal_queries.ORACLE_SQL | date_queries.ORACLE_SQL
TABLES = Path(os.environ.get("ORACLE_TABLES", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def same(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    found = QUERIES[name](spark, str(TABLES))
    columns = sorted(found.columns)
    wanted = duck.sql(ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    assert same(found.select(*columns).collect()) == same(wanted.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    found = QUERIES[name](spark, str(TABLES))
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
