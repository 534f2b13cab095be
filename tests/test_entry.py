"""Every registered query over the smallest tables, and against its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db(small_dir):
    c = duckdb.connect()
    for f in os.listdir(small_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{small_dir}/{f}'")
    return c


def shown(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str([shown(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    got = rows_of(df.collect(), df.columns)
    if name in SQL:
        found = db.sql(SQL[name])
        columns = found.columns
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(found.fetchall(), columns)


def test_entry_runs(spark):
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)
