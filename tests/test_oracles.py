"""Every query with SQL agrees with DuckDB on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def rows(columns, data):
    """Rows as comparable text, columns by name, floats to six digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: repr(round(float(v), 6)) if isinstance(v, float | int) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else repr(v)
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_agrees(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    cur = con.execute(SQL[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    df = QUERIES[name](spark, sf)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
