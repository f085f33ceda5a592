"""Queries with SQL give the rows that DuckDB gives, at sf0.01 (the driver's size)."""

import os

import duckdb
import pytest

from gleaner.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(SQL[name])
    columns = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == want and got
