"""Every query with SQL gives the rows that DuckDB gives, at sf0.01."""

import math
import os

import duckdb
import pytest

from gleaner.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float) and not math.isnan(x):
            return round(x, 6)
        return x

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want) > 0
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
