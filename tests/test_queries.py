import os
from math import isnan

import pytest

import __spark_entry__
from canteria.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if isinstance(r[i], float) and isnan(r[i]) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name, request):
    df = QUERIES[name](spark, data)
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        answer = request.getfixturevalue("duck").execute(SQL[name])
        columns = [c[0] for c in answer.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, answer.fetchall())
    else:
        assert got


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
