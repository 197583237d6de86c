import os

import duckdb
import pytest

import __spark_entry__
from depdelver.plans import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("key", queries.SQL)
def test_query_equals_sql(spark, db, key):
    df = queries.QUERIES[key](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(str, got)) == sorted(map(str, db.sql(f"SELECT {quoted} FROM ({queries.SQL[key]})").fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["lhs", "rhs"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
