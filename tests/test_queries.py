"""Every query with SQL against DuckDB on the smallest test data; every other one must run."""

import math
import os

import duckdb
import pytest

from sedimenta import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in plans.ORACLE_SQL:
        result = con.execute(plans.ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, result.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score", "matched"] and df.count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
