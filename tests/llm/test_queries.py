"""The queries of this subpackage on the smallest test data, those with SQL against DuckDB."""

import os

import duckdb
import pytest

from sedimenta.llm import queries

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    assert got
    if name.endswith("_found"):
        assert len(got) == len(set(got))
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in os.listdir(FOLDER):
            con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{t}')")
        result = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert sorted(names) == sorted(df.columns)
        assert plain(got) == plain(tuple(r[i] for i in order) for r in result.fetchall())
