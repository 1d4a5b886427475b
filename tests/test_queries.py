"""Registered queries against DuckDB at the smallest scale."""

import os

import pytest

from tessellon.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


def check(spark, sf, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}'")
    got, want = query(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    check(spark, sf, registry.queries()[name], registry.oracle_sql()[name])
