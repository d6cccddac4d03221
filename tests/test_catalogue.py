"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from larkspur.plans import catalogue, everyday, learning, nested, streams, systems  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else round(float(x), 6) if isinstance(x, float) else x
    return sorted(repr(tuple(clean(x) for x in r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, sf, con, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
