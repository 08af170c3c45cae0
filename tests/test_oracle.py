"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ALL, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    # pandas makes a column of integers one of floats where a value is missing, DuckDB does not
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted(repr([plain(x) for x in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in ALL if n in SQL])
def test_same_rows(spark, duck, name):
    mine, theirs = ALL[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(ALL)
