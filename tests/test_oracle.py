"""Every query with SQL gives the rows of that SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from driftlake.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def ordered(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if v is None or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got, want = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        if pd.api.types.is_numeric_dtype(got[c]) and not pd.api.types.is_bool_dtype(got[c]):
            a, b = got[c].astype(float), want[c].astype(float)
            assert (((a - b).abs() <= 2e-5 * (1 + b.abs())) | (a.isna() & b.isna())).all(), c
        else:
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
