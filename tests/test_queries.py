"""Every query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tallyspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(df):
    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
