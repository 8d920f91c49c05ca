"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from gimbal.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def text(df, cols):
    out = df[cols].astype(str).replace({"None": "nan", "<NA>": "nan", "-0.0": "0.0"})
    return out.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert text(got, cols).equals(text(want, cols))
