"""Every query of the library's own against its SQL, as the driver compares them."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from shoal.queries import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(df):
    columns = sorted(df.columns)
    cell = lambda v: "null" if pd.isna(v) else v if isinstance(v, str) else repr(float(v))
    return columns, sorted(tuple(map(cell, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    assert plain(__spark_entry__.queries()[name](spark, SF).toPandas()) == plain(tables.sql(ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
