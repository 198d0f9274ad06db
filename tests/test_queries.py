"""Every query with SQL gives the rows of its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(frame):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return str(v) if hasattr(v, "year") else v

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted([tuple(map(one, r)) for r in frame.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert plain(entry.queries()[name](spark, DATA).toPandas()) == plain(con.sql(SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
