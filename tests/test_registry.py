"""Every query with SQL agrees with it on the small tables; the entry runs."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from cytolake.plans import registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, (list, np.ndarray, tuple)):
        return tuple(map(plain, x))
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (float, np.floating)):
        return round(float(x), 6)
    return bool(x) if isinstance(x, np.bool_) else int(x) if isinstance(x, np.integer) else x


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, TABLES).toPandas()) == rows(duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, TABLES).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
