"""Every query with SQL agrees with DuckDB on the small tables, and all queries have stable columns."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, float | np.floating) or type(x).__name__ == "Decimal":
        x = float(x)
        return None if math.isnan(x) else int(x) if x == int(x) else round(x, 8)
    return x.item() if hasattr(x, "item") else x


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(str(plain(x)) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    columns, got = table(QUERIES[name](spark, SF).toPandas())
    if name in ORACLES:
        assert (columns, got) == tuple(table(duck.execute(ORACLES[name]).df()))
    else:
        assert got and columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
