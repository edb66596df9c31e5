"""Every query of the core against its twin in the checking engine, on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillmetry.plans import load

DATA = os.environ.get("QUERY_TEST_DATA", "/root/testdata/sf0.001")
catalog = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, float | np.floating):
        return None if math.isnan(x) else float(x)
    if isinstance(x, np.ndarray | list):
        return tuple(plain(i) for i in x)
    if type(x) is datetime.date:
        x = pd.Timestamp(x)
    return x.item() if isinstance(x, np.generic) else str(x) if isinstance(x, pd.Timestamp) else x


def order_of(row: tuple) -> tuple:
    """Exact values first, so that the last digits of floats can't change the order of rows."""
    whole = [round(x) if isinstance(x, float) and abs(x) < 1e15 and abs(x - round(x)) < 1e-9 else x for x in row]  # a column of integers with nulls comes as floats
    return tuple(repr(x) for x in whole if not isinstance(x, float)), tuple(f"{x:.5g}" for x in whole if isinstance(x, float))


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=order_of)


def same(a, b) -> bool:
    if isinstance(a, float | int) and isinstance(b, float | int) and not isinstance(a, bool) and not isinstance(b, bool):
        return a == pytest.approx(b, rel=1e-7, abs=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equal(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert same(a, b), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    """What has no twin is executed whole; its values are tested beside its operator."""
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns and len(df.toPandas().columns) == len(df.columns)


def test_monthly_statistics_push_down(spark):
    plan = catalog.QUERIES["monthly_feature_stats"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
