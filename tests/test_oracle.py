"""Every query with an SQL form against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tapeworks.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) else repr(v)
    return str(v).replace("T", " ").replace(" 00:00:00", "")


def rows(df):
    return sorted(tuple(norm(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() == 5
