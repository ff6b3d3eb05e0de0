"""Every registered query that has SQL gives what DuckDB gives, at the smallest scale."""

import math
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PLAIN = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, numbers.Integral) and not isinstance(v, (bool, np.bool_)) and abs(int(v)) < 1 << 53:
        return float(v)  # a column of integers with nulls may come as floats
    return float(v) if isinstance(v, float) else str(v)


def normal(df: pd.DataFrame) -> list:
    """Rows in an order that doesn't depend on the last digits of numbers."""
    rows = [tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: ([x or "" for x in r if not isinstance(x, float)], [f"{x:.7g}" for x in r if isinstance(x, float)], [x for x in r if isinstance(x, float)]))


def same(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    return x == y


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", PLAIN)
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got.astype(object)), normal(want.astype(object))
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))] == []


def test_one_sketch_a_type(spark):
    """A sketch of 13 KB beside a DISTINCT would be kept for each user."""
    plan = entry.queries()["approx_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "approx_count_distinct" in x and "user_id" in x.split("functions=")[0]] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
