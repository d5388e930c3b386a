"""Every query gives the rows of its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from shiftwell import queries as q


def rows(df) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).values.tolist()))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_same_rows(spark, duck, sf_dir, name):
    got, want = q.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_range_is_pushed_down(spark, sf_dir):
    plan = q.range_scan_2col(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(conv_id,3)" in plan and "Or(GreaterThan(c" in plan


def test_entry():
    import __spark_entry__ as e

    assert {"copy_then_replay", "chunk_plan"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
