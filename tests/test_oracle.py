"""Every registered query against its DuckDB oracle on sf0.001 (row count,
column names, order-insensitive values)."""

import math
import os

import duckdb
import pytest

from conftest import SF001

import __spark_entry__ as E
from routelytics.plans.catalog import all_oracles

TABLES = ["events", "orders"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, int):
            return float(v)
        return str(v) if not isinstance(v, str) else v
    return sorted(repr(tuple(n(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    rel = con.sql(E.oracle_sql()[name])
    orows, ocols = rel.fetchall(), rel.columns
    assert sorted(cols) == sorted(ocols)
    assert _norm(rows, cols) == _norm(orows, ocols)


def test_entry(spark):
    rows = {r.target_queue: r.n for r in E.entry(spark).collect()}
    assert rows == {"urgent.queue": 538, "batch.queue": 462}
