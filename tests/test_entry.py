"""The driver's contract, and the queries against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from lumenrank.oracles import ORACLES
from lumenrank.queries import QUERIES

TABLES = "documents embeddings benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def cell(v):
    if v is None or (not isinstance(v, (list, dict, np.ndarray)) and pd.isna(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return f"{float(v):.9g}" if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_duckdb(spark, sf_dir, duck, name):
    a, b = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_windows_are_not_degenerate(spark, sf_dir):
    hits = {r["hit"] for r in QUERIES["ttl_cache"](spark, sf_dir).collect()}
    assert hits == {True, False} and {r["skipped"] for r in QUERIES["latency_budget"](spark, sf_dir).collect()} == {True, False}
