"""Every query with SQL against DuckDB, and every other one for rows, at the smallest scale."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lockstep.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"redundancy_sweep", "duplication_verdict", "audit_report", "panel_strategies", "strategy_contrast"}  # covered by test_operators.py

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 9) + 0.0
    if isinstance(v, (np.integer, np.bool_)):
        return v.item()
    return str(v)[:19] if isinstance(v, pd.Timestamp) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, oracle, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(oracle.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - SLOW))
def test_has_rows(spark, name):
    assert not registry.QUERIES[name](spark, DATA).isEmpty()
