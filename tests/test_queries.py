"""Every query of the library against its DuckDB SQL, on the driver's smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from airgrid.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def comparable(df: pd.DataFrame) -> list:
    cell = lambda x: None if pd.isna(x) else round(x, 6) if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
