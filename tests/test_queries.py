"""Every registered query that has SQL gives the same rows as DuckDB does, on a small table."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from mwspark.jobs.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return c


def plain(x):
    """Whole numbers as integers, so that rows sort alike whatever a column's type."""
    x = x.item() if isinstance(x, np.generic) else x
    return None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x


def rows(pdf, cols):
    return sorted((tuple(plain(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows(got, cols) == rows(want, cols)
