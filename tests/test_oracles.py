"""Every registered query with SQL gives the rows of that SQL, run by DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        assert glob.glob(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _table(df):
    names = sorted(df.columns)
    return sorted(df[names].astype(object).where(df[names].notna(), None).astype(str).itertuples(index=False, name=None)), names


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, sf, db, name):
    assert _table(entry.queries()[name](spark, sf).toPandas()) == _table(db.execute(entry.oracle_sql()[name]).df())
