"""Every query with SQL against DuckDB, as the driver compares them."""

import glob
import os

import duckdb
import pytest

from weftline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, rel.project(",".join(cols)).fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
