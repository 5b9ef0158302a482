"""Every registered analytics query against its SQL, run by DuckDB on the same tables."""

import decimal
import glob
import os

import duckdb
import pytest

from tickloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return repr(float(v)) if isinstance(v, decimal.Decimal) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_as_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert df.columns  # a tape with gaps may have no whole bucket, so no rows
        return
    want = db.sql(catalogue.ORACLES[name])
    names = want.columns
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall())
