"""Rules that may not hang on the order of summation, of rows or of tasks, and queries on later sessions than the small tables have."""

import duckdb
from pyspark.sql import functions as F

from tickloom.operators import chain as H
from tickloom.operators import premium as M
from tickloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_readings_that_equal_a_threshold_do(spark):
    """Of five readings the last differs: z is two exactly, whatever the noise of the quotes; then a reading at its baseline has z of zero."""
    quotes = [("S", 1, m, 5.1 + 1e-13 * m + x, 5.3 + 1e-13 * m + x, 6050.0, "CALL", 6000.0, 0, 0.2, 0.0) for m, x in enumerate((0.0, 0.0, 0.0, 0.0, 0.1))]
    df = spark.createDataFrame(quotes, "symbol string, session_date int, minute int, bid double, ask double, strike double, right string, underlying double, lag_seconds int, iv double, iv_error double")
    got = {r.minute: (r.z, r.slope) for r in M.premium_series(df).collect()}
    assert got[4] == (2.0, 0.05)


def test_closes_are_held_against_the_row_s_own_boundary(spark):
    rows = [("S", 1, 0, 50.0, "EXT-UP"), ("S", 1, 1, 30.0, "EXT-DOWN"), ("S", 1, 2, 30.0, "EXT-UP")]
    df = spark.createDataFrame(rows, "symbol string, session_date int, minute int, close double, regime string").withColumns({"prior_low": F.lit(25.0), "prior_high": F.lit(45.0)})
    got = {r.minute: (r.broke_down, r.broke_up) for r in M.boundary_tests(df).collect()}
    assert got[2] == (True, False)  # 30 and 30 lie under 45, and 50 lay over it; at minute 1 the boundary was 25


def test_latest_of_equal_quotes_is_the_same_in_any_order(spark):
    rows = [("R", "2026-01-05", 6000.0, "CALL", 100, 1.0, 1.5, g, o) for g, o in ((0.3, 1), (0.1, 9), (0.2, 5))]
    schema = "root string, expiration string, strike double, right string, ts int, bid double, ask double, gamma double, open_interest int"
    got = {tuple((r.gamma, r.open_interest) for r in H.latest_per_contract(spark.createDataFrame(order, schema).coalesce(1)).collect()) for order in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert got == {((0.3, 1),)}


def test_parity_of_later_sessions_is_that_of_its_sql(spark, tmp_path):
    """The one rate is good for a week; sessions after it assume none."""
    path = str(tmp_path / "lineitem.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.unionAll(lines.withColumn("l_orderkey", F.col("l_orderkey") + 60_000)).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"create view lineitem as select * from '{path}/*.parquet'")
    want = con.sql(catalogue.ORACLES["parity_spot"])
    names = want.columns
    show = lambda v: repr(round(v, 5)) if isinstance(v, float) else str(v)
    got = catalogue.QUERIES["parity_spot"](spark, str(tmp_path)).collect()
    assert {r.rate_assumed for r in got} == {True, False}
    assert sorted(tuple(show(r[n]) for n in names) for r in got) == sorted(tuple(map(show, r)) for r in want.fetchall())
