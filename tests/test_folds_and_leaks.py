"""Folds against plain state machines; and later rows never change earlier answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import alerts as A
from tickloom.operators import bars as B
from tickloom.operators import ema as E
from tickloom.operators import levels as L
from tickloom.operators import network as N
from tickloom.operators import premium as M
from tickloom.plans import catalogue
from tickloom.plans import fixtures as X
from tickloom.sources import archive
from tickloom.streaming import live

SF = "/root/testdata/sf0.001"
DAY = dt.date(2026, 9, 30)


def test_reversal_fold_step_and_stream_agree(spark):
    random.seed(5)
    codes = [*A.CODES, "INSIDE-RISE", None, None, None]
    rows, want = [], {}
    for s in range(20):
        state, cutoff = None, 570
        for k in range(80):
            cutoff = cutoff + random.choice([0, 1, 1, 1, 2]) if random.random() > 0.02 else 575
            x = (f"s{s}", k, cutoff, random.choice(codes), random.random() > 0.1, random.random() > 0.9)
            rows.append(x)
            state = live.advance(state, x[2:])
        want[f"s{s}"] = state
    df = spark.createDataFrame(rows, "scope string, seq int, cutoff int, code string, usable boolean, acknowledged boolean")
    got = {r.scope: tuple(r)[1:] for r in A.warnings(df).collect()}
    assert {k: (*v[:3], bool(v[3]), *v[4:]) for k, v in got.items()} == {k: (*v[:3], bool(v[3]), *v[4:]) for k, v in want.items()}


def test_reversal_stream_equals_batch(spark):
    a, b = (catalogue.QUERIES[n](spark, SF) for n in ("reversal_fold", "stream_reversal"))
    cols = sorted(a.columns)
    assert sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect()))


def test_review_and_five_clear_minutes_rearm():
    s = live.advance(None, (600, "EXT-UP-COOLING", True, False))
    for m in range(601, 606):
        s = live.advance(s, (m, None, True, m == 601))
    assert s[4] == 5 and s[3]
    assert live.advance(s, (606, "EXT-UP-COOLING", True, False))[2] == 606
    s = live.advance(s[:4] + (4, 605, 1), (606, "EXT-UP-COOLING", True, False))
    assert s[2] == 600


CASES = {
    "vwap": lambda s, b: B.vwap(b),
    "strict": lambda s, b: B.strict_vwap(b),
    "rvol": lambda s, b: B.relative_volume(b),
    "confirm": lambda s, b: B.confirmations(B.vwap(b)),
    "returns": lambda s, b: B.returns(b),
    "volatility": lambda s, b: B.volatility(b),
    "nodes": lambda s, b: N.node_states(b),
    "correlation": lambda s, b: N.pair_correlations(N.node_states(b)),
    "day type": lambda s, b: L.day_types(b, b.select("symbol", "session_date").distinct().withColumns({"prior_high": F.lit(40000.0), "prior_low": F.lit(1000.0), "pm_high": F.lit(30000.0), "pm_low": F.lit(20000.0)})),
}


@pytest.mark.parametrize("name", CASES)
def test_later_bars_change_nothing_before(spark, name):
    b = X.bars(spark, SF, (1, 4, 90, 570)).cache()
    f, cut = CASES[name], 620
    early = f(spark, b.where(F.col("minute") <= cut))
    late = f(spark, b.withColumn("close", F.when(F.col("minute") > cut, F.col("high")).otherwise(F.col("close")))).where(F.col("minute") <= cut)
    assert sorted(map(repr, early.select(sorted(early.columns)).collect())) == sorted(map(repr, late.select(sorted(early.columns)).collect()))


def test_later_quotes_change_no_earlier_premium(spark):
    q = X.quotes(spark, SF, (1, 3, 90, 570)).cache()
    run = lambda x: M.postures(M.premium_series(x))
    a, b = run(q.where("minute <= 630")), run(q).where("minute <= 630")
    assert sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(a.columns)).collect()))


def test_point_in_time_nulls_later_facts(spark):
    t = lambda m: dt.datetime(2026, 9, 30, 14, m)
    rows = [(1, t(0), t(0), t(1), 5.0, "quote", "1m"), (2, t(0), t(0), t(5), 5.0, "quote", "1m"), (3, t(0), t(9), t(0), 5.0, "quote", "1m"), (4, t(2), t(2), t(2), 5.0, "bar-open", "1m"), (5, t(3), t(3), t(3), 5.0, "bar-open", "1m"), (6, t(0), t(0), t(0), 5.0, "session-date", "1d")]
    df = spark.createDataFrame(rows, "id int, ts timestamp, first_seen_ts timestamp, greeks_ts timestamp, gamma double, ts_kind string, interval string")
    got = {r.id: r.gamma for r in archive.known_at(df, F.lit(t(3))).collect()}
    assert got == {1: 5.0, 2: None, 4: 5.0}


def test_quarantine_and_providers(spark):
    rows = [("A", DAY, 570, "on", "p"), ("A", DAY, 571, "on", "p"), ("A", DAY, 571, "off", "p"), ("A", DAY, 572, "none", "p"), ("B", DAY, 570, "on", "p"), ("B", DAY, 571, "on", "q")]
    df = spark.createDataFrame(rows, "symbol string, session_date date, minute int, grid_status string, provider string")
    kept, mixed = N.without_mixed_providers(N.quarantine_off_grid(df))
    assert [(r.symbol, r.minute) for r in kept.collect()] == [("A", 570)] and [r.symbol for r in mixed.collect()] == ["B"]


def test_empty_tables(spark):
    b = X.bars(spark, SF).where("false")
    for f in CASES.values():
        assert f(spark, b).count() == 0
    assert E.ema_episodes(E.fold(E.calendar_buckets(b))).count() == 0 and E.clock(b, E.fold(E.calendar_buckets(b))).count() == 0
