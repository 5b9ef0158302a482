"""Small tables with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns as C
from tickloom.functions import options_math as O
from tickloom.operators import bars as B
from tickloom.operators import chain as H
from tickloom.operators import evaluate as V
from tickloom.operators import forecast as R
from tickloom.operators import impute as I
from tickloom.operators import levels as L
from tickloom.operators import network as N
from tickloom.operators import premium as M

DAY = dt.date(2026, 9, 30)


def bars(spark, closes, start=570, symbol="A", day=DAY, volume=100.0, width=0.0):
    vol = volume if isinstance(volume, list) else [volume] * len(closes)
    rows = [(symbol, day, start + i, c, c + width, c - width, c, v) for i, (c, v) in enumerate(zip(closes, vol, strict=True)) if c is not None]
    return spark.createDataFrame(rows, "symbol string, session_date date, minute int, open double, high double, low double, close double, volume double")


def quotes(spark, mids, minutes=None):
    rows = [("A", DAY, (minutes or range(570, 999))[i], m - 0.05, m + 0.05, 6100.0, "CALL", 6000.0, 0, 0.2, 0.01) for i, m in enumerate(mids)]
    return spark.createDataFrame(rows, "symbol string, session_date date, minute int, bid double, ask double, strike double, `right` string, underlying double, lag_seconds int, iv double, iv_error double")


def test_premium_z_and_slope(spark):
    p = M.premium_series(quotes(spark, [1.0, 2.0, 3.0, 4.0, 5.0])).orderBy("minute").collect()[-1]
    assert p.z == pytest.approx(math.sqrt(2)) and p.slope == pytest.approx(1) and p.baseline_bars == 5
    flat = M.premium_series(quotes(spark, [2.0] * 6)).orderBy("minute").collect()[-1]
    assert flat.z is None and flat.slope == pytest.approx(0)
    gap = M.premium_series(quotes(spark, [1.0, 2.0, 3.0, 4.0, 5.0], [570, 571, 572, 573, 575])).orderBy("minute").collect()[-1]
    assert gap.baseline_bars == 1 and gap.z is None


def test_relative_volume_excludes_the_current_bar(spark):
    got = B.relative_volume(bars(spark, [1.0] * 5, volume=[10.0, 20.0, 30.0, 40.0, 100.0])).orderBy("minute").collect()
    assert [r.rvol for r in got] == [None] * 4 + [4.0]


def test_regime_priority_and_equality(spark):
    cases = [(10.0, 5.0, 10.0, 5.0, "INSIDE"), (10.0, 5.0, 12.0, 11.0, "GAP-UP"), (10.0, 5.0, 4.0, 3.0, "GAP-DOWN"), (10.0, 5.0, 11.0, 4.0, "TWO-SIDED"), (10.0, 5.0, 11.0, 6.0, "EXT-UP"), (10.0, 5.0, 9.0, 4.0, "EXT-DOWN"), (5.0, 5.0, 6.0, 4.0, None), (None, 5.0, 6.0, 4.0, None), (10.0, 5.0, 4.0, 6.0, None)]
    df = spark.createDataFrame(cases, "h double, l double, ph double, pl double, want string")
    for r in df.withColumn("got", L.regime(F.col("h"), F.col("l"), F.col("ph"), F.col("pl"))).collect():
        assert r.got == r.want


def test_parity(spark):
    q = [(DAY, 6000.0, 36000, 34200, 57600, 36000, "CALL", 12.9, 13.1), (DAY, 6000.0, 36000, 34200, 57600, 36000, "PUT", 11.9, 12.1)]
    schema = "session_date date, strike double, cutoff int, open_second int, close_second int, second int, `right` string, bid double, ask double"
    prints = spark.createDataFrame([(DAY, 36000, 6001.1)], "session_date date, second int, price double")
    none = spark.createDataFrame([], "created date, rate double")
    r = H.parity(spark.createDataFrame(q, schema), prints, none).first()
    assert (r.spot, r.low, r.high) == (pytest.approx(6001), pytest.approx(6000.8), pytest.approx(6001.2)) and r.rate_assumed and r.comparison == "inside"
    for days, assumed in ((1, False), (7, False), (0, True), (8, True)):
        rate = spark.createDataFrame([(DAY - dt.timedelta(days), 3.6)], "created date, rate double")
        assert H.parity(spark.createDataFrame(q, schema), prints, rate).first().rate_assumed is assumed
    rate = spark.createDataFrame([(DAY - dt.timedelta(1), 3.6)], "created date, rate double")
    r = H.parity(spark.createDataFrame(q, schema), prints, rate).first()
    d = 1 / (1 + 0.036 * 360 / (1440 * 360))
    assert r.spot == pytest.approx(1 + 6000 * d) and r.forward == pytest.approx(6000 + 1 / d)
    assert H.parity(spark.createDataFrame(q + q[:1], schema), prints, none).first().status == "unpaired"
    late = [(*x[:2], 36121, *x[3:]) for x in q]
    assert H.parity(spark.createDataFrame(late, schema), prints, none).first().status == "stale"


def test_gamma_exposure(spark):
    t, late = dt.datetime(2026, 9, 30, 14), dt.datetime(2026, 9, 30, 20)
    schema = "strike double, `right` string, gamma double, open_interest double, ts timestamp, oi_ts timestamp, spot double, cutoff timestamp"
    legs = [(6000.0, "CALL", 0.001, 1000.0, t, t, 6000.0, t), (6000.0, "PUT", 0.001, 600.0, t, t, 6000.0, t)]
    r = H.gamma_exposure(spark.createDataFrame(legs, schema)).first()
    assert (r.call_gamma, r.put_gamma, r.net_gamma) == (pytest.approx(36e6), pytest.approx(-21.6e6), pytest.approx(14.4e6))
    r = H.gamma_exposure(spark.createDataFrame([(*x[:5], late, *x[6:]) for x in legs], schema)).first()
    assert r.rejected == 2 and r.used == 0


def test_payoff(spark):
    legs = spark.createDataFrame([("s", "CALL", 6000.0, 3.0, -1), ("s", "CALL", 6010.0, 1.3, 1)], "strategy_id string, `right` string, strike double, premium double, quantity int")
    p = [r.profit for r in H.payoff(legs, 5950.0, 6050.0).collect()]
    assert len(p) == 81 and max(p) == pytest.approx(170) and min(p) == pytest.approx(-830)


def test_ladder_takes_lower_strike_on_ties_and_needs_both_legs(spark):
    legs = [("d", 5900.0 + 5 * i, r, 1.0, True, 6000.0, True) for i in range(40) for r in ("CALL", "PUT") if not (i == 20 and r == "PUT")]
    got = H.ladder(spark.createDataFrame(legs, "d string, strike double, `right` string, value double, usable boolean, spot double, spot_fresh boolean"), "d").orderBy("strike").collect()
    assert len(got) == 21 and got[0].strike == 5950.0 and got[-1].strike == 6050.0
    assert [r.net for r in got if r.strike == 6000.0] == [None]


def test_daylight_saving_edges_are_null(spark):
    df = spark.createDataFrame([("2026-03-08 02:30:00",), ("2026-11-01 01:30:00",), ("2026-09-30 09:30:00",), ("2026-09-30T09:30:00-04:00",), ("junk",), (None,)], "w string")
    got = [r[0] for r in df.select(F.date_format(C.eastern_to_utc(F.col("w")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == [None, None, "2026-09-30 13:30", "2026-09-30 13:30", None, None]


def test_brier_and_baseline(spark):
    o = spark.createDataFrame([(0.6, y) for y in (1, 1, 1, 0, 0)] + [(1.4, 1), (None, 0)], "p double, y int")
    r = V.brier(o).first()
    assert (r.brier, r.baseline, r.n, r.invalid) == (pytest.approx(0.24), pytest.approx(0.25), 5, 2)


def test_first_loss_is_drawdown(spark):
    d = spark.createDataFrame([("b", 1, -100), ("b", 2, 50), ("b", 3, -20), ("c", 1, 10)], "book string, day int, cents long")
    assert {r.book: r.drawdown_cents for r in V.max_drawdown(d, "book").collect()} == {"b": 100, "c": 0}


def test_logistic_score(spark):
    df = spark.sql("select map('a', 1.5D, 'b', 1.0D) features, array('a', 'b') feature_order, array(0D, 0D) mean, array(1D, 1D) scale, array(-0.2D, 0.4D, -0.1D) beta")
    r = R.scored(df).first()
    assert r.log_odds == pytest.approx(0.3) and r.p_up == pytest.approx(0.5744425168) and r.direction == "bullish"
    assert [x.feature for x in r.contributions] == ["a", "b"]
    labels = spark.createDataFrame([(0.45,), (0.55,), (0.56,), (0.44,), (None,)], "p double").select(C.sign_label(F.col("p"))).collect()
    assert [x[0] for x in labels] == ["neutral", "neutral", "bullish", "bearish", None]
    missing = spark.sql("select map('a', 1.5D) features, array('a', 'b') feature_order, array(0D, 0D) mean, array(1D, 1D) scale, array(-0.2D, 0.4D, -0.1D) beta")
    assert R.scored(missing).first().p_up is None


def test_models_must_be_unique_and_prior(spark):
    cols = "model_id string, horizon int, valid_from date, valid_to date, train_end date, training_rows int, training_days int, converged boolean, feature_order array<string>, mean array<double>, scale array<double>, beta array<double>"
    m = lambda i, **k: tuple({"model_id": i, "horizon": 30, "valid_from": dt.date(2026, 9, 1), "valid_to": dt.date(2026, 9, 30), "train_end": dt.date(2026, 8, 31), "training_rows": 350, "training_days": 80, "converged": True, "feature_order": ["a"], "mean": [0.0], "scale": [1.0], "beta": [0.0, 1.0]} | k) and tuple(({"model_id": i, "horizon": 30, "valid_from": dt.date(2026, 9, 1), "valid_to": dt.date(2026, 9, 30), "train_end": dt.date(2026, 8, 31), "training_rows": 350, "training_days": 80, "converged": True, "feature_order": ["a"], "mean": [0.0], "scale": [1.0], "beta": [0.0, 1.0]} | k).values())
    rows = spark.createDataFrame([(DAY,)], "session_date date")
    good = spark.createDataFrame([m("x")], cols)
    assert R.valid_on(rows, R.usable_models(good)).count() == 1
    assert R.valid_on(rows, R.usable_models(spark.createDataFrame([m("x"), m("y")], cols))).count() == 0
    for bad in ({"train_end": dt.date(2026, 9, 1)}, {"training_rows": 349}, {"training_days": 79}, {"converged": False}, {"scale": [0.0]}):
        assert R.usable_models(spark.createDataFrame([m("x", **bad)], cols)).count() == 0


def test_rates_node_needs_exact_minutes(spark):
    closes = [42.0] + [None] * 59 + [42.1] + [None] * 4 + [42.3]
    r = N.rates_node(bars(spark, closes, symbol="TNX", volume=0.0)).where("minute = 635").first()
    assert (r.yield_percent, r.change_5_bps, r.change_open_bps) == (pytest.approx(4.23), pytest.approx(2), pytest.approx(3))


def test_strict_prefix_breaks_on_gap_duplicate_and_bad_bar(spark):
    whole = bars(spark, [10.0, 11.0, 12.0, 13.0])
    ok = {r.minute: r.strict_vwap for r in B.strict_vwap(whole).collect()}
    assert ok[573] == pytest.approx(11.5)
    gap = {r.minute: r.strict_vwap for r in B.strict_vwap(bars(spark, [10.0, None, 12.0])).collect()}
    assert gap[570] is not None and gap[572] is None
    twice = {r.minute: r.strict_vwap for r in B.strict_vwap(whole.unionByName(whole.where("minute = 571"))).collect()}
    assert twice[570] is not None and twice[571] is None and twice[573] is None
    loose = {r.minute: r.vwap for r in B.vwap(bars(spark, [10.0, None, 12.0])).collect()}
    assert loose[572] == pytest.approx(11)


def test_conditional_estimate(spark):
    v = spark.createDataFrame([("v", [0.0, 0.0], [1.0, 1.0], [[1.0, 0.6], [0.6, 1.0]])], "version_id string, mean array<double>, scale array<double>, cov array<array<double>>")
    x = spark.createDataFrame([("a", "v", [1.0, None]), ("b", "v", [7.0, None]), ("c", "v", [1.0, 2.0])], "row_id string, version_id string, x array<double>")
    got = {r.row_id: r for r in I.conditioned(x, v).collect()}
    assert got["a"].estimates == [pytest.approx(0.6)] and got["a"].variances == [pytest.approx(0.64)] and got["a"].explained == [pytest.approx(0.36)] and got["a"].factor[0][0] == pytest.approx(0.8)
    assert got["b"].estimates is None and got["b"].reason == "observed beyond guard" and got["c"].estimates is None
    draws = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "draw_id int, z array<double>")
    assert sorted(r["values"][0] for r in I.drawn(I.conditioned(x, v), draws).collect()) == [pytest.approx(0.6), pytest.approx(1.4)]


def test_components_are_transitive_and_keep_single_nodes(spark):
    nodes = spark.createDataFrame([(1, n) for n in "abcdefghijk"] + [(2, "a"), (2, "b")], "k int, node string")
    chain = spark.createDataFrame([(1, x, y) for x, y in zip("abcdefghij", "bcdefghijk", strict=True) if x != "e"], "k int, a string, b string")
    got = {(r.k, r.node): r.label for r in N.components(nodes, chain, ["k"]).collect()}
    assert got[1, "e"] == "a" and got[1, "k"] == "f" and got[2, "a"] == "a" and got[2, "b"] == "b"


def test_correlation_default_threshold(spark):
    import random

    random.seed(4)
    up = [100.0]
    for _ in range(70):
        up.append(up[-1] * (1 + random.uniform(-0.01, 0.01)))
    other = [100 + random.uniform(-1, 1) for _ in up]
    b = bars(spark, up, symbol="A").unionByName(bars(spark, [x * 2 for x in up], symbol="B")).unionByName(bars(spark, other, symbol="C"))
    pairs = N.pair_correlations(N.node_states(b))
    got = {(r.a, r.b): r["corr"] for r in pairs.where("minute = 640").collect()}
    assert got["A", "B"] == pytest.approx(1) and abs(got["A", "C"]) < 0.6
    assert pairs.where("minute = 629").where("corr is not null").count() == 0 and pairs.where("minute = 630 and corr is not null").count() == 3
    assert [(r.a, r.b) for r in N.links(pairs).where("minute = 640").collect()] == [("A", "B")]


def test_black_scholes_rejects_bad_input(spark):
    df = spark.createDataFrame([(100.0, 100.0, 1.0, 0.2, 0.04, "CALL"), (0.0, 100.0, 1.0, 0.2, 0.04, "CALL"), (100.0, 100.0, 1.0, 0.2, 0.04, "X"), (100.0, None, 1.0, 0.2, 0.04, "PUT")], "s double, k double, t double, v double, r double, c string")
    got = [x[0] for x in df.select(O.black_scholes(*[F.col(c) for c in "sktvrc"])).collect()]
    assert got[0].price == pytest.approx(9.925, abs=1e-3) and got[1:] == [None, None, None]


def test_ten_minute_bucket_needs_all_minutes(spark):
    got = B.ten_minute(bars(spark, [1.0] * 10 + [1.0] * 9)).orderBy("bucket").collect()
    assert [r.complete for r in got] == [True, False]


def test_band_is_the_interpolated_quantiles(spark):
    from tickloom.operators import impute

    rows = [("a", 0.1 * k) for k in range(11)] + [("b", 0.5)]
    got = {r.k: (r.low, r.high) for r in impute.band(spark.createDataFrame(rows, "k string, p double"), "k").collect()}
    assert got["a"] == pytest.approx((0.1, 0.9)) and got["b"] == (0.5, 0.5)
    draws = spark.range(1025).selectExpr("id draw_id", "array(0d) z")
    with pytest.raises(ValueError):
        impute.drawn(spark.createDataFrame([], "row_id string, version_id string, missing array<int>, estimates array<double>, factor array<array<double>>"), draws)


def test_greeks_are_the_slopes_of_the_price(spark):
    from tickloom.plans import catalogue

    rows = catalogue.QUERIES["greek_audit"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 100 and all(abs(r.delta_gap) < 0.01 and abs(r.gamma_gap) < 0.01 and abs(r.vega_gap) < 0.05 for r in rows)


def test_context_states_in_order(spark):
    from pyspark.sql import functions as F

    from tickloom.operators import news

    t = dt.datetime(2026, 11, 2, 15, 0)
    ago = lambda m: t - dt.timedelta(minutes=m)
    schema = "article_id string, title string, url string, source_id string, published_at timestamp, received_at timestamp, first_observed_at timestamp, assessed_at timestamp"
    arts = lambda *titles: spark.createDataFrame([(f"a{k}", x, f"u{k}", "s", ago(60), ago(50), ago(40), ago(30)) for k, x in enumerate(titles)], schema)
    health = lambda status="ok": spark.createDataFrame([("s", status, ago(1), ago(1), 300000)], "source_id string, status string, checked_at timestamp, last_success_at timestamp, max_age_ms int")
    lit = F.lit(t).cast("timestamp")
    run = lambda a, h=None, **k: (lambda r: (r.status, r.classification, r.relevant))(news.context(spark, a, h or health(), lit, **k).first())
    minutes = lambda m: lit - F.make_dt_interval(mins=F.lit(m))
    both = arts("Nvidia raises full-year revenue guidance", "Oil prices rise")
    assert run(both, observed=minutes(1)) == ("available", "MIXED", 1)
    assert run(arts("Apple unveils a chip", "Rain in the north"), observed=minutes(1)) == ("available", "UNCERTAIN", 1)
    assert run(arts("Rain in the north"), observed=minutes(1))[:2] == ("no_evidence", "UNAVAILABLE")
    assert run(both, observed=minutes(6))[0] == "stale" and run(both, observed=minutes(1), provider_as_of=minutes(9))[0] == "stale"
    assert run(both, observed=minutes(-1))[0] == "unavailable" and run(both, health("error"), observed=minutes(1))[:2] == ("unavailable", "UNAVAILABLE")
    assert run(both, observed=minutes(1), provider_status=F.lit("stale"))[0] == "stale" and run(both, observed=minutes(1), provider_status=F.lit("down"))[0] == "unavailable"


def test_industry_cues_need_a_relevant_headline(spark):
    from tickloom.operators import news

    titles = [("a", "GPU demand surges"), ("b", "AI boom: GPU demand surges"), ("c", "Nvidia waits; GPU demand surges"), ("d", "Chipmakers say GPU demand weakens"), ("e", None), ("f", "")]
    got = {(r.article_id, r.rule, r.sector) for r in news.company_cues(spark, spark.createDataFrame(titles, "article_id string, title string")).collect()}
    assert got == {("b", "industry-ai-chip-demand-strength", "XLK"), ("c", "industry-ai-chip-demand-strength", "XLK"), ("d", "industry-ai-chip-demand-weakness", "XLK")}


def test_paths_hold_what_lies_beyond_a_held_node(spark):
    from tickloom.operators import news

    routes = spark.createDataFrame([("a", "r", "USO", 1), ("a", "s", "TNX", 1)], "article_id string, rule string, target string, expected int")
    links = spark.createDataFrame([("XLE", "USO", 0.5, 0.5), ("USO", "XLI", -0.5, 0.5), ("USO", "XLB", 0.5, 0.4), ("TNX", "XLF", 0.5, 0.5)], "source string, target string, rho double, strength double")
    nodes = spark.createDataFrame([("USO", 1, True), ("XLE", -1, True), ("XLI", -1, True), ("TNX", 1, False), ("XLF", 1, True)], "node string, sign int, eligible boolean")
    got = {",".join(r.path): (r.expected, r.observed, r.state) for r in news.news_paths(routes, links, nodes).collect()}
    assert got == {"NEWS,USO": (1, 1, "agrees"), "NEWS,USO,XLE": (1, -1, "conflicts"), "NEWS,USO,XLI": (-1, -1, "agrees"), "NEWS,TNX": (1, None, "unavailable"), "NEWS,TNX,XLF": (1, None, "unavailable")}
    assert {r.state for r in news.news_paths(routes, links, nodes, prices_held=True).collect()} == {"unavailable"}
