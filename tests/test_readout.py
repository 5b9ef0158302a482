"""Readout, session assembly and interaction forecast on small tapes with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import chain, forecast, network, news, readout, session

DAYS = [dt.date(2026, 1, 5), dt.date(2026, 1, 6)]
BAR = "symbol string, session_date date, minute int, open double, high double, low double, close double, volume double"
QUOTE = "symbol string, session_date date, minute int, bid double, ask double, strike double, right string, underlying double, lag_seconds int, iv double, iv_error double"


def tape(spark, scale, first=540, last=600, skip=()):
    rows = []
    for d in DAYS:
        for m in range(first, last):
            if m not in skip:
                p = scale * (100 + 5 * math.sin(m * 0.7 + d.day))
                rows.append(("S", d, m, p, p + scale, p - scale, p + scale * 0.5 * math.cos(m), 100.0 + m % 7))
    return spark.createDataFrame(rows, BAR)


def quotes(spark, last=600):
    rows = [("S", d, m, 9.0 + math.sin(m * 0.3), 9.2 + math.sin(m * 0.3), 100.0, "CALL", 101.0, 0, 0.2, 0.0) for d in DAYS for m in range(570, last)]
    return spark.createDataFrame(rows, QUOTE)


def taken(df):
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def test_later_rows_change_no_earlier_minute(spark):
    cut = 585
    whole = readout.minute_readout(tape(spark, 10.0), tape(spark, 1.0), quotes(spark))
    last = DAYS[1]
    upto = lambda t: t.where((F.col("session_date") < F.lit(last)) | (F.col("minute") <= cut))
    cutoff = readout.minute_readout(upto(tape(spark, 10.0)), upto(tape(spark, 1.0)), upto(quotes(spark)))
    here = (F.col("session_date") == F.lit(last)) & (F.col("minute") <= cut)
    assert taken(whole.where(here)) == taken(cutoff.where(here))


def test_readout_of_gaps_and_missing_parts(spark):
    rows = readout.minute_readout(tape(spark, 10.0, skip=range(575, 580)), tape(spark, 1.0), quotes(spark)).where("session_date = date '2026-01-06'")
    got = {r["minute"]: r for r in rows.collect()}
    assert len(got) == 390
    assert got[574]["price"] == got[577]["price"] != got[580]["price"]
    assert [got[m]["stale"] for m in (574, 576, 577, 580, 601, 602)] == [False, False, True, False, False, True]
    assert got[580]["anchor"] == pytest.approx(10 * (100 + 5 * math.sin(570 * 0.7 + 6)))
    assert got[580]["ratio"] == pytest.approx(10) and got[580]["regime"] is not None
    none = readout.minute_readout(tape(spark, 10.0), tape(spark, 1.0), quotes(spark).where("false"))
    assert none.count() == 780 and none.where("not stale or code is not null or passed or z is not null").count() == 0
    assert readout.minute_readout(*[t.where("false") for t in (tape(spark, 1.0), tape(spark, 1.0), quotes(spark))]).count() == 0


def test_edge_states(spark):
    links = spark.createDataFrame([("U", "A", "macro-sector", -0.6, 0.6), ("U", "C", "macro-sector", 0.3, 0.3), ("A", "B", "sector-sector", 0.5, 0.5)], "source string, target string, kind string, rho double, strength double")
    nodes = spark.createDataFrame([(1, "U", 1), (1, "A", -1), (1, "B", 0), (2, "U", 1), (2, "A", -1), (2, "B", 0)], "minute int, node string, sign int")
    got = {(r["minute"], r["source"], r["target"]): r for r in network.edge_states(links, nodes, ["minute"], F.col("minute") == 1).collect()}
    assert len(got) == 6
    r = got[1, "U", "A"]
    assert r["active"] and r["alignment"] == pytest.approx(0.2) and r["pressure"] == pytest.approx(-0.2)
    assert not got[1, "A", "B"]["active"] and got[1, "A", "B"]["alignment"] == 0 and got[1, "A", "B"]["pressure"] is None
    assert not got[1, "U", "C"]["active"] and got[1, "U", "C"]["alignment"] is None
    assert all(not r["active"] and r["alignment"] is None for (m, *_), r in got.items() if m == 2)


def test_interaction_scores_and_their_reasons(spark):
    day = DAYS[0]
    some = {f: 1.0 for f in forecast.FEATURES_39}
    vectors = spark.createDataFrame([(day, 640, some), (day, 641, {k: v for k, v in some.items() if k != "XLK_vwap_gap"}), (day, 650, some), (day, 940, some)], "session_date date, minute int, features map<string,double>")

    def fit(family, horizon, names, b):
        return ("m", family, horizon, dt.date(2026, 1, 1), dt.date(2026, 1, 31), dt.date(2025, 12, 31), 400, 90, True, list(names), [0.0] * len(names), [1.0] * len(names), [0.5, *[b] * len(names)])

    schema = "model_id string, family string, horizon int, valid_from date, valid_to date, train_end date, training_rows int, training_days int, converged boolean, feature_order array<string>, mean array<double>, scale array<double>, beta array<double>"
    models = spark.createDataFrame([fit("interaction", 30, forecast.FEATURES_39, 0.01), fit("additive", 30, forecast.FEATURES_35, -0.01), fit("interaction", 60, forecast.FEATURES_39, 0.01)], schema)
    rows = forecast.interaction_scores(vectors, models, F.col("minute") != 650, F.lit(960)).cache()
    got = {(r["minute"], r["horizon"]): r for r in rows.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {(640, 30): None, (640, 60): "no additive model", (641, 30): "incomplete", (641, 60): "incomplete", (650, 30): "stale", (650, 60): "stale", (940, 30): "beyond the close", (940, 60): "beyond the close"}
    r = got[640, 30]
    assert r["log_odds"] == pytest.approx(0.89) and r["interaction_log_odds"] == pytest.approx(0.04)
    assert r["additive_p_up"] == pytest.approx(1 / (1 + math.exp(-0.15)))
    assert all(v["log_odds"] is None and v["contributions"] is None and v["additive_p_up"] is None for k, v in got.items() if k != (640, 30))
    nodes = {r["node"]: r["log_odds"] for r in forecast.node_contributions(rows, ["minute", "horizon"]).collect()}
    assert len(nodes) == 13 and all(v == pytest.approx(0.02) for v in nodes.values())


def test_structural_faults_of_articles(spark):
    at, good = dt.datetime(2026, 1, 5), "news-" + "a" * 64
    base = dict(article_id=good, title="Rates unchanged", summary="", url="https://n.example.com/a", source_id="s", published_at=at, received_at=at, first_observed_at=at, assessed_at=at)
    wrong = [{}, {"article_id": "news-A"}, {"title": ""}, {"title": "x" * 601}, {"title": "a <b>"}, {"url": "http://n.example.com/a"}, {"source_id": None}, {"received_at": None}, {"summary": "x" * 1601}, {"summary": "a\x07"}, {"summary": None}]
    schema = "n int, article_id string, title string, summary string, url string, source_id string, published_at timestamp, received_at timestamp, first_observed_at timestamp, assessed_at timestamp"
    rows = spark.createDataFrame([(i, *{**base, **w}.values()) for i, w in enumerate(wrong)], schema)
    got = news.snapshot_problems(rows, F.array(F.lit("n.example.com")), F.col("source_id") == "s").orderBy("n").collect()
    assert [r["problem"] for r in got] == [None, "id", "title", "title", "title markup", "url", "source", "received_at", "summary", "summary markup", "summary"]


def test_session_parts(spark):
    bars = tape(spark, 1.0, first=570, last=573).withColumn("symbol", F.explode(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")))).withColumn("provider", F.when((F.col("symbol") == "Z") & (F.col("minute") == 571), "B").otherwise("A"))
    t = lambda s: dt.datetime(2026, 1, 6, 15, 0, s)
    schema = "session_date date, root string, expiration date, strike double, right string, bid double, ask double, ts timestamp, oi_ts timestamp, open_interest double, spot double"
    d = DAYS[1]
    options = spark.createDataFrame([(d, "R", d, 100.0, "CALL", 1.0, 1.1, t(0), t(0), 5.0, 101.0), (d, "R", d, 105.0, "CALL", 1.0, 1.1, t(0), t(0), 5.0, 101.0), (d, "R", d, 100.0, "CALL", 1.0, 1.1, t(30), t(50), 6.0, 109.0), (d, "R", d, 100.0, "PUT", 1.0, 0.9, t(20), t(0), 5.0, 101.0), (d, "R", d, 105.0, "CALL", 1.0, 1.1, t(59), t(0), 5.0, 101.0)], schema)
    p = session.parts(bars, options, F.lit(t(40)), "X", "Y", seconds=20)
    got = {r["session_date"]: r.asDict() for r in session.summary(p).collect()}
    r = got[d]
    assert (r["index_bars"], r["fund_bars"], r["context_bars"], r["mixed_symbols"], r["intraday"], r["previous_date"]) == (3, 3, 0, 1, True, DAYS[0])
    assert (r["strike"], r["quotes"], r["observed"], r["coherent"], r["excluded"], r["interest_known"]) == (100.0, 2, 2, 1, 1, 0)
    assert got[DAYS[0]]["observed"] == 0 and got[DAYS[0]]["strike"] is None and got[DAYS[0]]["previous_date"] is None


def marks_and_quotes(spark):
    """Quotes of two strikes: pairs, lone calls, doubled puts, wide and crossed ones, outside the session too."""
    kinds = [("CALL", "PUT"), ("CALL",), ("CALL", "PUT", "PUT"), ("PUT", "CALL"), ("PUT", "CALL")]
    rows = []
    for d in DAYS:
        for k in (6000.0, 6010.0):
            for i, s in enumerate(range(34000, 36000, 50)):
                for r in kinds[(i + int(k)) % 5]:
                    wide = 9.0 if i % 7 == 0 else 0.1
                    rows.append((d, k, s, r, 12.9 if r == "CALL" else 11.9, (12.9 if r == "CALL" else 11.9) + wide, 34200, 57600))
    q = spark.createDataFrame(rows, "session_date date, strike double, second long, right string, bid double, ask double, open_second int, close_second int")
    prints = spark.createDataFrame([(DAYS[0], s, 6001.0) for s in range(34000, 36000, 100)] + [(DAYS[0], 35000, 1.0)], "session_date date, second long, price double")
    rates = spark.createDataFrame([(DAYS[0] - dt.timedelta(days=1), 3.6), (DAYS[0], 90.0)], "created date, rate double")
    return q, prints, rates


def test_marks_answer_for_every_cutoff(spark):
    q, prints, rates = marks_and_quotes(spark)
    cutoffs = list(range(34100, 36400, 130))
    whole = chain.parity(q.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))), prints, rates)
    want = {(r["session_date"], r["strike"], r["cutoff"]): r.asDict() for r in whole.collect()}
    marks = sorted(chain.parity_marks(q, prints, rates).collect(), key=lambda r: r["second"])
    assert {r["status"] for r in marks} == {"ok", "unpaired", "invalid quote"} and all(34200 <= r["second"] < 57600 for r in marks)
    n = 0
    for d in DAYS:
        for k in (6000.0, 6010.0):
            for c in cutoffs:
                last = [r for r in marks if (r["session_date"], r["strike"]) == (d, k) and r["second"] <= c]
                got = want.get((d, k, c))
                assert (got is None) == (not last)
                if last:
                    stale = c - last[-1]["second"] > 120
                    assert got["status"] == ("stale" if stale else last[-1]["status"]) and got["second"] == last[-1]["second"]
                    assert got["spot"] == (None if stale else last[-1]["spot"]) and got["comparison"] == ("unavailable" if stale else last[-1]["comparison"])
                    n += stale
    assert n


def test_analysis_knows_nothing_of_later_rows(spark):
    q, prints, rates = marks_and_quotes(spark)
    strikes = spark.createDataFrame([("S", d, 6000.0) for d in DAYS], "symbol string, session_date date, strike double")
    net = spark.createDataFrame([(DAYS[0], m, f"n{m}") for m in range(575, 590, 5)], "session_date date, minute int, status string")
    fc = spark.createDataFrame([(DAYS[0], m, m / 1000) for m in range(571, 600)], "session_date date, minute int, p_up double")

    def rows(cut=10**6):
        upto = lambda t: t.where(F.col("minute") <= cut)
        marks = chain.parity_marks(q.where(F.col("second") <= cut * 60), prints, rates)
        return readout.analysis(upto(tape(spark, 10.0)), upto(tape(spark, 1.0)), upto(quotes(spark).withColumn("close", 100 + F.col("minute") % 7)), marks, strikes, upto(net), upto(fc))

    whole = rows()
    got = {r["minute"]: r for r in whole.where(F.col("session_date") == F.lit(DAYS[0])).collect()}
    assert len(got) == 390 and whole.count() == 780
    assert got[574]["network"] is None and got[579]["network"]["status"] == "n575" and got[700]["network"]["as_of"] == 585
    assert got[570]["forecast"] is None and got[580]["forecast"]["p_up"] == pytest.approx(0.58)
    assert got[590]["implied_status"] in ("ok", "unpaired", "invalid quote") and got[700]["implied_status"] == "stale" and got[700]["implied_spot"] is None
    assert any(r["implied_spot"] for r in got.values())
    assert all(r["reversal"] is None and r["review"] is None for r in got.values() if r["stale"] or r["code"] is None)
    keep = ["symbol", "session_date", "minute", "price", "code", "stale", "ema", "ema_status", "implied_status", "implied_spot", "network", "forecast", "reversal", "divergences"]
    for cut in (588,):
        assert taken(whole.where(F.col("minute") <= cut).select(keep)) == taken(rows(cut).where(F.col("minute") <= cut).select(keep))
