"""EMA, retests and clock: known cases, a plain machine over minutes at every cutoff, and the stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ema as E
from tickloom.operators import levels as L
from tickloom.streaming import live

DAY = dt.date(2026, 9, 29)
BEFORE = DAY - dt.timedelta(1)
BARS = "symbol string, session_date date, minute int, open double, high double, low double, close double, volume double"
BULL = [(102, 99, 103), (101, 99.5, 103)]
BEAR = [(98, 97, 101), (99, 97, 100.5)]
WARM = [100.0] * 8 + [99.0]


def minutes(day, values, start=570):
    """Ten bars for each of values: a close, or (close, low, high)."""
    out = []
    for k, v in enumerate(values):
        c, lo, hi = v if isinstance(v, tuple) else (v, v - 0.1, v + 0.1)
        out += [(day, start + 10 * k + i, float(c), float(hi), float(lo), float(c)) for i in range(10)]
    return out


def plain(prior, today, cutoff, opened, closes):
    """What is known at a cutoff, step by step. prior, today: (minute, open, high, low, close)."""
    limit = min(cutoff, closes - 1)

    def grouped(rows, most):
        by = {}
        for r in rows:
            if opened <= r[0] <= most:
                by.setdefault(r[0], []).append(r)
        return by

    def usable(r):
        return min(r[1:]) > 0 and r[3] <= min(r[1], r[4]) and r[2] >= max(r[1], r[4])

    def bucket(by, start):
        rows = [by.get(m, []) for m in range(start, start + 10)]
        if any(len(r) != 1 or not usable(r[0]) for r in rows):
            return None
        rows = [r[0] for r in rows]
        return max(r[2] for r in rows), min(r[3] for r in rows), rows[-1][4]

    old, now = grouped(prior, 1439), grouped(today, limit)
    s = {"ema": None, "seeds": [], "prev": None, "prior": 0}

    def smooth(close):
        if s["ema"] is None:
            s["seeds"].append(close)
            if len(s["seeds"]) == 8:
                s["ema"] = sum(s["seeds"]) / 8
        else:
            s["ema"] += 2 / 9 * (close - s["ema"])

    def reset():
        s.update(ema=None, seeds=[], prev=None, prior=0)

    for start in range(opened, max(old, default=0) + 1, 10):
        b = bucket(old, start)
        if b is None:
            reset()
        else:
            smooth(b[2])
            s["prev"] = (b[2], s["ema"])
            s["prior"] += 1
    eps, missing, latest = [], False, None
    for start in range(opened, limit - 8, 10):
        b, end = bucket(now, start), start + 10
        missing = b is None
        if missing:
            reset()
            for e in eps:
                if e["status"] in ("watching", "confirmed"):
                    e.update(status="cancelled", ended=end)
            continue
        before = s["ema"]
        smooth(b[2])
        high, low, close, ema, prev = *b, s["ema"], s["prev"]
        latest = end
        if ema is not None and prev and prev[1] is not None:
            up, down = prev[0] <= prev[1] and close > ema, prev[0] >= prev[1] and close < ema
            for e in eps:
                bull = e["side"] == "bullish"
                if e["status"] == "confirmed" and (close < ema if bull else close > ema):
                    e.update(status="invalidated", ended=end)
                elif e["status"] == "watching":
                    k = (end - e["crossed"]) // 10
                    if down if bull else up:
                        e.update(status="cancelled", ended=end)
                    elif 0 < k <= 3 and low <= before <= high and (close > ema if bull else close < ema):
                        e.update(status="confirmed", retested=end, price=close, reference=before)
                    elif k >= 3:
                        e.update(status="expired", ended=end)
            side = "bullish" if up else "bearish" if down else None
            if side and not any(e["side"] == side and e["status"] in ("watching", "confirmed") for e in eps):
                eps.append({"side": side, "status": "watching", "crossed": end, "retested": None, "ended": None, "price": None, "reference": None})
        s["prev"] = (close, ema)
    if limit == closes - 1:
        for e in eps:
            if e["status"] == "watching":
                e.update(status="expired", ended=closes)
    valid = [m for m, rows in now.items() if len(rows) == 1 and usable(rows[0])]
    seen = max(valid, default=None)
    status = "premarket" if cutoff < opened else "unavailable" if seen is None else "stale" if cutoff - seen > 2 else "unavailable" if missing else "warming" if latest is None or s["ema"] is None else "ready"
    last = {side: next((e["status"] for e in reversed(eps) if e["side"] == side), "idle") for side in ("bullish", "bearish")}
    return {"status": status, "ema": s["ema"], "latest_end": latest, "warm": min(8, len(s["seeds"])), "prior_bars": s["prior"], "latest_minute": seen, **last}, [(e["side"], e["status"], e["crossed"], e["retested"], e["ended"]) for e in eps]


def tape(spark, cases):
    """{symbol: rows (day, minute, open, high, low, close)} as bars."""
    return spark.createDataFrame([(s, r[0], r[1], r[2], r[3], r[4], r[5], 0.0) for s, rows in cases.items() for r in rows], BARS)


def at(spark, bars, close=960, **more):
    b = E.calendar_buckets(bars, close_at=close)
    folded = E.fold(b).where(F.col("session_date") == F.lit(DAY))
    clock = {(r.symbol, r.minute): r for r in E.clock(bars.where(F.col("session_date") == F.lit(DAY)), folded, close_at=close, **more).collect()}
    eps: dict = {}
    for r in E.ema_episodes(folded).orderBy("symbol", "nth").collect():
        eps.setdefault(r.symbol, []).append(r)
    return clock, eps


def test_known_cases(spark):
    """One symbol a case; closes at 960 unless a case says so."""
    gap = lambda rows, *gone: [r for r in rows if not (r[0] == DAY and r[1] in gone)]
    warm = minutes(BEFORE, WARM)
    cases = {
        "seed": minutes(DAY, [100, 102, 104, 106, 108, 110, 112, 114, 116]),
        "bull": warm + minutes(DAY, BULL),
        "bear": minutes(BEFORE, [100.0] * 8 + [101.0]) + minutes(DAY, BEAR),
        "third": warm + minutes(DAY, [BULL[0], 104, 106, (105, 101, 106)]),
        "late": warm + minutes(DAY, [BULL[0], 104, 106, 108, (109, 100, 110)]),
        "opposite": warm + minutes(DAY, [BULL[0], (98, 97, 103), (99, 98, 101)]),
        "wrong": warm + minutes(DAY, [*BULL, 98]),
        "lost": gap(warm + minutes(DAY, BULL), 584),
        "twice": warm + minutes(DAY, BULL) + [minutes(DAY, BULL)[14]],
        "again": gap(warm + minutes(DAY, [BULL[0], 101, *[100] * 8]), 584),
        "no bucket": gap(warm + minutes(DAY, [BULL[0], 101, 102]), *range(580, 590)),
        "partial prior": warm[:-1] + minutes(DAY, BULL),
        "old gap": gap(warm + minutes(DAY, [*BULL, 102]), 594),
    }
    clock, eps = at(spark, tape(spark, cases))
    one = lambda s, m: clock[s, m]
    assert (one("seed", 639).status, one("seed", 639).ema, one("seed", 639).warm) == ("warming", None, 7) and (one("seed", 649).status, one("seed", 649).ema, one("seed", 649).latest_end) == ("ready", 107, 650)
    assert one("seed", 659).ema == 109 and not one("seed", 659).seeded_from_prior and "seed" not in eps
    assert (one("bull", 569).status, one("bull", 569).prior_bars, one("bull", 569).bullish, one("bull", 569).latest_end) == ("premarket", 9, "idle", None) and one("bull", 569).ema == pytest.approx(100 - 2 / 9)
    assert [one("bull", m).bullish for m in (578, 579, 588, 589)] == ["idle", "watching", "watching", "confirmed"] and one("bull", 579).seeded_from_prior
    assert [(e.crossed, e.retested, e.confirm_price) for e in eps["bull"]] == [(580, 590, 101)] and eps["bull"][0].reference == pytest.approx(one("bull", 579).ema)
    assert (one("bear", 579).bearish, one("bear", 589).bearish, one("bear", 589).bullish) == ("watching", "confirmed", "idle")
    assert (one("third", 609).bullish, eps["third"][0].retested) == ("confirmed", 610)
    assert (one("late", 599).bullish, one("late", 609).bullish, one("late", 619).bullish, eps["late"][0].ended, len(eps["late"])) == ("watching", "expired", "expired", 610, 1)
    assert [(e.side, e.status if e.side == "bullish" else one("opposite", 599).bearish, e.crossed) for e in eps["opposite"]] == [("bullish", "cancelled", 580), ("bearish", "confirmed", 590)]
    assert (eps["wrong"][0].status, eps["wrong"][0].retested, eps["wrong"][0].ended, one("wrong", 599).bearish) == ("invalidated", 590, 600, "watching")
    for s in ("lost", "twice"):
        assert (one(s, 589).status, one(s, 589).age, one(s, 589).ema, one(s, 589).bullish, one(s, 589).warm) == ("unavailable", 0, None, "cancelled", 0)
    assert (one("again", 659).status, one("again", 659).warm, one("again", 669).status, one("again", 669).ema, len(eps["again"])) == ("warming", 7, "ready", 100, 1)
    assert one("no bucket", 589).status == "stale" and (one("no bucket", 599).bullish, one("no bucket", 599).warm, one("no bucket", 599).status) == ("cancelled", 1, "warming")
    assert (one("partial prior", 589).status, one("partial prior", 589).warm, one("partial prior", 589).prior_bars) == ("warming", 2, 0)
    assert (one("old gap", 599).bullish, eps["old gap"][0].status, eps["old gap"][0].retested) == ("cancelled", "cancelled", 590)
    # the tape ends: past detections stay, status says stale
    assert (one("bull", 591).status, one("bull", 592).status, one("bull", 592).bullish) == ("ready", "stale", "confirmed")
    known = at(spark, tape(spark, {"bull": cases["bull"]}), as_of=579)[0]
    assert (known["bull", 589].status, known["bull", 589].bullish, known["bull", 589].latest_minute) == ("stale", "watching", 579)


def test_close_expires_what_is_watched(spark):
    warm = minutes(BEFORE, WARM)
    cases = {"a": warm + minutes(DAY, [BULL[0], 104]), "b": warm + minutes(DAY, [99, BULL[0]])}
    _, eps = at(spark, tape(spark, cases), close=590)
    assert [(e.status, e.ended, e.retested) for s in "ab" for e in eps[s]] == [("expired", 590, None)] * 2 and eps["b"][0].crossed == 590
    # a calendar row moves the open and the close, and so the buckets
    moved = {"a": minutes(BEFORE, WARM, 575) + minutes(DAY, BULL, 575)}
    calendar = spark.createDataFrame([(BEFORE, 575, 965, False), (DAY, 575, 965, False)], "session_date date, open_minute int, close_minute int, closed boolean")
    bars = tape(spark, moved)
    folded = E.fold(E.calendar_buckets(bars, calendar)).where(F.col("session_date") == F.lit(DAY))
    clock = {r.minute: r for r in E.clock(bars.where(F.col("session_date") == F.lit(DAY)), folded, calendar).collect()}
    assert (clock[583].status, clock[583].latest_end, clock[594].latest_end) == ("warming", None, 595)
    assert [(e.crossed, e.retested) for e in E.ema_episodes(folded).collect()] == [(585, 595)]


def broken_tapes(seed, symbols=8):
    """Sessions of two days with lost minutes, lost buckets, repeated and bad bars, and early ends."""
    random.seed(seed)
    cases = {}
    for s in range(symbols):
        rows = []
        for day in (BEFORE, DAY):
            closes = [100 + random.uniform(-3, 3) for _ in range(random.choice([39, 39, 30]))]
            part = minutes(day, [(c, c - random.random() * 2, c + random.random() * 2) for c in closes])
            for _ in range(random.choice([0, 0, 1, 2])):
                k = random.randrange(len(part))
                how = random.random()
                if how < 0.3:
                    del part[k]
                elif how < 0.5:
                    part = [r for r in part if (r[1] - 570) // 10 != k // 10]
                elif how < 0.75:
                    part.append(part[k])
                else:
                    part[k] = (*part[k][:3], part[k][4] - 1, *part[k][4:])
            rows += part
        cases[f"S{s}"] = rows
    return cases


def test_every_cutoff_is_the_plain_machine(spark):
    cases = broken_tapes(7)
    clock, eps = at(spark, tape(spark, cases))
    seen = set()
    for s, rows in cases.items():
        prior, today = ([r[1:] for r in rows if r[0] == d] for d in (BEFORE, DAY))
        for m in range(560, 960, 3):
            want, _ = plain(prior, today, m, 570, 960)
            got = clock[s, m].asDict()
            assert {k: got[k] for k in want if k != "ema"} == {k: v for k, v in want.items() if k != "ema"}, (s, m)
            assert got["ema"] == pytest.approx(want["ema"]) if want["ema"] is not None else got["ema"] is None
            seen.add(want["status"])
        assert [(e.side, e.status, e.crossed, e.retested, e.ended) for e in eps.get(s, [])] == plain(prior, today, 959, 570, 960)[1]
    assert seen == {"premarket", "warming", "ready", "stale", "unavailable"} and sum(map(len, eps.values())) > 20


def test_stream_of_buckets_is_the_fold(spark):
    """Bucket by bucket, with absent ones left out and old ones come again; three sessions of a symbol."""
    cases = broken_tapes(8)
    third = DAY + dt.timedelta(1)
    for s, rows in broken_tapes(9).items():
        cases[s] += [(third, *r[1:]) for r in rows if r[0] == DAY]
    buckets = E.calendar_buckets(tape(spark, cases))
    want = {(r.symbol, str(r.session_date), r.nth): tuple(r)[3:] for r in E.ema_episodes(E.fold(buckets)).collect()}
    points = {(r.symbol, str(r.session_date), r.bucket): r.ema for r in E.ema_points(E.fold(buckets)).collect()}
    got, ema = {}, {}
    rows = sorted(buckets.collect(), key=lambda r: (r.symbol, r.session_date, r.bucket))
    for s in cases:
        state = None
        mine = [r for r in rows if r.symbol == s]
        for k, r in enumerate(mine):
            if not r.rows and r.end < 960:
                continue  # absent buckets before the last are left out
            for x in (r, mine[max(0, k - 3)]):
                state, out = live.ema_step(state, (str(x.session_date), x.open_minute, x.close_minute, x.bucket, x.high, x.low, x.close, x.rows, x.complete))
                for o in out:
                    (got if o[1] == "episode" else ema)[s, o[0], o[2]] = o[4:] if o[1] == "episode" else o[3]
    close = lambda d: {k: tuple(round(x, 9) if isinstance(x, float) else x for x in v) for k, v in d.items()}
    assert close(got) == close(want) and len(got) > 30
    assert ema.keys() == points.keys() and all(v == pytest.approx(points[k]) if v is not None else points[k] is None for k, v in ema.items())


def test_levels_are_intervals(spark):
    """Confluence by the EMA that was touched, target by the close; overlapping ones are neither above nor below; bad ones count for nothing."""
    schema = "symbol string, session_date date, nth int, name string, low double, high double"
    ref = 100.5
    up = [("A", DAY, k, *x) for k, x in enumerate((("PDC", 100.0, 100.0), ("Edge", ref + 2, ref + 2), ("Outside", ref + 2.01, ref + 2.01), ("Higher", 110.0, 111.0), ("Bad", 105.0, 103.0), (" ", 100.0, 100.0), ("Free", -1.0, 100.0)))]
    down = [("B", DAY, k, *x) for k, x in enumerate((("Overlap", 98.8, 99.2), ("Lower", 97.0, 98.0), ("Further", 94.0, 95.0), ("Tied", 97.5, 98.0)))]
    levels = spark.createDataFrame(up + down, schema)
    e = spark.createDataFrame([("A", DAY, 0, "bullish", 101.0, ref), ("B", DAY, 0, "bearish", 99.0, 99.5), ("C", DAY, 0, "bullish", 99.0, 99.5), ("A", DAY, 1, "bullish", None, None)], "symbol string, session_date date, nth int, side string, confirm_price double, reference double")
    got = {(r.symbol, r.nth): (r.confluence, r.target) for r in E.touched_levels(e, levels).collect()}
    assert got == {("A", 0): (["PDC", "Edge"], "Edge"), ("B", 0): (["Overlap", "Lower", "Tied"], "Lower"), ("C", 0): ([], None)}
    prices = spark.createDataFrame([("A", DAY, 600, 106.0), ("A", DAY, 601, 110.5), ("B", DAY, 600, 99.0), ("B", DAY, 601, 98.0), ("C", DAY, 600, 1.0)], "symbol string, session_date date, minute int, close double")
    near = {(r.symbol, r.minute): (r.above, r.below, r.overlapping, r.confluence) for r in L.around(prices, levels).collect()}
    assert near == {("A", 600): ("Higher", "Outside", "", 0), ("A", 601): (None, "Outside", "Higher", 1), ("B", 600): (None, "Lower", "Overlap", 3), ("B", 601): ("Overlap", "Further", "Lower,Tied", 3), ("C", 600): (None, None, "", 0)}
