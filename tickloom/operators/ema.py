"""Ten-minute EMA, its cross and retest episodes and its clock: a native fold over the few buckets of a session, no Python.

Times are closing clock minutes: the bucket of 570 to 579 ends at 580, and what it says is known from minute 579 on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CLOSE, OPEN, valid_price
from .bars import P, by_minute, single_minutes

ALPHA = 2 / 9
SEEDS = 8
#: Later buckets in which a cross can be retested; minutes of a bucket; how near a level is to the EMA; minutes after which the tape is stale.
WINDOW, SIZE, TOLERANCE, STALE = 3, 10, 2.0, 2

_EPISODE = "struct<side:string,status:string,crossed:int,retested:int,ended:int,cross_price:double,confirm_price:double,reference:double>"
_STATE = f"struct<ema:double,seeds:array<double>,prev:struct<close:double,ema:double>,prior_bars:int,points:array<struct<end:int,ema:double,warm:int,prior_bars:int,missing:boolean,close:double>>,episodes:array<{_EPISODE}>>"


def _usable() -> Column:
    return valid_price(F.col("open"), F.col("high"), F.col("low"), F.col("close"))


def _hours(bars: DataFrame, calendar: DataFrame | None, close_at: int) -> DataFrame:
    """bars with open_minute and close_minute of their sessions."""
    if calendar is None:
        return bars.withColumns({"open_minute": F.lit(OPEN), "close_minute": F.lit(close_at)})
    return bars.join(calendar.where("not closed").select("session_date", "open_minute", "close_minute"), "session_date")


def calendar_buckets(bars: DataFrame, calendar: DataFrame | None = None, close_at: int = CLOSE) -> DataFrame:
    """Every bucket of every session, with or without bars: (P, open_minute, close_minute, bucket, end, high, low, close, rows, complete).

    Buckets start at the session's open. complete: all minutes are there once, with valid prices. Those to the close are there, and others up to the session's last bar.
    """
    rows = _hours(bars, calendar, close_at).withColumn("bucket", F.floor((F.col("minute") - F.col("open_minute")) / SIZE).cast("int"))
    by = [*P, "open_minute", "close_minute"]
    made = rows.where("bucket >= 0").groupBy(*by, "bucket").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "minute").alias("close"), F.count("*").alias("rows"), ((F.count("*") == SIZE) & (F.count_distinct("minute") == SIZE) & F.bool_and(_usable())).alias("complete"))
    last = F.greatest(F.floor((F.col("close_minute") - F.col("open_minute")) / SIZE).cast("int"), F.max("bucket") + 1)
    grid = rows.groupBy(*by).agg(last.alias("n")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    out = grid.join(made, [*by, "bucket"], "left").withColumn("end", (F.col("open_minute") + (F.col("bucket") + 1) * SIZE).cast("int"))
    return out.withColumns({"rows": F.coalesce("rows", F.lit(0)), "complete": F.coalesce("complete", F.lit(False))})


def with_prior(buckets: DataFrame) -> DataFrame:
    """One row a session: prior, the buckets of the symbol's previous session up to its last bar, and today, those up to the close.

    The previous session is found among dates alone; its buckets come by a join, so no task holds all sessions of a symbol.
    """
    one = F.struct("bucket", "end", "high", "low", "close", "rows", "complete")
    b = buckets.groupBy(*P, "open_minute", "close_minute").agg(F.array_sort(F.collect_list(one)).alias("b"))
    seen = F.array_max(F.transform(F.filter("b", lambda x: x["rows"] > 0), lambda x: x["bucket"]))
    b = b.select(*P, "open_minute", "close_minute", F.filter("b", lambda x: x["end"] <= F.col("close_minute")).alias("today"), F.filter("b", lambda x: x["bucket"] <= seen).alias("as_prior"))
    before = buckets.select(*P).distinct().withColumn("_before", F.lag("session_date").over(Window.partitionBy("symbol").orderBy("session_date")))
    earlier = b.select("symbol", F.col("session_date").alias("_before"), F.col("as_prior").alias("prior"))
    return b.drop("as_prior").join(before, [*P]).join(earlier, ["symbol", "_before"], "left").drop("_before")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _smoothed(s: Column, b: Column) -> Column:
    """(ema, seeds) after a complete bucket: null until SEEDS closes, then their mean, then the recursion."""
    seeds = F.when(s["ema"].isNull(), F.concat(s["seeds"], F.array(b["close"]))).otherwise(s["seeds"])
    mean = lambda x: F.when(F.size(x) == SEEDS, F.aggregate(x, F.lit(0.0), lambda a, c: a + c) / SEEDS)
    return _let(seeds, lambda x: F.struct(F.when(s["ema"].isNotNull(), s["ema"] + ALPHA * (b["close"] - s["ema"])).otherwise(mean(x)).alias("ema"), x.alias("seeds")))


def _episode(side, status, crossed, retested, ended, cross_price, confirm_price, reference) -> Column:
    return F.struct(side.alias("side"), status.alias("status"), crossed.alias("crossed"), retested.alias("retested"), ended.alias("ended"), cross_price.alias("cross_price"), confirm_price.alias("confirm_price"), reference.alias("reference"))


def _state(ema, seeds, prev, prior_bars, points, episodes) -> Column:
    return F.struct(ema.alias("ema"), seeds.alias("seeds"), prev.alias("prev"), prior_bars.cast("int").alias("prior_bars"), points.alias("points"), episodes.alias("episodes")).cast(_STATE)


def _point(end, ema, warm, prior_bars, missing, close) -> Column:
    return F.array(F.struct(end.alias("end"), ema.alias("ema"), warm.alias("warm"), prior_bars.cast("int").alias("prior_bars"), missing.alias("missing"), close.alias("close")))




def _no_seeds() -> Column:
    return F.array().cast("array<double>")


def _no_bucket() -> Column:
    return F.lit(None).cast("struct<close:double,ema:double>")


def _empty() -> Column:
    return _state(F.lit(None).cast("double"), _no_seeds(), _no_bucket(), F.lit(0), F.array().cast("array<struct<end:int,ema:double,warm:int,prior_bars:int,missing:boolean,close:double>>"), F.array().cast(f"array<{_EPISODE}>"))


def _warmed(s: Column, b: Column) -> Column:
    """One bucket of the previous session: it only warms the EMA; one that isn't complete starts it anew."""
    on = _let(_smoothed(s, b), lambda x: _state(x["ema"], x["seeds"], F.struct(b["close"].alias("close"), x["ema"].alias("ema")), s["prior_bars"] + 1, s["points"], s["episodes"]))
    return F.when(b["complete"], on).otherwise(_empty())


def _reset(s: Column, b: Column) -> Column:
    """A bucket of today that is not complete: EMA, seeds and previous bucket start anew, open episodes are cancelled."""
    ended = F.transform(s["episodes"], lambda e: F.when(e["status"].isin("watching", "confirmed"), _episode(e["side"], F.lit("cancelled"), e["crossed"], e["retested"], b["end"], e["cross_price"], e["confirm_price"], e["reference"])).otherwise(e))
    none = F.lit(None).cast("double")
    return _state(none, _no_seeds(), _no_bucket(), F.lit(0), F.concat(s["points"], _point(b["end"], none, F.lit(0), F.lit(0), F.lit(True), none)), ended)


def _judged(e: Column, b: Column, x: Column) -> Column:
    """An episode after a complete bucket; x: (ema, prev_ema, bull, bear)."""
    long = e["side"] == "bullish"
    above, below = b["close"] > x["ema"], b["close"] < x["ema"]
    elapsed = (b["end"] - e["crossed"]) / SIZE
    retest = (elapsed > 0) & (elapsed <= WINDOW) & (b["low"] <= x["prev_ema"]) & (x["prev_ema"] <= b["high"]) & F.when(long, above).otherwise(below)
    watched = F.when(F.when(long, x["bear"]).otherwise(x["bull"]), "cancelled").when(retest, "confirmed").when(elapsed >= WINDOW, "expired").otherwise("watching")
    status = F.when((e["status"] == "confirmed") & F.when(long, below).otherwise(above), "invalidated").when(e["status"] == "watching", watched).otherwise(e["status"])

    def moved(t: Column) -> Column:
        now, over = (t != e["status"]) & (t == "confirmed"), (t != e["status"]) & (t != "confirmed")
        return _episode(e["side"], t, e["crossed"], F.when(now, b["end"]).otherwise(e["retested"]), F.when(over, b["end"]).otherwise(e["ended"]), e["cross_price"], F.when(now, b["close"]).otherwise(e["confirm_price"]), F.when(now, x["prev_ema"]).otherwise(e["reference"]))

    return _let(status, moved)


def _advanced(s: Column, b: Column) -> Column:
    """A complete bucket of today: episodes are judged, then a cross may open one, so no bucket confirms its own cross."""
    prev = s["prev"]

    def crossed(x: Column) -> Column:
        live = x["ema"].isNotNull() & prev["ema"].isNotNull()
        bull, bear = live & (prev["close"] <= prev["ema"]) & (b["close"] > x["ema"]), live & (prev["close"] >= prev["ema"]) & (b["close"] < x["ema"])
        return F.struct(x["ema"].alias("ema"), x["seeds"].alias("seeds"), prev["ema"].alias("prev_ema"), F.coalesce(live, F.lit(False)).alias("live"), F.coalesce(bull, F.lit(False)).alias("bull"), F.coalesce(bear, F.lit(False)).alias("bear"))

    def after(x: Column) -> Column:
        none = F.lit(None)
        side = F.when(x["bull"], F.lit("bullish")).otherwise("bearish")
        new = F.array(_episode(side, F.lit("watching"), b["end"], none.cast("int"), none.cast("int"), b["close"], none.cast("double"), none.cast("double")))
        free = lambda old: (x["bull"] | x["bear"]) & ~F.exists(old, lambda e: (e["side"] == side) & e["status"].isin("watching", "confirmed"))
        old = F.when(x["live"], F.transform(s["episodes"], lambda e: _judged(e, b, x))).otherwise(s["episodes"])
        episodes = _let(old, lambda o: F.when(free(o), F.concat(o, new)).otherwise(o))
        points = F.concat(s["points"], _point(b["end"], x["ema"], F.size(x["seeds"]), s["prior_bars"], F.lit(False), b["close"]))
        return _state(x["ema"], x["seeds"], F.struct(b["close"].alias("close"), x["ema"].alias("ema")), s["prior_bars"], points, episodes)

    return _let(_let(_smoothed(s, b), crossed), after)


def fold(buckets: DataFrame) -> DataFrame:
    """calendar_buckets to (P, open_minute, close_minute, state): the EMA at each bucket of today, the first point that before any, and all episodes.

    What is still watched at the close has expired there; a session's patterns never go on into the next.
    """
    s = with_prior(buckets).withColumn("s", F.aggregate(F.coalesce("prior", F.array().cast("array<struct<bucket:int,end:int,high:double,low:double,close:double,rows:bigint,complete:boolean>>")), _empty(), _warmed))
    start = _state(F.col("s.ema"), F.col("s.seeds"), F.col("s.prev"), F.col("s.prior_bars"), _point(F.lit(None).cast("int"), F.col("s.ema"), F.size("s.seeds"), F.col("s.prior_bars"), F.lit(False), F.lit(None).cast("double")), F.col("s.episodes"))
    folded = s.select(*P, "open_minute", "close_minute", F.aggregate("today", start, lambda s, b: F.when(b["complete"], _advanced(s, b)).otherwise(_reset(s, b))).alias("state"))
    closed = F.transform("state.episodes", lambda e: F.when(e["status"] == "watching", _episode(e["side"], F.lit("expired"), e["crossed"], e["retested"], F.col("close_minute"), e["cross_price"], e["confirm_price"], e["reference"])).otherwise(e))
    return folded.withColumn("state", F.col("state").withField("episodes", closed))


def ema_points(folded: DataFrame) -> DataFrame:
    """(P, bucket, ema) of the complete buckets."""
    p = folded.select(*P, "open_minute", F.explode("state.points").alias("p")).where("p.end is not null and not p.missing")
    return p.select(*P, ((F.col("p.end") - F.col("open_minute")) / SIZE - 1).cast("int").alias("bucket"), "p.ema")


def ema_episodes(folded: DataFrame) -> DataFrame:
    """(P, nth, side, status, crossed, retested, ended, cross_price, confirm_price, reference)."""
    e = folded.select(*P, F.posexplode("state.episodes").alias("nth", "e"))
    return e.select(*P, F.col("nth").cast("long").alias("nth"), "e.*")


def touched_levels(episodes: DataFrame, levels: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Confirmed episodes with the session's levels, frozen at the retest: confluence, the names of those within tolerance of the EMA that was touched, and target, the next one beyond the confirming close.

    levels: (P, nth, name, low, high), those known before the session; ones that aren't intervals of positive prices are left out. A session has few, so they travel as an array.
    """
    good = levels.where((F.trim("name") != "") & (F.col("low") > 0) & (F.col("high") >= F.col("low")) & (F.col("high") < float("inf")))
    sets = good.groupBy(*P).agg(F.array_sort(F.collect_list(F.struct("nth", "name", "low", "high"))).alias("_l")).withColumnRenamed("nth", "_nth")
    rows = episodes.where("confirm_price is not null").join(sets, [*P], "left").withColumn("_l", F.coalesce("_l", F.array().cast("array<struct<nth:int,name:string,low:double,high:double>>")))
    at = F.col("reference")
    met = F.transform(F.filter("_l", lambda x: (at >= x["low"] - tolerance) & (at <= x["high"] + tolerance)), lambda x: x["name"])
    nearest = lambda c: F.try_element_at(F.array_sort(c), F.lit(1))["name"]
    above = nearest(F.transform(F.filter("_l", lambda x: x["low"] > F.col("confirm_price")), lambda x: F.struct(x["low"].alias("d"), x["nth"].alias("nth"), x["name"].alias("name"))))
    below = nearest(F.transform(F.filter("_l", lambda x: x["high"] < F.col("confirm_price")), lambda x: F.struct((-x["high"]).alias("d"), x["nth"].alias("nth"), x["name"].alias("name"))))
    return rows.withColumns({"confluence": met, "target": F.when(F.col("side") == "bullish", above).otherwise(below)}).drop("_l")


_SAID = "struct<minute:int,shown:boolean,p:struct<end:int,ema:double,warm:int,prior_bars:int,missing:boolean,close:double>,side:string,status:string,at:struct<nth:int,rank:int>>"


def _said(minute: Column, shown: bool = False, **known: Column) -> Column:
    return F.struct(minute.alias("minute"), F.lit(shown).alias("shown"), *[known.get(c, F.lit(None)).alias(c) for c in ("p", "side", "status", "at")]).cast(_SAID)


def clock(bars: DataFrame, folded: DataFrame, calendar: DataFrame | None = None, close_at: int = CLOSE, before: int = 30, as_of: int | None = None) -> DataFrame:
    """One row for each minute from before the open to the close: what is known at it of the EMA and its patterns.

    status: premarket, unavailable (no valid minute yet, or the last bucket not complete), stale (over STALE minutes since the last valid one), warming
    (no bucket or too few closes) or ready. With as_of nothing later is known. ema, latest_end and latest_close (last complete bucket), warm (closes, at most SEEDS), prior_bars, seeded_from_prior,
    latest_minute, age, bullish and bearish (status of the last episode of the side, or idle).
    """
    by = [*P, "open_minute", "close_minute"]
    first = F.col("open_minute") - before
    minutes = F.transform(F.sequence(first, F.col("close_minute") - 1), lambda m: _said(m, True))
    points = F.transform("state.points", lambda p: _said(F.coalesce(p["end"] - 1, first), p=p))
    steps = F.flatten(F.transform("state.episodes", lambda e, nth: F.array(*[_said(t - 1, side=e["side"], status=status, at=F.struct(nth.alias("nth"), F.lit(rank).alias("rank"))) for rank, (t, status) in enumerate(((e["crossed"], F.lit("watching")), (e["retested"], F.lit("confirmed")), (e["ended"], e["status"])))])))
    said = folded.select(*by, F.explode(F.concat(minutes, points, F.filter(steps, lambda x: x["minute"].isNotNull()))).alias("x")).select(*by, "x.*", F.lit(None).cast("int").alias("seen"))
    rows = _hours(bars, calendar, close_at)
    valid = single_minutes(rows.where("minute >= open_minute and minute < close_minute")).where(F.col("single") & _usable())
    both = said.unionByName(valid.select(*by, F.col("minute").cast("int").alias("minute"), F.col("minute").cast("int").alias("seen")), allowMissingColumns=True)
    if as_of is not None:
        both = both.where(F.coalesce(F.col("shown"), F.lit(False)) | F.col("p.end").isNull() & F.col("p").isNotNull() | (F.col("minute") <= as_of))
    of = lambda s: F.max_by(F.when(F.col("side") == s, F.col("status")), F.when(F.col("side") == s, F.col("at"))).alias(s)
    m = both.groupBy(*by, "minute").agg(F.coalesce(F.bool_or("shown"), F.lit(False)).alias("shown"), F.max("seen").alias("seen"), F.first("p", ignorenulls=True).alias("p"), of("bullish"), of("bearish")).where("shown")
    w = by_minute().rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    whole = F.when(F.col("p.end").isNotNull() & ~F.col("p.missing"), F.struct("p.end", "p.close"))
    m = m.select(*by, "minute", last(F.col("seen")).alias("latest_minute"), last(F.col("p")).alias("p"), last(whole).alias("bar"), *[F.coalesce(last(F.col(s)), F.lit("idle")).alias(s) for s in ("bullish", "bearish")])
    age = F.col("minute") - F.col("latest_minute")
    status = F.when(F.col("minute") < F.col("open_minute"), "premarket").when(F.col("latest_minute").isNull(), "unavailable").when(age > STALE, "stale").when(F.col("p.missing"), "unavailable").when(F.col("bar").isNull() | F.col("p.ema").isNull(), "warming").otherwise("ready")
    return m.select(*P, "minute", status.alias("status"), "p.ema", F.col("bar.end").alias("latest_end"), F.col("bar.close").alias("latest_close"), F.least(F.col("p.warm"), F.lit(SEEDS)).alias("warm"), "p.prior_bars", (F.col("p.ema").isNotNull() & (F.col("p.prior_bars") > 0)).alias("seeded_from_prior"), "latest_minute", age.alias("age"), "bullish", "bearish")
