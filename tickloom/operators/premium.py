"""Option premium against its own recent past, postures, candidates, episodes and divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.options_math import intrinsic
from .bars import P, by_minute, with_run


#: Decimals of readings that are compared with thresholds; two more than are shown.
DECIMALS = 8


def _settled(c: Column) -> Column:
    return F.round(c, DECIMALS) + F.lit(0.0)


def premium_series(quotes: DataFrame, lookback: int = 60, slope_bars: int = 3, max_spread: float = 0.25, least: int = 5) -> DataFrame:
    """quotes (P, minute, bid, ask, strike, right, underlying, lag_seconds, iv, iv_error): mid, extrinsic, spread, valid, z, slope, baseline_bars.

    z and slope look at the unbroken run of valid minutes up to and including the current one. Both are rounded to DECIMALS, so that a reading that equals
    its baseline or a threshold does so whatever the order of summation.
    """
    mid = (F.col("bid") + F.col("ask")) / 2
    ex = mid - intrinsic(F.col("underlying"), F.col("strike"), F.col("right"))
    rows = quotes.withColumns({"mid": mid, "_ex": ex, "spread": (F.col("ask") - F.col("bid")) / mid})
    ok = (F.col("underlying") > 0) & (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (F.col("spread") <= max_spread) & (F.col("_ex") >= -0.05) & (F.abs("lag_seconds") <= 60)
    rows = with_run(rows.withColumn("valid", F.coalesce(ok, F.lit(False))), F.col("valid"))
    rows = rows.withColumn("extrinsic", F.when(F.col("valid"), F.greatest(F.lit(0.0), F.col("_ex"))))
    w = Window.partitionBy(*P, "run").orderBy("minute")
    base, tail = w.rowsBetween(-(lookback - 1), 0), w.rowsBetween(-(slope_bars - 1), 0)
    n, sd = F.count("extrinsic").over(base), F.stddev_pop("extrinsic").over(base)
    rows = rows.withColumns({"baseline_bars": F.when(F.col("valid"), n).otherwise(F.lit(0)), "z": F.when(F.col("valid") & (n >= least) & (sd > 1e-8), _settled((F.col("extrinsic") - F.avg("extrinsic").over(base)) / sd)), "slope": F.when(F.col("valid") & (n >= least), _settled(F.regr_slope("extrinsic", F.col("minute").cast("double")).over(tail)))})
    return rows.withColumn("iv", F.when(F.col("iv_error") < 0.05, F.col("iv"))).drop("_ex", "run", "iv_error")


def postures(points: DataFrame) -> DataFrame:
    """Phase of each point: prior extremes are the z readings 29 to 3 before, the trend is the slope of the last ten; readings without z don't count. The trend is rounded like z."""
    w = Window.partitionBy(*P).orderBy("minute")
    some = points.where("z is not null").withColumn("_n", F.row_number().over(w).cast("double"))
    prior, ten = w.rowsBetween(-29, -3), w.rowsBetween(-9, 0)
    some = some.select(*P, "minute", F.max("z").over(prior).alias("prior_high"), F.min("z").over(prior).alias("prior_low"), F.when(F.count("z").over(ten) >= 5, _settled(F.regr_slope("z", "_n").over(ten))).otherwise(F.lit(0.0)).alias("trend"), F.min("z").over(w.rowsBetween(-29, 0)).alias("recent_low"))
    rows = points.join(some, [*P, "minute"], "left")
    known = F.col("valid") & F.col("z").isNotNull() & F.col("slope").isNotNull()
    decay = F.coalesce((F.col("prior_high") >= 2) & (F.col("z") > 0) & (F.col("trend") < -0.025), F.lit(False))
    recovery = F.coalesce((F.col("prior_low") <= -2) & (F.col("z") < 0) & (F.col("trend") > 0.025), F.lit(False))
    phase = F.when(~known, "unknown").when(decay, "positive-decay").when(recovery, "negative-recovery").when(F.col("slope") > 0.005, "expansion").when(F.col("slope") < -0.005, "compression").otherwise("balanced")
    return rows.withColumn("phase", phase)


#: Candidate rules in the order that they are tested inside a regime: code, regime, side, type.
RULES = (
    ("INSIDE-RISE", "INSIDE", "long", "momentum"),
    ("INSIDE-FALL", "INSIDE", "short", "momentum"),
    ("INSIDE-SELLING", "INSIDE", "short", "momentum"),
    ("EXT-UP-COOLING", "EXT-UP", "both", "anticipation"),
    ("EXT-UP-REBOUND", "EXT-UP", "long", "anticipation"),
    ("EXT-UP-FAILURE", "EXT-UP", "short", "momentum"),
    ("EXT-DOWN-SELLING", "EXT-DOWN", "short", "momentum"),
    ("EXT-DOWN-REBOUND", "EXT-DOWN", "long", "anticipation"),
    ("EXT-DOWN-RECOVERY", "EXT-DOWN", "long", "momentum"),
)


def predicates() -> dict[str, Column]:
    """One condition for each code, over close, z, slope, phase, recent_low, above and the session's levels."""
    c, z, s = F.col("close"), F.col("z"), F.col("slope")
    return {
        "INSIDE-RISE": (c > F.col("pm_high")) & (z > 0) & (s > 0),
        "INSIDE-FALL": (c < F.col("pm_low")) & (z < 0) & (s < 0),
        "INSIDE-SELLING": (c < F.col("pm_low")) & (F.col("phase") == "negative-recovery"),
        "EXT-UP-COOLING": F.col("phase") == "positive-decay",
        "EXT-UP-REBOUND": (F.col("recent_low") < -1) & (z > 0) & F.col("above"),
        "EXT-UP-FAILURE": (z < -1) & (s < 0) & (c < F.col("prior_high")),
        "EXT-DOWN-SELLING": (z < -2) & (c < F.col("prior_low")),
        "EXT-DOWN-REBOUND": (F.col("phase") == "negative-recovery") & (c > F.col("prior_low")),
        "EXT-DOWN-RECOVERY": (z >= -2) & (z < 0) & (s >= 0) & F.col("above"),
    }


def active_candidate(rows: DataFrame) -> DataFrame:
    """Adds code, side and kind of the first rule of the row's regime that holds; all null if none does or z is missing."""
    tests = predicates()
    chosen = F.coalesce(*[F.when(F.col("z").isNotNull() & (F.col("regime") == r) & tests[code], F.struct(F.lit(code).alias("code"), F.lit(side).alias("side"), F.lit(kind).alias("kind"))) for code, r, side, kind in RULES])
    return rows.withColumn("_c", chosen).withColumns({"code": F.col("_c.code"), "candidate_side": F.col("_c.side"), "candidate_kind": F.col("_c.kind")}).drop("_c")


def direction_gate(rows: DataFrame, threshold: float = 1.0, choppy: int = 4) -> DataFrame:
    """Adds direction: long or short by confirmed side and z; neutral while choppy or in decay or recovery."""
    calm = (F.col("crosses") < choppy) & ~F.col("phase").isin("positive-decay", "negative-recovery")
    d = F.when(calm & F.col("above") & (F.col("z") >= threshold), "long").when(calm & F.col("below") & (F.col("z") <= -threshold), "short").otherwise("neutral")
    return rows.withColumn("direction", d)


def boundary_tests(rows: DataFrame, k: int = 2, look: int = 12) -> DataFrame:
    """Adds broke_down and broke_up: k adjacent closes below (above) the boundary of the row's regime, after one at or beyond it on the other side within look bars. All closes are held against this one boundary, whatever the regime was at theirs."""
    rows = rows.withColumn("_b", F.when(F.col("regime") == "EXT-DOWN", F.col("prior_low")).otherwise(F.col("prior_high")))
    last = by_minute().rowsBetween(-(k - 1), 0)
    held_up, held_down = ((F.count("close").over(last) == k) & c for c in (F.min("close").over(last) > F.col("_b"), F.max("close").over(last) < F.col("_b")))
    adjacent = F.coalesce(F.col("minute") - F.lag("minute", k - 1).over(by_minute()) == k - 1, F.lit(False))
    before = by_minute().rowsBetween(-(look - 1), -k)
    was_down, was_up = F.min("close").over(before) <= F.col("_b"), F.max("close").over(before) >= F.col("_b")
    return rows.withColumns({"broke_down": adjacent & held_down & was_up, "broke_up": adjacent & held_up & was_down}).drop("_b")


def passes(rows: DataFrame) -> DataFrame:
    """Adds passed: momentum needs the direction to agree; anticipation the boundary tested and broken the candidate's way."""
    momentum = (F.col("direction") != "neutral") & ((F.col("candidate_side") == "both") | (F.col("candidate_side") == F.col("direction")))
    anticipation = F.when(F.col("candidate_side").isin("short", "both"), F.col("broke_down")).otherwise(F.col("broke_up"))
    return rows.withColumn("passed", F.coalesce(F.when(F.col("candidate_kind") == "momentum", momentum).when(F.col("candidate_kind") == "anticipation", anticipation), F.lit(False)))


def execution(rows: DataFrame, k: int = 2, look: int = 12) -> DataFrame:
    """Adds passed, for rows that have candidate and close of the same minute."""
    return passes(boundary_tests(rows, k, look)).drop("broke_down", "broke_up")


def episodes(samples: DataFrame) -> DataFrame:
    """samples (P, minute, code, fresh): runs of one code over adjacent samples, a sample without a match in between splits them.

    (P, episode, code, first_minute, last_minute, samples, previous_code)
    """
    code = F.when(F.col("fresh"), F.col("code"))
    rows = samples.withColumn("_code", code)
    change = ~F.col("_code").eqNullSafe(F.lag("_code").over(by_minute()))
    rows = rows.withColumn("_run", F.sum(change.cast("int")).over(by_minute().rowsBetween(Window.unboundedPreceding, 0))).where("_code is not null")
    runs = rows.groupBy(*P, "_run", F.col("_code").alias("code")).agg(F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"), F.count("*").alias("samples"))
    w = Window.partitionBy(*P).orderBy("first_minute")
    return runs.select(*P, F.row_number().over(w).cast("long").alias("episode"), "code", "first_minute", "last_minute", "samples", F.lag("code").over(w).alias("previous_code"))


def playbook_history(rows: DataFrame) -> DataFrame:
    """rows (P, minute, code, sampled), one for each minute of a session: adds current, previous and latest as they are known at each minute, each (code, first_minute, last_minute) or null.

    code is the candidate that may be used at the minute, null where there is none or inputs are stale. Sampled minutes make episodes: runs of one code without
    a sample between that lacks it. At other minutes a code may still be current, but adds nothing. current: the latest episode if its run goes on and the minute's own
    code is its code; previous: the one before that, or the latest if none is current. One partitioning and order serve all windows.
    """
    upto, before = by_minute().rowsBetween(Window.unboundedPreceding, 0), by_minute().rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("sampled"), F.struct(F.col("code").alias("c")))
    rows = rows.withColumns({"_was": F.last(seen, ignorenulls=True).over(before)["c"], "_hit": F.col("sampled") & F.col("code").isNotNull()})
    rows = rows.withColumn("_new", F.col("_hit") & ~F.coalesce(F.col("_was") == F.col("code"), F.lit(False)))
    start, hit = F.when(F.col("_new"), F.struct("code", F.col("minute").alias("first_minute"))), F.when(F.col("_hit"), F.col("minute"))
    episode = lambda w: F.struct(F.last(start, ignorenulls=True).over(w)["code"].alias("code"), F.last(start, ignorenulls=True).over(w)["first_minute"].alias("first_minute"), F.last(hit, ignorenulls=True).over(w).alias("last_minute"))
    rows = rows.withColumns({"_latest": episode(upto), "_earlier": episode(before), "_on": F.last(F.when(F.col("sampled"), F.col("code").isNotNull()), ignorenulls=True).over(upto)})
    # what was the latest episode when the newest one began
    rows = rows.withColumn("_second", F.last(F.when(F.col("_new"), F.col("_earlier")), ignorenulls=True).over(upto))
    there = lambda e: F.when(e["code"].isNotNull(), e)
    now = F.coalesce(F.col("_on") & (F.col("_latest.code") == F.col("code")), F.lit(False))
    latest, second = there(F.col("_latest")), there(F.col("_second"))
    return rows.withColumns({"current": F.when(now, latest), "previous": F.when(now, second).otherwise(latest), "latest": latest}).drop("_was", "_hit", "_new", "_latest", "_earlier", "_on", "_second")


def sample_minutes(*series: DataFrame) -> DataFrame:
    """Distinct (P, minute) over several series."""
    out = series[0].select(*P, "minute")
    for s in series[1:]:
        out = out.unionByName(s.select(*P, "minute"))
    return out.distinct()


def known_divergences(found: DataFrame, grid: DataFrame, keep: int = 6) -> DataFrame:
    """found as divergences gives them (all of a session), grid (P, minute): the last keep of those known at each minute, as an array of (second_minute, first_minute, kind, trigger, confirmed_minute), newest first.

    A pivot is known two minutes after it; a confirmation from its own minute on. A session has few, so they travel as an array.
    """
    one = F.struct("second_minute", "first_minute", "kind", "trigger", "confirmed_minute")
    sets = found.groupBy(*P).agg(F.collect_list(one).alias("_d"))
    m = F.col("minute")
    known = F.transform(F.filter("_d", lambda x: x["second_minute"] + 2 <= m), lambda x: F.struct((-x["second_minute"]).alias("s"), (-x["first_minute"]).alias("f"), x["kind"].alias("kind"), x["trigger"].alias("trigger"), F.when(x["confirmed_minute"] <= m, x["confirmed_minute"]).alias("confirmed_minute")))
    last = F.transform(F.slice(F.array_sort(known), 1, keep), lambda x: F.struct((-x["s"]).alias("second_minute"), (-x["f"]).alias("first_minute"), x["kind"].alias("kind"), x["trigger"].alias("trigger"), x["confirmed_minute"].alias("confirmed_minute")))
    return grid.join(sets, list(P), "left").withColumn("divergences", F.coalesce(last, F.expr("array()").cast("array<struct<second_minute:int,first_minute:int,kind:string,trigger:double,confirmed_minute:int>>"))).drop("_d")


def divergences(points: DataFrame, keep: int | None = 6, least: int = 5, most: int = 40) -> DataFrame:
    """points (P, minute, price, extrinsic), valid ones only: pairs of adjacent pivots of a kind, price higher, premium not.

    (P, kind, first_minute, second_minute, trigger, confirmed_minute), the last keep by second_minute, or all.
    """
    w5 = by_minute().rowsBetween(-2, 2)
    rows = points.withColumns({"_lo": F.min("price").over(w5), "_hi": F.max("price").over(w5), "_n": F.count("*").over(w5), "_span": F.lead("minute", 2).over(by_minute()) - F.lag("minute", 2).over(by_minute())})
    pivots = rows.where("_n = 5 and _span = 4").select(*P, "minute", "price", "extrinsic", F.explode(F.filter(F.array(F.when(F.col("price") <= F.col("_lo"), F.lit("bullish")), F.when(F.col("price") >= F.col("_hi"), F.lit("bearish"))), lambda x: x.isNotNull())).alias("kind"))
    w = Window.partitionBy(*P, "kind").orderBy("minute")
    prev = {f"a_{c}": F.lag(c).over(w) for c in ("minute", "price", "extrinsic")}
    pairs = pivots.withColumns(prev).where((F.col("minute") - F.col("a_minute")).between(least, most) & (F.col("price") > F.col("a_price")) & (F.col("extrinsic") <= F.col("a_extrinsic")))
    pairs = pairs.select(*P, "kind", "a_minute", F.col("minute").alias("b_minute"))
    p = points.select(*P, F.col("minute").alias("m"), F.col("price").alias("x"))
    up = F.col("kind") == "bullish"
    inside = pairs.join(p, list(P)).where("m > a_minute and m < b_minute").groupBy(*P, "kind", "a_minute", "b_minute").agg(F.max("x").alias("_max"), F.min("x").alias("_min")).withColumn("trigger", F.when(up, F.col("_max")).otherwise(F.col("_min")))
    beyond = F.when(up, F.col("x") > F.col("trigger")).otherwise(F.col("x") < F.col("trigger"))
    later = inside.join(p, list(P)).groupBy(*P, "kind", "a_minute", "b_minute", "trigger").agg(F.min(F.when((F.col("m") > F.col("b_minute") + 2) & beyond, F.col("m"))).alias("confirmed_minute"))
    if keep is not None:
        last = Window.partitionBy(*P).orderBy(F.desc("b_minute"), F.desc("a_minute"), "kind")
        later = later.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= keep)
    return later.select(*P, "kind", F.col("a_minute").alias("first_minute"), F.col("b_minute").alias("second_minute"), "trigger", "confirmed_minute")


def stale_inputs(grid: DataFrame, inputs: dict[str, DataFrame], most: int = 2) -> DataFrame:
    """grid (symbol, session_date, minute) and inputs by name, each of the same columns: adds for each the last minute that it had by then, <name>_as_of, and stale, whether any is missing or over most minutes old.

    One union and one window over the minutes of a session.
    """
    keys = ["symbol", "session_date", "minute"]
    marks = grid.select(*keys, F.lit(None).cast("string").alias("_input"))
    for name, rows in inputs.items():
        marks = marks.unionByName(rows.select(*keys, F.lit(name).alias("_input")))
    at = marks.groupBy(*keys).agg(F.max(F.col("_input").isNull()).alias("_asked"), F.collect_set("_input").alias("_seen"))
    w = Window.partitionBy("symbol", "session_date").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    as_of = {n: F.max(F.when(F.array_contains("_seen", n), F.col("minute"))).over(w) for n in inputs}
    rows = at.withColumns({f"{n}_as_of": c for n, c in as_of.items()}).where("_asked")
    old = [F.coalesce(F.col("minute") - F.col(f"{n}_as_of") > most, F.lit(True)) for n in inputs]
    return rows.withColumn("stale", F.greatest(*old) if len(old) > 1 else old[0]).drop("_asked", "_seen")
