"""Session structure: previous sessions, ranges, regimes, day types and mapped levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import OPEN
from .bars import P, by_minute

#: Opening-range regimes in the order that they are tested.
REGIMES = ("GAP-UP", "GAP-DOWN", "TWO-SIDED", "EXT-UP", "EXT-DOWN", "INSIDE")


def session_ranges(bars: DataFrame) -> DataFrame:
    """Per symbol and session: regular high, low and last close, and the premarket range."""
    regular, before = F.col("minute") >= OPEN, F.col("minute") < OPEN
    return bars.groupBy(*P).agg(F.max(F.when(regular, F.col("high"))).alias("high"), F.min(F.when(regular, F.col("low"))).alias("low"), F.max_by(F.when(regular, F.col("close")), F.when(regular, F.col("minute"))).alias("close"), F.max(F.when(before, F.col("high"))).alias("pm_high"), F.min(F.when(before, F.col("low"))).alias("pm_low"))


def with_previous(ranges: DataFrame) -> DataFrame:
    """Levels of each session: the previous session's range with its own premarket. Previous: the latest earlier session of the symbol."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    prev = lambda c: F.lag(c).over(w)
    return ranges.select(*P, prev("session_date").alias("previous_date"), prev("high").alias("prior_high"), prev("low").alias("prior_low"), prev("close").alias("prior_close"), "pm_high", "pm_low")


def regime(h: Column, lo: Column, ph: Column, pl: Column) -> Column:
    """Where the premarket range lies against the prior one; equality is inside; null unless both ranges are real."""
    return F.when((h > lo) & (ph >= pl), F.when(pl > h, REGIMES[0]).when(ph < lo, REGIMES[1]).when((ph > h) & (pl < lo), REGIMES[2]).when(ph > h, REGIMES[3]).when(pl < lo, REGIMES[4]).otherwise(REGIMES[5]))


def day_types(bars: DataFrame, levels: DataFrame, k: int = 2) -> DataFrame:
    """Label of each session at each minute, from its regular bars so far: pmr, side and day_type."""
    rows = bars.where(F.col("minute") >= OPEN).join(levels.select(*P, "prior_high", "prior_low", "pm_high", "pm_low"), list(P))
    span = F.col("pm_high") - F.col("pm_low")
    tol = span * 0.025
    last, upto = by_minute().rowsBetween(-(k - 1), 0), by_minute().rowsBetween(Window.unboundedPreceding, 0)
    up = F.sum((F.col("close") > F.col("pm_high")).cast("int")).over(last) == k
    down = F.sum((F.col("close") < F.col("pm_low")).cast("int")).over(last) == k
    rows = rows.withColumns({"_up": up, "_down": down, "_top": F.col("high") >= F.col("pm_high") - tol, "_low": F.col("low") <= F.col("pm_low") + tol})
    edge = lambda c: (F.col(c) & ~F.coalesce(F.lag(c).over(by_minute()), F.lit(False))).cast("int")
    rows = rows.withColumns({"_te": edge("_top"), "_le": edge("_low")})
    at = F.min(F.when(F.col("_up") | F.col("_down"), F.struct("minute", F.when(F.col("_up"), "bull").otherwise("bear").alias("side")))).over(upto)
    rows = rows.withColumns({"_at": at, "tops": F.sum("_te").over(upto), "lows": F.sum("_le").over(upto), "pmr": span / (F.col("prior_high") - F.col("prior_low")) * 100})
    broke, pmr = F.col("_at").isNotNull(), F.col("pmr")
    trend = F.coalesce((pmr <= 30) & broke & (F.col("_at.minute") < 600), F.lit(False))
    wide = F.coalesce((pmr > 30) & (pmr < 70) & broke & (F.col("_at.minute") >= 600), F.lit(False))
    name = F.when(F.col("pm_high").isNull() | F.col("pm_low").isNull(), "developing").when(trend, "double distribution").when(wide, "expanded typical").when(~broke & (F.col("tops") >= 2) & (F.col("lows") >= 2), "trading range").when(~broke & (pmr >= 70), "contained").otherwise("indecisive")
    return rows.select(*P, "minute", "pmr", "tops", "lows", F.when(trend | wide, F.col("_at.side")).otherwise("neutral").alias("side"), name.alias("day_type"))


def mapped_levels(levels: DataFrame, ratio: Column, sigma: Column) -> DataFrame:
    """Long table of named levels (P, nth, name, low, high, price): the prior range and close, premarket proxies scaled by ratio, and one sigma either side of the prior close. Each is a point: low and high are its price."""
    rows = F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(n).alias("name"), v.alias("price")) for k, (n, v) in enumerate((("prior high", F.col("prior_high")), ("prior low", F.col("prior_low")), ("prior close", F.col("prior_close")), ("premarket high", F.col("pm_high") * ratio), ("premarket low", F.col("pm_low") * ratio), ("sigma up", F.col("prior_close") + sigma), ("sigma down", F.col("prior_close") - sigma)))])
    return levels.select(*P, F.explode(rows).alias("x")).select(*P, "x.nth", "x.name", F.col("x.price").alias("low"), F.col("x.price").alias("high"), "x.price").where("price is not null")


def zones(levels: DataFrame) -> DataFrame:
    """Intervals (P, nth, name, low, high) of each session: between the prior and the premarket highs, and between the lows, and a sigma band around the prior close; those whose two ends are known."""
    a, b = F.least, F.greatest
    rows = F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(n).alias("name"), lo.alias("low"), hi.alias("high")) for k, (n, lo, hi) in enumerate((("high zone", a("prior_high", "pm_high"), b("prior_high", "pm_high")), ("low zone", a("prior_low", "pm_low"), b("prior_low", "pm_low"))))])
    return levels.where("prior_high is not null and prior_low is not null and pm_high is not null and pm_low is not null").select(*P, F.explode(rows).alias("x")).select(*P, "x.*")


def around(prices: DataFrame, levels: DataFrame, near: float = 2.0) -> DataFrame:
    """prices (P, minute, close) against the session's levels (P, nth, name, low, high): the nearest strictly above, the nearest strictly below, those that hold the price, and how many lie within near of it.

    A session's few levels travel as two arrays beside each price, one sorted by where they begin, one by where they end, so that the nearest are the first that qualify.
    Levels that aren't intervals of positive prices, or have no name, are left out; a price of a session without levels has none. Of equally near ones the lower nth comes first.
    """
    good = levels.where((F.trim("name") != "") & (F.col("low") > 0) & (F.col("high") >= F.col("low")) & (F.col("high") < float("inf")))
    sets = good.groupBy(*P).agg(F.array_sort(F.collect_list(F.struct("low", "nth", "name", "high"))).alias("_up"), F.array_sort(F.collect_list(F.struct((-F.col("high")).alias("minus"), "nth", "name"))).alias("_down"))
    rows = prices.join(sets, list(P), "left")
    at = F.col("close")
    above = F.try_element_at(F.filter("_up", lambda x: x["low"] > at), F.lit(1))["name"]
    below = F.try_element_at(F.filter("_down", lambda x: -x["minus"] < at), F.lit(1))["name"]
    held = F.array_sort(F.transform(F.filter("_up", lambda x: (x["low"] <= at) & (x["high"] >= at)), lambda x: F.struct(x["nth"], x["name"].alias("name"))))
    close_by = F.filter("_up", lambda x: (x["low"] - near <= at) & (x["high"] + near >= at))
    return rows.select(*P, "minute", "close", above.alias("above"), below.alias("below"), F.coalesce(F.array_join(F.transform(held, lambda x: x["name"]), ","), F.lit("")).alias("overlapping"), F.coalesce(F.size(close_by), F.lit(0)).cast("long").alias("confluence"))
