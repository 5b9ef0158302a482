"""Minute bars and ordered windows over them, for every symbol and session at once.

All windows are partitioned by (symbol, session_date) and ordered by minute, so one shuffle and one sort serve them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import CLOSE, OPEN, grid_status, to_eastern, valid_bar, valid_price

P = ("symbol", "session_date")


def by_minute() -> WindowSpec:
    """Made when it is used, as a window needs a session."""
    return Window.partitionBy(*P).orderBy("minute")


def minute_bars(ticks: DataFrame, *order: str) -> DataFrame:
    """Ticks (symbol, session_date, minute, price, size) to bars; order names the columns that break ties inside a minute."""
    at = F.struct(*order)
    return ticks.groupBy(*P, "minute").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))


def regular_hours(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Minutes from the open until before the close of the session's calendar row, or of a regular session."""
    if calendar is None:
        return bars.where(F.col("minute").between(OPEN, CLOSE - 1))
    hours = calendar.where("not closed").select("session_date", "open_minute", "close_minute")
    return bars.join(hours, "session_date").where("minute >= open_minute and minute < close_minute").drop("open_minute", "close_minute")


def single_minutes(bars: DataFrame) -> DataFrame:
    """Adds single: false for each minute that occurs more than once, even with equal rows."""
    return bars.withColumn("single", F.count("*").over(Window.partitionBy(*P, "minute")) == 1)


def vwap(bars: DataFrame) -> DataFrame:
    """Cumulative session VWAP of (high + low + close) / 3 from the open; bars without valid volume are skipped."""
    ok = valid_bar(True) & (F.col("volume") > 0)
    w = by_minute().rowsBetween(Window.unboundedPreceding, 0)
    v = F.sum(F.when(ok, F.col("volume"))).over(w)
    pv = F.sum(F.when(ok, (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume"))).over(w)
    return bars.where(F.col("minute") >= OPEN).withColumn("vwap", F.when(v > 0, pv / v))


def strict_vwap(bars: DataFrame) -> DataFrame:
    """VWAP that is null from the first minute since the open that is missing, duplicate or invalid, and while no volume has traded."""
    w = by_minute().rangeBetween(Window.unboundedPreceding, 0)
    rows = single_minutes(bars.where(F.col("minute") >= OPEN))
    good = valid_bar(True) & F.col("single")
    whole = F.sum(good.cast("int")).over(w) == F.col("minute") - OPEN + 1
    v, pv = F.sum("volume").over(w), F.sum((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")).over(w)
    return rows.withColumn("strict_vwap", F.when(whole & (v > 0), pv / v)).drop("single")


def with_run(bars: DataFrame, valid: Column) -> DataFrame:
    """Adds run: a number that changes wherever the minutes are not adjacent or a row is not valid."""
    ok = F.coalesce(valid, F.lit(False))
    broken = F.coalesce(F.col("minute") - F.lag("minute").over(by_minute()) != 1, F.lit(True)) | ~ok | ~F.coalesce(F.lag(ok).over(by_minute()), F.lit(False))
    return bars.withColumn("_break", broken.cast("int")).withColumn("run", F.sum("_break").over(by_minute().rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def relative_volume(bars: DataFrame, most: int = 20, least: int = 4) -> DataFrame:
    """Adds rvol: volume over the mean of up to most earlier volumes of the same unbroken run; null with fewer than least."""
    ok = valid_bar(True)
    rows = with_run(bars, ok)
    w = Window.partitionBy(*P, "run").orderBy("minute").rowsBetween(-most, -1)
    mean = F.avg("volume").over(w)
    return rows.withColumn("rvol", F.when(ok & (F.count("volume").over(w) >= least) & (mean > 0), F.col("volume") / mean)).drop("run")


def confirmations(rows: DataFrame, k: int = 2, look: int = 15, choppy: int = 4) -> DataFrame:
    """rows with close and vwap: adds above and below (k adjacent closes on that side of VWAP), crosses (strict changes of side in the last look bars), choppy."""
    side = F.when(F.col("close") > F.col("vwap"), 1).when(F.col("close") < F.col("vwap"), -1).otherwise(0)
    rows = rows.withColumn("_side", side)
    last = by_minute().rowsBetween(-(k - 1), 0)
    adjacent = F.col("minute") - F.lag("minute", k - 1).over(by_minute()) == k - 1 if k > 1 else F.lit(True)
    held = lambda s: F.coalesce(adjacent & (F.sum((F.col("_side") == s).cast("int")).over(last) == k), F.lit(False))
    rows = rows.withColumns({"above": held(1), "below": held(-1), "_flip": (F.col("_side") * F.lag("_side").over(by_minute()) < 0).cast("int")})
    return rows.withColumn("crosses", F.coalesce(F.sum("_flip").over(by_minute().rowsBetween(-(look - 2), 0)), F.lit(0)).cast("long")).withColumn("choppy", F.col("crosses") >= choppy).drop("_side", "_flip")


def at_offset(value: str, k: int) -> Column:
    """Value k minutes ago exactly; null if that minute is missing."""
    return F.max(value).over(by_minute().rangeBetween(-k, -k))


def returns(bars: DataFrame, ks: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    return bars.withColumns({f"return_{k}": F.col("close") / at_offset("close", k) - 1 for k in ks})


def volatility(bars: DataFrame, n: int = 30) -> DataFrame:
    """Adds volatility: population deviation of the last n one-minute returns, over n + 1 adjacent minutes."""
    w = by_minute().rangeBetween(-(n - 1), 0)
    rows = bars.withColumn("_r", F.col("close") / at_offset("close", 1) - 1)
    return rows.withColumn("volatility", F.when(F.count("_r").over(w) == n, F.stddev_pop("_r").over(w))).drop("_r")


def ten_minute(bars: DataFrame, size: int = 10) -> DataFrame:
    """Buckets of size minutes from the open: (symbol, session_date, bucket, start, open, high, low, close, volume, complete).

    complete only with every minute present once and valid in price; a volume that is not valid counts as 0.
    """
    v = F.when(F.col("volume") >= 0, F.col("volume")).otherwise(0.0)
    b = F.floor((F.col("minute") - OPEN) / size)
    agg = bars.where(F.col("minute") >= OPEN).groupBy(*P, b.cast("int").alias("bucket")).agg(F.min_by("open", "minute").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "minute").alias("close"), F.sum(v).alias("volume"), ((F.count("*") == size) & (F.count_distinct("minute") == size) & F.bool_and(valid_price(*[F.col(c) for c in ("open", "high", "low", "close")]))).alias("complete"))
    return agg.withColumn("start", F.col("bucket") * size + OPEN)


def latest_as_of(grid: DataFrame, facts: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """As-of join: for each row of grid the values of the last fact at or before it, by key. One union and one window, no range join."""
    both = grid.select(*keys, at, F.lit(1).alias("_probe"), *[F.lit(None).cast(facts.schema[v].dataType).alias(v) for v in values], F.lit(None).cast(facts.schema[at].dataType).alias("as_of"))
    facts = facts.select(*keys, at, F.lit(0).alias("_probe"), *values, F.col(at).alias("as_of"))
    w = Window.partitionBy(*keys).orderBy(at, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    fact = F.struct(*values, "as_of")
    last = F.last(F.when(F.col("_probe") == 0, fact), ignorenulls=True).over(w)
    return facts.unionByName(both).withColumn("_last", last).where("_probe = 1").select(*keys, at, *[F.col(f"_last.{v}").alias(v) for v in [*values, "as_of"]])


def admitted(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Minute bars only: one-minute interval, bar-open time on the grid, of the session's date, not after the cutoff minute, valid in price. rows: (ts, interval, ts_kind, session_date, prices)."""
    date, minute = to_eastern(F.col("ts"))
    ok = (F.col("interval") == "1m") & (F.col("ts_kind") == "bar-open") & (grid_status(F.col("ts")) == "on") & (date == F.col("session_date")) & (minute <= cutoff) & valid_bar()
    return rows.withColumn("minute", minute).where(F.coalesce(ok, F.lit(False)))


def between_dates(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows of a span of days; the session date counts where there is one, else the date of the time."""
    return rows.where(F.coalesce("session_date", F.to_date("ts")).between(start, end))


def united(*tables: DataFrame) -> DataFrame:
    """One row set of several kinds; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
