"""One row for each minute of a session: what index, fund and premium say by then, in one merge of the three."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CLOSE, OPEN, direction_label
from ..functions.options_math import expected_move
from ..functions.shared import written
from . import alerts as A
from . import bars as B
from . import ema as E
from . import levels as L
from . import premium as M
from .bars import P


def last_of_each(grid: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """grid (P, minute) and inputs of the same keys: adds for each input a struct of its last row by then, with its minute as as_of; null before the first.

    One union and one window over the minutes of a session, however many the inputs. Of rows that share a minute the greatest counts.
    """
    parts = [grid.select(*P, "minute", F.lit(1).alias("_asked"))]
    for name, rows in inputs.items():
        values = [c for c in rows.columns if c not in (*P, "minute")]
        parts.append(rows.select(*P, "minute", F.lit(0).alias("_asked"), F.struct(F.col("minute").alias("as_of"), *values).alias(name)))
    marks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    w = Window.partitionBy(*P).orderBy("minute", "_asked", *inputs).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in inputs}).where("_asked = 1").drop("_asked")


def fund_states(fund: DataFrame) -> DataFrame:
    """Regular bars of the fund with VWAP, confirmations, the session's levels and regime, day type so far, and closes about the regime's boundary."""
    levels = L.with_previous(L.session_ranges(fund)).drop("previous_date", "prior_close")
    levels = levels.withColumn("regime", L.regime(F.col("prior_high"), F.col("prior_low"), F.col("pm_high"), F.col("pm_low")))
    days = L.day_types(fund, levels).select(*P, "minute", "day_type", F.col("side").alias("day_side"))
    rows = B.confirmations(B.vwap(B.regular_hours(fund))).join(levels, list(P)).join(days, [*P, "minute"])
    rows = M.boundary_tests(rows.withColumn("first_open", F.first("open").over(B.by_minute().rowsBetween(Window.unboundedPreceding, 0))))
    return rows.drop("open", "high", "low", "volume", "choppy")


def minute_readout(index: DataFrame, fund: DataFrame, quotes: DataFrame, most: int = 2, extras: dict[str, DataFrame] | None = None) -> DataFrame:
    """index and fund bars and quotes, all under the session's own symbol: one row for each regular minute of each session that any of them has.

    extras, by name, are further inputs (P, minute, values) such as the network's summary, forecasts, gamma or news contexts: each adds a column of its last
    values by then with their as_of, in the same merge. sampled says whether any of the three has a row at the minute itself.

    Prices, anchor, ratio and expected move, regime and day type, premium reading and phase, confirmations, direction, pattern and whether it may be
    acted upon, and stale where any of the three is missing or over most minutes old. A part without rows by then is null.
    """
    upto = B.by_minute().rowsBetween(Window.unboundedPreceding, 0)
    x = B.regular_hours(index).select(*P, "minute", "close", F.first("open").over(upto).alias("anchor"))
    p = M.postures(M.premium_series(quotes)).select(*P, "minute", "z", "slope", "phase", "recent_low", F.first("iv", ignorenulls=True).over(upto).alias("opening_iv"))
    sessions = reduce(DataFrame.unionByName, [t.select(*P) for t in (index, fund, quotes)]).distinct()
    grid = sessions.withColumn("minute", F.explode(F.sequence(F.lit(OPEN), F.lit(CLOSE - 1))))
    extras = extras or {}
    rows = last_of_each(grid, {"index": x, "fund": fund_states(fund), "premium": p} | extras)
    old = [F.coalesce(F.col("minute") - F.col(f"{n}.as_of") > most, F.lit(True)) for n in ("index", "fund", "premium")]
    rows = rows.withColumn("stale", F.greatest(*old)).select(*P, "minute", "stale", F.col("index.close").alias("price"), "index.anchor", "fund.*", "premium.z", "premium.slope", "premium.phase", "premium.recent_low", "premium.opening_iv", F.coalesce(F.greatest("index.as_of", "fund.as_of", "premium.as_of") == F.col("minute"), F.lit(False)).alias("sampled"), *extras).drop("as_of")
    rows = M.passes(M.active_candidate(M.direction_gate(rows)))
    rows = rows.withColumns({"ratio": F.col("anchor") / F.col("first_open"), "expected_move": expected_move(F.col("anchor"), F.col("opening_iv"), F.lit(CLOSE - OPEN)), "label": direction_label(F.col("z"))})
    return rows.withColumns({"sigma_up": F.col("anchor") + F.col("expected_move"), "sigma_down": F.col("anchor") - F.col("expected_move"), "premarket_high": F.col("ratio") * F.col("pm_high"), "premarket_low": F.col("ratio") * F.col("pm_low")}).select(
        *P, "minute", "price", F.col("close").alias("fund_price"), "vwap", "anchor", "ratio", "expected_move", "sigma_up", "sigma_down", "premarket_high", "premarket_low", "regime", "day_type", "day_side", "z", "slope", "phase", "label", "above", "below", "crosses", "direction", "code", "passed", "stale", "sampled", *extras)


def full_readout(index: DataFrame, fund: DataFrame, quotes: DataFrame, most: int = 2, extras: dict[str, DataFrame] | None = None) -> DataFrame:
    """minute_readout with the EMA clock of the index, the last six divergences that are known, and the playbook's current, previous and latest episode at each minute.

    Clock, readout and premium are tables of one row a minute; they are written on the way, as what follows reads them several times.
    """
    ema = E.clock(B.regular_hours(index), E.fold(E.calendar_buckets(index))).select(*P, "minute", F.col("status").alias("ema_status"), "ema", "bullish", "bearish")
    rows = written(minute_readout(index, fund, quotes, most, {"ema": written(ema)} | (extras or {})))
    rows = rows.withColumns({c: F.col(f"ema.{c}").alias(c) for c in ("ema_status", "bullish", "bearish")}).withColumn("ema", F.col("ema.ema"))
    points = written(M.premium_series(quotes).where("valid").select(*P, "minute", F.col("close").alias("price"), "extrinsic"))
    rows = M.known_divergences(M.divergences(points, keep=None), rows)
    usable = rows.withColumns({"_code": F.col("code"), "code": F.when(~F.col("stale"), F.col("code"))})
    return M.playbook_history(usable).withColumn("code", F.col("_code")).drop("_code")


def analysis(index: DataFrame, fund: DataFrame, quotes: DataFrame, marks: DataFrame, strikes: DataFrame, network: DataFrame, forecasts: DataFrame, most: int = 2, most_seconds: int = 120) -> DataFrame:
    """full_readout (quotes have a close too) with what parity implies, the network, the forecast and the reversal that a pattern warns of, all as known at each minute in the same merge.

    marks: parity_marks; strikes: (P, strike), the session's measurement strike, other strikes are not read. network: (session_date, minute, values);
    forecasts: (session_date, minute, values), one row a minute. Both come with their as_of, and are null before their first row. implied_status is stale,
    without values, where the last pair is over most_seconds old, and null where there is none. A stale minute warns of no reversal.
    """
    sessions = reduce(DataFrame.unionByName, [t.select(*P) for t in (index, fund, quotes)]).distinct()
    at = marks.join(strikes, ["session_date", "strike"]).withColumn("minute", F.ceil(F.col("second") / 60).cast("int"))
    implied = at.select(*P, "minute", "second", "status", "spot", "forward", "low", "high", "comparison")
    named = lambda t: sessions.join(t, "session_date")
    rows = full_readout(index, fund, quotes, most, {"implied": implied, "network": named(network), "forecast": named(forecasts)})
    old = F.col("minute") * 60 - F.col("implied.second") > most_seconds
    rows = rows.withColumn("implied_status", F.when(old, "stale").otherwise(F.col("implied.status")))
    rows = rows.withColumns({f"implied_{c}": F.when(~old, F.col(f"implied.{c}")) for c in ("spot", "forward", "low", "high", "comparison")})
    warned = A.copy_of(F.when(~F.col("stale"), F.col("code")))
    return rows.withColumns({"reversal": warned["direction"], "review": warned["review"]}).drop("implied")
