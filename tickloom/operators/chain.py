"""Option chains: coherence, snapshots, exposure, ladders, parity and payoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.options_math import discount

CONTRACT = ("root", "expiration", "strike", "right")


def coherent_greeks(quotes: DataFrame, most: int = 60) -> DataFrame:
    """Greeks whose time, or whose underlying's time, is over most seconds from the quote become null; adds greek_quality."""
    t = lambda c: F.col(c).cast("double")
    ok = F.coalesce((F.abs(t("greeks_ts") - t("ts")) <= most) & (F.abs(t("underlying_ts") - t("ts")) <= most), F.lit(False))
    return quotes.withColumns({c: F.when(ok, F.col(c)) for c in ("delta", "gamma", "theta", "vega", "iv")}).withColumn("greek_quality", F.when(ok, "synchronous").otherwise("withheld"))


def side_coherent(quotes: DataFrame, most: int = 60) -> DataFrame:
    """Two-sided quotes whose sides are at most so many seconds apart; the quote's time is the older side's."""
    apart = F.abs(F.col("bid_ts").cast("double") - F.col("ask_ts").cast("double"))
    return quotes.where(apart <= most).withColumn("ts", F.least("bid_ts", "ask_ts"))


def with_open_interest(quotes: DataFrame, interest: DataFrame) -> DataFrame:
    """Open interest by exact contract, only if it was known at the quote's time."""
    oi = interest.select(*CONTRACT, F.col("oi_ts").alias("_t"), F.col("open_interest").alias("_oi"))
    rows = quotes.join(oi, list(CONTRACT), "left")
    known = F.col("_t") <= F.col("ts")
    return rows.withColumns({"open_interest": F.when(known, F.col("_oi")), "oi_ts": F.when(known, F.col("_t"))}).drop("_t", "_oi")


def assembled(quotes: DataFrame, interest: DataFrame) -> DataFrame:
    """A snapshot from its parts: greeks in step with their quotes, open interest known at the quote's time."""
    return with_open_interest(coherent_greeks(quotes), interest)


def chain_filter(quotes: DataFrame, root: str = "SPXW") -> DataFrame:
    """Two-sided quotes of the root that expire on their session's day."""
    return quotes.where((F.col("root") == root) & (F.col("expiration") == F.col("session_date")) & F.col("right").isin("CALL", "PUT") & (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")))


def latest_per_contract(quotes: DataFrame, *scope: str) -> DataFrame:
    """Last row of each exact contract, ties by the higher bid and ask, then by the other columns in their order, so that nothing is left to chance. An aggregate, so that each task sends one row for each contract."""
    keys = [*scope, *[c for c in CONTRACT if c not in scope]]
    rest = [c for c in quotes.columns if c not in keys]
    first = ["ts", "bid", "ask"]
    last = F.max_by(F.struct(*rest), F.struct(*first, *[c for c in rest if c not in first]))
    return quotes.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*").select(quotes.columns)


def sampled_history(quotes: DataFrame, minutes: int, *scope: str) -> DataFrame:
    """History of each exact contract: its last quote in every so many minutes, at sample, the start of these; an aggregate, as above."""
    rows = quotes.withColumn("sample", F.window("ts", f"{minutes} minutes")["start"])
    return latest_per_contract(rows, *scope, "sample")


def in_chain_order(chain: DataFrame, *scope: str) -> DataFrame:
    """Adds place: by strike, then right, within a scope, whose chain is short."""
    return chain.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy("strike", "right")))


def bounded_snapshot(latest: DataFrame, *scope: str, seconds: int = 60) -> DataFrame:
    """Contracts whose row is within seconds of the scope's newest. The newest is one number for each scope, combined before its shuffle."""
    newest = latest.groupBy(*scope).agg(F.max("ts").alias("_newest"))
    return latest.join(newest, list(scope)).where(F.col("_newest").cast("double") - F.col("ts").cast("double") <= seconds).drop("_newest")


def coverage(chain: DataFrame, spot: DataFrame, *scope: str, seconds: int = 120) -> DataFrame:
    """Counts of contracts observed, coherent with the spot's time, and excluded."""
    near = F.abs(F.col("ts").cast("double") - F.col("spot_ts").cast("double")) <= seconds
    rows = chain.join(spot.select(*scope, "spot_ts"), list(scope), "left")
    return rows.groupBy(*scope).agg(F.count("*").alias("observed"), F.count_if(near).alias("coherent"), (F.count("*") - F.count_if(near)).alias("excluded"))


def near_spot(chain: DataFrame, spot: DataFrame, *scope: str, seconds: int = 120) -> DataFrame:
    """Contracts quoted within seconds of the scope's spot time."""
    rows = chain.join(spot.select(*scope, "spot_ts"), list(scope))
    return rows.where(F.abs(F.col("ts").cast("double") - F.col("spot_ts").cast("double")) <= seconds).drop("spot_ts")


def gamma_exposure(chain: DataFrame, *scope: str) -> DataFrame:
    """By strike: dollar gamma for a 1 % move (gamma * OI * 100 * spot^2 * 0.01), calls positive, puts negative. chain has spot and cutoff."""
    ok = F.coalesce((F.col("gamma") >= 0) & (F.col("open_interest") >= 0) & (F.col("spot") > 0) & (F.col("ts") <= F.col("cutoff")) & (F.col("oi_ts") <= F.col("cutoff")), F.lit(False))
    g = F.col("gamma") * F.col("open_interest") * 100 * F.col("spot") * F.col("spot") * 0.01
    call, put = F.col("right") == "CALL", F.col("right") == "PUT"
    part = lambda side, v: F.coalesce(F.sum(F.when(ok & side, v)), F.lit(0.0))
    out = chain.groupBy(*scope, "strike").agg(part(call, g).alias("call_gamma"), (-part(put, g)).alias("put_gamma"), part(call, F.col("open_interest")).alias("call_oi"), part(put, F.col("open_interest")).alias("put_oi"), F.count_if(~ok).alias("rejected"), F.count_if(ok).alias("used"))
    return out.withColumn("net_gamma", F.col("call_gamma") + F.col("put_gamma"))


def measurement_strike(chain: DataFrame, *scope: str) -> DataFrame:
    """Strike nearest to the spot known at the scope's earliest time; ties to the lower. Later spots never matter."""
    first = chain.groupBy(*scope).agg(F.min("ts").alias("_first"))
    rows = chain.join(first, list(scope)).where(F.col("ts") == F.col("_first"))
    return rows.groupBy(*scope).agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")).alias("d"), "strike")).alias("strike"))


def ladder(legs: DataFrame, *scope: str, n: int = 21, step: int = 25) -> DataFrame:
    """legs (scope, strike, right, value, usable, spot, spot_fresh): the n strikes nearest to the centre, highest first, with call, put and net.

    The centre is a fresh spot rounded to step, else the middle strike. A leg counts only if exactly one usable contract has it; net needs both.
    """
    one = lambda right: (F.count_if((F.col("right") == right) & F.col("usable")) == 1) & (F.count_if(F.col("right") == right) == 1)
    value = lambda right: F.when(one(right), F.max(F.when((F.col("right") == right) & F.col("usable"), F.col("value"))))
    rows = legs.groupBy(*scope, "strike").agg(value("CALL").alias("call"), value("PUT").alias("put"))
    anchors = legs.groupBy(*scope).agg(F.max(F.when(F.col("spot_fresh"), F.col("spot"))).alias("_spot"), F.sort_array(F.collect_set("strike")).alias("_all"))
    centre = F.coalesce(F.round(F.col("_spot") / step) * step, F.element_at("_all", (F.size("_all") / 2).cast("int") + 1))
    rows = rows.join(anchors.select(*scope, centre.alias("centre")), list(scope))
    near = Window.partitionBy(*scope).orderBy(F.abs(F.col("strike") - F.col("centre")), "strike")
    rows = rows.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= n).drop("_n")
    return rows.withColumn("net", F.col("call") + F.col("put"))


def payoff(legs: DataFrame, low: float, high: float, samples: int = 81, multiplier: int = 100) -> DataFrame:
    """legs (strategy_id, right, strike, premium, quantity): profit at expiry at evenly spaced prices, by strategy."""
    price = F.lit(low) + F.col("i") * F.lit((high - low) / (samples - 1))
    rows = legs.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i")).withColumn("price", price)
    worth = F.when(F.col("right") == "CALL", F.greatest(F.lit(0.0), F.col("price") - F.col("strike"))).otherwise(F.greatest(F.lit(0.0), F.col("strike") - F.col("price")))
    return rows.groupBy("strategy_id", "i").agg(F.first("price").alias("price"), F.sum((worth - F.col("premium")) * F.col("quantity") * multiplier).alias("profit"))


def _pairs(quotes: DataFrame, key: list[str], max_spread: float) -> DataFrame:
    """Calls and puts of each second of the regular session, and whether all of them are two-sided and not wide."""
    ok = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & ((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) <= max_spread)
    by = quotes.where("second >= open_second and second < close_second").withColumn("_ok", F.coalesce(ok, F.lit(False)))
    side = lambda r, v: F.max(F.when(F.col("right") == r, F.col(v)))
    return by.groupBy(*key, "open_second", "close_second", "second").agg(F.count_if(F.col("right") == "CALL").alias("calls"), F.count_if(F.col("right") == "PUT").alias("puts"), F.bool_and("_ok").alias("valid"), *[side(r, v).alias(f"{r[0].lower()}_{v}") for r in ("CALL", "PUT") for v in ("bid", "ask")])


def _implied(pairs: DataFrame, prints: DataFrame, rates: DataFrame, old: Column) -> DataFrame:
    """Adds status, spot, forward, low, high and comparison to pairs; old says that a pair is too old at its cutoff."""
    single = prints.groupBy("session_date", "second").agg(F.count("*").alias("_n"), F.max("price").alias("print")).where("_n = 1").drop("_n")
    age = F.datediff("session_date", "created")
    rate = pairs.select("session_date").distinct().join(rates, (age >= 1) & (age <= 7) & F.col("rate").between(-5, 50)).groupBy("session_date").agg(F.max_by("rate", "created").alias("rate"))
    j = pairs.join(single, ["session_date", "second"], "left").join(rate, "session_date", "left")
    j = j.withColumns({"rate_assumed": F.col("rate").isNull(), "_d": discount(F.coalesce("rate", F.lit(0.0)), (F.col("close_second") - F.col("second")) / 60)})
    c, p, k, d = (F.col("c_bid") + F.col("c_ask")) / 2, (F.col("p_bid") + F.col("p_ask")) / 2, F.col("strike"), F.col("_d")
    status = F.when(~(k > 0), "strike").when(old, "stale").when((F.col("calls") != 1) | (F.col("puts") != 1), "unpaired").when(~F.col("valid"), "invalid quote").otherwise("ok")
    j = j.withColumn("status", status)
    good = F.col("status") == "ok"
    j = j.withColumns({"spot": F.when(good, c - p + k * d), "forward": F.when(good, k + (c - p) / d), "low": F.when(good, F.col("c_bid") - F.col("p_ask") + k * d), "high": F.when(good, F.col("c_ask") - F.col("p_bid") + k * d)})
    comparison = F.when(F.col("print").isNull() | ~good, "unavailable").when(F.col("print") < F.col("low"), "above").when(F.col("print") > F.col("high"), "below").otherwise("inside")
    return j.withColumn("comparison", comparison)


def parity(quotes: DataFrame, prints: DataFrame, rates: DataFrame, max_spread: float = 0.25, max_age: int = 120) -> DataFrame:
    """Implied spot and forward by put-call parity, one row for each (session_date, strike, cutoff).

    quotes: (session_date, strike, cutoff, open_second, close_second, second, right, bid, ask); prints: (session_date, second, price);
    rates: (created, rate). The latest second at or before the cutoff must have exactly one call and one put, both valid and not
    over max_age seconds old. The rate is the latest dated 1 to 7 days before, from -5 to 50; otherwise 0 is assumed.
    """
    key = ["session_date", "strike", "cutoff"]
    pairs = _pairs(quotes.where("second <= cutoff"), key, max_spread)
    last = pairs.groupBy(*key, "open_second", "close_second").agg(F.max_by(F.struct("second", "calls", "puts", "valid", "c_bid", "c_ask", "p_bid", "p_ask"), "second").alias("q")).select(*key, "close_second", "q.*")
    j = _implied(last, prints, rates, F.col("cutoff") - F.col("second") > max_age)
    return j.select(*key, "second", "status", "rate_assumed", "spot", "forward", "low", "high", "comparison")


def parity_marks(quotes: DataFrame, prints: DataFrame, rates: DataFrame, max_spread: float = 0.25) -> DataFrame:
    """What parity says at every second that has a quote, one row for each (session_date, strike, second), whatever the cutoff: quotes as for parity without one.

    A cutoff's answer is the last of these, or stale, so all cutoffs are one merge and quotes aren't repeated for each.
    """
    j = _implied(_pairs(quotes, ["session_date", "strike"], max_spread), prints, rates, F.lit(False))
    return j.select("session_date", "strike", "second", "status", "rate_assumed", "spot", "forward", "low", "high", "comparison")
