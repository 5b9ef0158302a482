"""A session from normalised rows: its tapes, previous session, premium quotes and chain, for all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.archive import withheld_interest
from . import bars as B
from . import chain as H
from . import network as N

DAY = "session_date"


def parts(bars: DataFrame, options: DataFrame, cutoff: Column, index: str, fund: str, seconds: int = 60, strict: bool = True) -> dict[str, DataFrame]:
    """bars (symbol, session_date, minute, provider, prices) and options of the session's expiry, with cutoff a time over the columns of options.

    Gives tapes (with VWAP; symbols of several providers are left out and reported as mixed), quotes (calls of the strike fixed at the first call), and chain
    (last quote of each contract within seconds of the newest, in order, with open interest only where it was known), each with session_date.
    """
    single, mixed = N.without_mixed_providers(bars)
    tapes = B.vwap(single)
    ok = (F.col("ts") <= cutoff) & (F.col("expiration") == F.col(DAY)) & F.col("right").isin("CALL", "PUT") & (F.col("bid") >= 0) & (F.col("ask") >= F.col("bid"))
    seen = options.where(F.coalesce(ok, F.lit(False)))
    calls = seen.where("right = 'CALL' and bid > 0")
    strikes = H.measurement_strike(calls, DAY)
    latest = H.latest_per_contract(seen, DAY)
    near = withheld_interest(H.bounded_snapshot(latest, DAY, seconds=seconds), cutoff, strict)
    return {"index": tapes.where(F.col("symbol") == index), "fund": tapes.where(F.col("symbol") == fund), "context": tapes.where(~F.col("symbol").isin(index, fund)), "mixed": mixed, "strikes": strikes, "quotes": seen.where("right = 'CALL'").join(strikes, [DAY, "strike"]), "latest": latest, "chain": H.in_chain_order(near, DAY)}


def summary(p: dict[str, DataFrame]) -> DataFrame:
    """One row for each session that any part has: counts of the parts, last index price, fixed strike and the previous session of the index."""
    count = lambda part, name: p[part].groupBy(DAY).agg(F.count("*").alias(name))
    tape = p["index"].groupBy(DAY).agg(F.count("*").alias("index_bars"), F.max_by("close", "minute").alias("spot"))
    tape = tape.withColumn("previous_date", F.lag(DAY).over(Window.orderBy(DAY)))  # one row a session
    chain = p["chain"].groupBy(DAY).agg(F.count("*").alias("coherent"), F.count("open_interest").alias("interest_known"))
    rows = tape
    for other in (count("fund", "fund_bars"), count("context", "context_bars"), count("mixed", "mixed_symbols"), count("quotes", "quotes"), count("latest", "observed"), chain, p["strikes"]):
        rows = rows.join(other, DAY, "full")
    rows = rows.na.fill(0, ["index_bars", "fund_bars", "context_bars", "mixed_symbols", "quotes", "observed", "coherent", "interest_known"])
    return rows.withColumns({"excluded": F.col("observed") - F.col("coherent"), "intraday": (F.col("index_bars") > 0) & (F.col("fund_bars") > 0)})
