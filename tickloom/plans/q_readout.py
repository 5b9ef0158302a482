"""The whole analysis of each minute: readout, parity, network, forecast and reversal in one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import written
from ..operators import chain as H
from ..operators import forecast as R
from ..operators import network as G
from ..operators import readout as O
from . import fixtures as X
from . import q_network as N
from .q_options import CHAIN, chain
from .registry import ORACLES, query, rounded

#: Quotes of the derived chain are sparse, so a pair may be ten minutes old.
MOST = 600


@query(f"""with fu as ({ORACLES["full_readout"]}), net as ({ORACLES["network_summary"]}), sco as ({ORACLES["logistic_scores"]}),
    fc as (select session_date, minute, p_up, direction, reason from sco where symbol = 'S01' and horizon = 30),
    imp as (with {CHAIN}, f as (select session_date, min(ts) m from chain group by all), st as (select session_date, arg_min(strike, row(abs(strike - spot), strike)) strike from chain join f using (session_date) where ts = m group by all),
        q as (select session_date, strike, (extract(hour from ts) * 3600 + extract(minute from ts) * 60)::bigint - 5 * 3600 s, "right" r, bid, ask from chain join st using (session_date, strike)),
        p as (select session_date, strike, s, count(*) filter (r = 'CALL') nc, count(*) filter (r = 'PUT') np, bool_and(bid > 0 and ask >= bid and (ask - bid) / ((ask + bid) / 2) <= 0.25) ok, max(bid) filter (r = 'CALL') cb, max(ask) filter (r = 'CALL') ca, max(bid) filter (r = 'PUT') pb, max(ask) filter (r = 'PUT') pa from q where s >= 34200 and s < 57600 group by all),
        z as (select *, 1 / (1 + 3.6::double / 100 * ((57600 - s) / 60) / (1440 * 360)) dd, case when nc <> 1 or np <> 1 then 'unpaired' when not ok then 'invalid quote' else 'ok' end status from p)
        select session_date, s // 60 as minute, s, status, (cb + ca) / 2 - (pb + pa) / 2 + strike * dd spot, cb - pa + strike * dd low, ca - pb + strike * dd high from z),
    j as (select fu.*, imp.s, imp.status ist, spot, low, high, net.minute nm, net.status ns, net.breadth, fc.minute fm, fc.p_up, fc.direction fd, fc.reason fr from fu
        asof left join imp on imp.session_date = fu.session_date and imp.minute <= fu.minute asof left join net on net.session_date = fu.session_date and net.minute <= fu.minute asof left join fc on fc.session_date = fu.session_date and fc.minute <= fu.minute),
    k as (select *, case when minute * 60 - s > {MOST} then 'stale' else ist end as "status", ist = 'ok' and minute * 60 - s <= {MOST} good, case when not stale then code end c from j)
    select symbol, session_date, minute, price, code, stale, ema_status, latest_episode, divergences, "status" implied_status, case when good then round(spot + 1e-9, 6) + 0.0 end implied_spot, case when good then case when 6001.0 < low then 'above' when 6001.0 > high then 'below' else 'inside' end when ist is not null and "status" <> 'stale' then 'unavailable' end implied_comparison,
    nm::bigint network_as_of, ns network_status, breadth, fm::bigint forecast_as_of, p_up, fd forecast_direction, fr forecast_reason,
    case when c in ('EXT-UP-COOLING', 'EXT-UP-FAILURE') then 'bearish' when c in ('EXT-UP-REBOUND', 'EXT-DOWN-REBOUND') then 'bullish' end reversal, case when c in ('EXT-UP-COOLING', 'EXT-UP-FAILURE') then 'bullish' when c in ('EXT-UP-REBOUND', 'EXT-DOWN-REBOUND') then 'bearish' end review from k""")
def minute_analysis(spark, d):
    """Every minute of every session with all that is known by then: tape, patterns, EMA, parity, network, forecast, reversal."""
    b = written(X.bars(spark, d, X.PRE))
    one = lambda s, rows: rows.where(F.col("symbol") == s).withColumn("symbol", F.lit("S00"))
    c = chain(spark, d)
    q = c.select("session_date", "strike", "right", "bid", "ask", (F.hour("ts") * 3600 + F.minute("ts") * 60 - 5 * 3600).cast("long").alias("second"), F.lit(34200).alias("open_second"), F.lit(57600).alias("close_second"))
    prints = c.select("session_date").distinct().select("session_date", F.explode(F.sequence(F.lit(34200).cast("long"), F.lit(57600).cast("long"), F.lit(60).cast("long"))).alias("second"), F.lit(6001.0).alias("price"))
    rates = c.select(F.date_sub("session_date", 1).alias("created"), F.lit(3.6).alias("rate")).distinct()
    strikes = H.measurement_strike(c, "session_date").withColumn("symbol", F.lit("S00"))
    s, pairs, labels = N._labels(spark, d)
    network = G.summary(s, pairs, G.largest_clusters(labels, ["session_date", "minute", "sign"])).select("session_date", "minute", "status", "breadth")
    scored = R.scored(R.valid_on(N._vectors(spark, d), R.usable_models(N.registry(spark, d)))).where("symbol = 'S01' and horizon = 30")
    forecasts = scored.select("session_date", "minute", "p_up", "direction", R.horizon_gate(F.col("minute"), F.col("horizon"), F.lit(700)).alias("reason"))
    rows = O.analysis(one("S01", b), one("S02", b), one("S00", X.quoted(b)), H.parity_marks(q, prints, rates), strikes, network, forecasts, most_seconds=MOST)
    last = F.concat(F.col("latest.code"), F.lit(":"), F.col("latest.first_minute"), F.lit("-"), F.col("latest.last_minute")).alias("latest_episode")
    said = F.array_join(F.transform("divergences", lambda x: F.concat(x["kind"], F.lit(":"), x["first_minute"], F.lit("-"), x["second_minute"], F.when(x["confirmed_minute"].isNotNull(), "!").otherwise(""))), " ")
    return rounded(rows.select("symbol", "session_date", "minute", "price", "code", "stale", "ema_status", last, said.alias("divergences"), "implied_status", "implied_spot", "implied_comparison", F.col("network.as_of").alias("network_as_of"), F.col("network.status").alias("network_status"), F.col("network.breadth").alias("breadth"), F.col("forecast.as_of").alias("forecast_as_of"), F.col("forecast.p_up").alias("p_up"), F.col("forecast.direction").alias("forecast_direction"), F.col("forecast.reason").alias("forecast_reason"), "reversal", "review"))
