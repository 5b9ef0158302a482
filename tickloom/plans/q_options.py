"""Option mathematics and chains. Contracts are parts, quotes are line items of a part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import options_math as O
from ..functions.shared import dealt
from ..operators import chain as H
from ..operators import session as S
from . import fixtures as X
from .registry import query, rounded

#: Contracts of the chain: strikes of 5 points around 6000, both rights, one expiry for each session.
#: A fill of the tape has three sessions.
DAY = f"(l_orderkey // {X.FILL} * 3 + l_orderkey % 3)::int"
CHAIN = f"""chain0 as (select date '2026-01-05' + {DAY} session_date, 5900.0::double + 5 * (l_partkey % 41) strike, case when l_suppkey % 2 = 0 then 'CALL' else 'PUT' end as "right", timestamp '2026-01-05 14:30:00' + to_days({DAY}) + to_seconds(((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 23400)::int) ts,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity from lineitem),
    chain as (select 'SPXW' root, session_date expiration, *, 10 + (l_quantity::bigint % 20) / 4 - 0.25 bid, 10 + (l_quantity::bigint % 20) / 4 + 0.25 ask, (l_partkey % 17) / 10000 gamma, l_quantity * 10 open_interest, ts - to_seconds((l_orderkey % 90)::int) greeks_ts, ts - to_seconds((l_linenumber * 11)::int) underlying_ts,
    ts + to_seconds((l_partkey % 7 - 5)::int) oi_ts, 5950 + (l_orderkey % 100) spot from chain0)"""

#: Of quotes of one second and one price the line of the highest order counts, as the chain's columns begin with the line's.
NEWEST = f"ts desc, bid desc, ask desc, {', '.join(f'{c} desc' for c in X.ORDER)}"


def chain(spark, d) -> DataFrame:
    li = X.table(spark, d, "lineitem")
    day = X.day_number(3)
    ts = F.timestamp_seconds(F.lit(1767623400) + day.cast("long") * 86400 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")) % 23400)
    base = li.select(F.lit("SPXW").alias("root"), F.date_add(F.lit("2026-01-05").cast("date"), day).alias("session_date"), (5900.0 + 5 * (F.col("l_partkey") % 41)).alias("strike"), F.when(F.col("l_suppkey") % 2 == 0, "CALL").otherwise("PUT").alias("right"), ts.alias("ts"), *X.ORDER, "l_quantity")
    sec = lambda n: F.make_dt_interval(secs=n)
    mid = 10 + (F.col("l_quantity").cast("long") % 20) / 4
    return base.withColumns({"expiration": F.col("session_date"), "bid": mid - 0.25, "ask": mid + 0.25, "gamma": (F.col("l_partkey") % 17) / 10000, "open_interest": F.col("l_quantity") * 10, "greeks_ts": F.col("ts") - sec(F.col("l_orderkey") % 90), "underlying_ts": F.col("ts") - sec(F.col("l_linenumber") * 11), "oi_ts": F.col("ts") + sec(F.col("l_partkey") % 7 - 5), "spot": (5950 + F.col("l_orderkey") % 100).cast("double"), **{c: F.lit(0.5) for c in ("delta", "theta", "vega", "iv")}})


CDF = "(1 - d * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"
BS = """b0 as (select p_partkey, 6000.0::double + p_size spot, 5900.0::double + p_partkey % 200 strike, (1 + p_partkey % 30) / 365 yr, 0.1::double + p_size / 100 iv, 0.04::double rate, case when p_partkey % 2 = 0 then 'CALL' else 'PUT' end as "right" from part),
    b1 as (select *, sqrt(yr) root, (ln(spot / strike) + (rate + iv * iv / 2) * yr) / (iv * sqrt(yr)) d1, exp(-rate * yr) disc from b0), b2 as (select *, d1 - iv * root d2 from b1),
    b3 as (select *, cdf(d1) n1, cdf(d2) n2, cdf(-d1) m1, cdf(-d2) m2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) pdf from b2)"""


def _bs_sql(tail: str) -> str:
    body = BS
    for x in ("-d1", "-d2", "d1", "d2"):
        a, t = f"abs({x})", f"(1 / (1 + 0.2316419::double * abs({x})))"
        poly = f"(0.3989422804014327::double * exp(-({x}) * ({x}) / 2) * {t} * (0.319381530::double + {t} * (-0.356563782::double + {t} * (1.781477937::double + {t} * (-1.821255978::double + {t} * 1.330274429::double)))))"
        body = body.replace(f"cdf({x})", f"(case when ({x}) >= 0 then 1 - {poly} else {poly} end)")
    return f"with {body} {tail}"


def _contracts(spark, d) -> DataFrame:
    return dealt(X.table(spark, d, "part"), "p_partkey", rows=50_000).select("p_partkey", (6000.0 + F.col("p_size")).alias("spot"), (5900.0 + F.col("p_partkey") % 200).alias("strike"), ((1 + F.col("p_partkey") % 30) / 365).alias("years"), (0.1 + F.col("p_size") / 100).alias("iv"), F.lit(0.04).alias("rate"), F.when(F.col("p_partkey") % 2 == 0, "CALL").otherwise("PUT").alias("right"))


def _priced(c: DataFrame, spot=None):
    return O.black_scholes(F.col("spot") if spot is None else spot, F.col("strike"), F.col("years"), F.col("iv"), F.col("rate"), F.col("right"))


@query(_bs_sql("""select p_partkey, round(case when "right" = 'CALL' then spot * n1 - strike * disc * n2 else strike * disc * m2 - spot * m1 end + 1e-9, 6) + 0.0 price, round(case when "right" = 'CALL' then n1 else n1 - 1 end + 1e-9, 6) + 0.0 delta, round(pdf / (spot * iv * root) + 1e-9, 6) + 0.0 gamma,
    round((-spot * pdf * iv / (2 * root) + case when "right" = 'CALL' then -rate * strike * disc * n2 else rate * strike * disc * m2 end) / 365 + 1e-9, 6) + 0.0 theta, round(spot * pdf * root / 100 + 1e-9, 6) + 0.0 vega from b3"""))
def black_scholes_greeks(spark, d):
    c = _contracts(spark, d)
    return rounded(c.withColumn("g", _priced(c)).select("p_partkey", "g.*"))


@query()
def greek_audit(spark, d):
    """Delta, gamma and vega against finite differences of the price; the bumped contracts are rows, priced once each."""
    h = 0.5
    bumps = (("mid", 0.0, 0.0), ("up", h, 0.0), ("down", -h, 0.0), ("more", 0.0, 0.01), ("less", 0.0, -0.01))
    rows = _contracts(spark, d).withColumn("b", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(ds).alias("ds"), F.lit(dv).alias("dv")) for n, ds, dv in bumps])))
    rows = rows.withColumns({"spot": F.col("spot") + F.col("b.ds"), "iv": F.col("iv") + F.col("b.dv")})
    rows = rows.withColumn("g", _priced(rows))
    at = lambda n, c="price": F.max(F.when(F.col("b.n") == n, F.col(f"g.{c}")))
    gaps = rows.groupBy("p_partkey").agg((at("mid", "delta") - (at("up") - at("down")) / (2 * h)).alias("delta_gap"), (at("mid", "gamma") - (at("up") - 2 * at("mid") + at("down")) / (h * h)).alias("gamma_gap"), (at("mid", "vega") - (at("more") - at("less")) / 2).alias("vega_gap"))
    return rounded(gaps, 4)


@query(_bs_sql("""select p_partkey, moved::bigint moved, round(moved * (case when "right" = 'CALL' then n1 else n1 - 1 end) + 1e-9, 6) + 0.0 by_delta, round(moved * (case when "right" = 'CALL' then n1 else n1 - 1 end) + moved * moved / 2 * (pdf / (spot * iv * root)) + 1e-9, 6) + 0.0 by_gamma from b3, range(-40, 41) t(moved)"""))
def taylor_moves(spark, d):
    """First and second-order moves of the price over an 81-point grid, for every contract."""
    c = _contracts(spark, d)
    priced = c.withColumn("g", _priced(c)).select("p_partkey", "g.delta", "g.gamma")
    return rounded(O.taylor(priced, F.sequence(F.lit(-40), F.lit(40))).select("p_partkey", "moved", "by_delta", "by_gamma"))


@query(f"""with {CHAIN}, g as (select *, gamma >= 0 and open_interest >= 0 and spot > 0 and ts <= cutoff and oi_ts <= cutoff ok, gamma * open_interest * 100 * spot * spot * 0.01::double v from (select *, timestamp '2026-01-05 19:00:00' + to_days({DAY}) cutoff from chain))
    select session_date, strike, round(coalesce(sum(v) filter (ok and "right" = 'CALL'), 0) / 1e6 + 1e-9, 4) + 0.0 call_gamma, round(-coalesce(sum(v) filter (ok and "right" = 'PUT'), 0) / 1e6 + 1e-9, 4) + 0.0 put_gamma, round((coalesce(sum(v) filter (ok and "right" = 'CALL'), 0) - coalesce(sum(v) filter (ok and "right" = 'PUT'), 0)) / 1e6 + 1e-9, 4) + 0.0 net_gamma,
    coalesce(sum(open_interest) filter (ok and "right" = 'CALL'), 0) call_oi, coalesce(sum(open_interest) filter (ok and "right" = 'PUT'), 0) put_oi, count(*) filter (not ok) rejected, count(*) filter (ok) used from g group by all""")
def gamma_by_strike(spark, d):
    c = chain(spark, d)
    c = c.withColumn("cutoff", F.timestamp_seconds(F.unix_date("session_date") * 86400 + 19 * 3600))
    g = H.gamma_exposure(c, "session_date")
    return rounded(g.withColumns({k: F.col(k) / 1e6 for k in ("call_gamma", "put_gamma", "net_gamma")}), 4)


LATEST = f"with {CHAIN}, latest as (select * from chain qualify row_number() over (partition by session_date, root, expiration, strike, \"right\" order by {NEWEST}) = 1)"


@query(LATEST + """ select session_date, strike, "right", strftime(ts, '%Y-%m-%d %H:%M:%S') seen_at, bid, ask from latest""")
def contract_book(spark, d):
    rows = H.latest_per_contract(chain(spark, d), "session_date")
    return rows.select("session_date", "strike", "right", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "bid", "ask")


@query(f"""with {CHAIN}, h as (select * from chain qualify row_number() over (partition by session_date, root, expiration, strike, "right", date_trunc('minute', ts) order by {NEWEST}) = 1) select session_date, strike, "right", strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') seen_at, bid, ask from h""")
def contract_history(spark, d):
    """Every contract's quotes, the last of each minute, in order."""
    rows = H.sampled_history(chain(spark, d), 1, "session_date")
    return rows.select("session_date", "strike", "right", F.date_format("sample", "yyyy-MM-dd HH:mm").alias("seen_at"), "bid", "ask")


@query(LATEST + """ select session_date, row_number() over (partition by session_date order by strike, "right") as place, strike, "right" from latest""")
def chain_order(spark, d):
    """A session's chain by strike, then right."""
    return H.in_chain_order(H.latest_per_contract(chain(spark, d), "session_date"), "session_date").select("session_date", F.col("place").cast("long").alias("place"), "strike", "right")


@query(LATEST + """ select session_date, strike, "right", strftime(ts, '%Y-%m-%d %H:%M:%S') seen_at from latest qualify date_diff('second', ts, max(ts) over (partition by session_date)) <= 600""")
def bounded_chain(spark, d):
    rows = H.bounded_snapshot(H.latest_per_contract(chain(spark, d), "session_date"), "session_date", seconds=600)
    return rows.select("session_date", "strike", "right", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at")).orderBy("session_date", "strike", "right")


@query(LATEST + """, n as (select session_date, max(ts) spot_ts from latest group by all) select session_date, count(*) observed, count(*) filter (date_diff('second', ts, spot_ts) <= 1200) coherent, count(*) filter (date_diff('second', ts, spot_ts) > 1200) excluded from latest join n using (session_date) group by all""")
def chain_coverage(spark, d):
    rows = H.latest_per_contract(chain(spark, d), "session_date")
    return H.coverage(rows, rows.groupBy("session_date").agg(F.max("ts").alias("spot_ts")), "session_date", seconds=1200)


@query(f"""with {CHAIN}, f as (select session_date, min(ts) m from chain group by all) select session_date, arg_min(strike, row(abs(strike - spot), strike)) strike from chain join f using (session_date) where ts = m group by all""")
def first_strike(spark, d):
    return H.measurement_strike(chain(spark, d), "session_date")


@query(LATEST + """, l as (select session_date, strike, "right", gamma * open_interest v, gamma > 0 usable from latest), s as (select session_date, strike, case when count(*) filter ("right" = 'CALL') = 1 then max(v) filter ("right" = 'CALL' and usable) end as call, case when count(*) filter ("right" = 'PUT') = 1 then max(v) filter ("right" = 'PUT' and usable) end put from l group by all),
    n as (select *, 6025.0::double centre, row_number() over (partition by session_date order by abs(strike - 6025), strike) k from s) select session_date, strike, round(call + 1e-9, 6) + 0.0 as call, round(put + 1e-9, 6) + 0.0 put, round(call + put + 1e-9, 6) + 0.0 net, centre from n where k <= 21""")
def gamma_ladder(spark, d):
    rows = H.latest_per_contract(chain(spark, d), "session_date")
    legs = rows.select("session_date", "strike", "right", (F.col("gamma") * F.col("open_interest")).alias("value"), (F.col("gamma") > 0).alias("usable"), F.lit(6030.0).alias("spot"), F.lit(True).alias("spot_fresh"))
    return rounded(H.ladder(legs, "session_date").select("session_date", "strike", "call", "put", "net", "centre"))


@query(f"""with {CHAIN} select l_orderkey, l_linenumber, l_partkey, abs(date_diff('second', greeks_ts, ts)) <= 60 and abs(date_diff('second', underlying_ts, ts)) <= 60 sync, case when abs(date_diff('second', greeks_ts, ts)) <= 60 and abs(date_diff('second', underlying_ts, ts)) <= 60 then gamma end gamma from chain""")
def greek_coherence(spark, d):
    rows = H.coherent_greeks(chain(spark, d))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("greek_quality") == "synchronous").alias("sync"), "gamma")


@query(f"""with {CHAIN}, s as (select *, ts - to_seconds((l_linenumber * 20 % 90)::int) bid_ts from chain) select l_orderkey, l_linenumber, l_partkey, strftime(bid_ts, '%Y-%m-%d %H:%M:%S') seen_at from s where abs(date_diff('second', bid_ts, ts)) <= 60""")
def side_coherence(spark, d):
    c = chain(spark, d).withColumns({"ask_ts": F.col("ts"), "bid_ts": F.col("ts") - F.make_dt_interval(secs=F.col("l_linenumber") * 20 % 90)})
    return H.side_coherent(c).select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


@query(LATEST + """, oi as (select session_date, root, expiration, strike, "right", max(oi_ts) t, max(open_interest) o from chain group by all)
    select l.session_date, l.strike, l."right", case when oi.t <= l.ts then oi.o end open_interest from latest l left join oi on oi.expiration = l.expiration and oi.strike = l.strike and oi."right" = l."right" """)
def interest_join(spark, d):
    c = chain(spark, d)
    oi = c.groupBy(*H.CONTRACT).agg(F.max("oi_ts").alias("oi_ts"), F.max("open_interest").alias("open_interest"))
    q = H.latest_per_contract(c, "session_date").drop("open_interest", "oi_ts")
    return H.with_open_interest(q, oi).select("session_date", "strike", "right", "open_interest")


@query(f"""with {CHAIN} select count(*) total, count(*) filter (bid > 0 and ask >= bid and l_partkey % 5 <> 0) kept from chain""")
def chain_admission(spark, d):
    """Root, same-day expiry and two-sided filter; every fifth contract has another root."""
    c = chain(spark, d).withColumn("root", F.when(F.col("l_partkey") % 5 == 0, "SPX").otherwise(F.col("root")))
    return c.agg(F.count("*").alias("total")).crossJoin(H.chain_filter(c).agg(F.count("*").alias("kept")))  # one row each


@query("""with l as (select p_partkey // 4 strategy_id, case when p_partkey % 2 = 0 then 'CALL' else 'PUT' end r, 6000.0::double + p_size k, p_retailprice / 100 prem, case when p_partkey % 4 < 2 then 1 else -1 end q from part),
    g as (select *, 5900.0::double + i * (200.0::double / 80) price, i from l, range(0, 81) t(i))
    select strategy_id, i::bigint i, round(any_value(price) + 1e-9, 6) + 0.0 price, round(sum(((case when r = 'CALL' then greatest(0.0::double, price - k) else greatest(0.0::double, k - price) end) - prem) * q * 100) + 1e-9, 4) + 0.0 profit from g group by strategy_id, i""")
def payoff_profile(spark, d):
    legs = X.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 4).alias("strategy_id"), F.when(F.col("p_partkey") % 2 == 0, "CALL").otherwise("PUT").alias("right"), (6000.0 + F.col("p_size")).alias("strike"), (F.col("p_retailprice") / 100).alias("premium"), F.when(F.col("p_partkey") % 4 < 2, 1).otherwise(-1).alias("quantity"))
    p = H.payoff(dealt(legs, "strategy_id", rows=50_000), 5900.0, 6100.0)
    return p.select("strategy_id", F.col("i").cast("long").alias("i"), (F.round(F.col("price") + 1e-9, 6) + F.lit(0.0)).alias("price"), (F.round(F.col("profit") + 1e-9, 4) + F.lit(0.0)).alias("profit"))


@query(f"""with {CHAIN}, q as (select session_date, strike, (extract(hour from ts) * 3600 + extract(minute from ts) * 60)::bigint - 5 * 3600 s, "right" r, bid, ask from chain), c as (select distinct session_date, strike, cutoff from q, (values (45000), (54000)) t(cutoff)),
    x as (select c.session_date, c.strike, c.cutoff, q.s, q.r, q.bid, q.ask from c join q using (session_date, strike) where s <= cutoff and s >= 34200 and s < 57600),
    p as (select session_date, strike, cutoff, s, count(*) filter (r = 'CALL') nc, count(*) filter (r = 'PUT') np, bool_and(bid > 0 and ask >= bid and (ask - bid) / ((ask + bid) / 2) <= 0.25) ok, max(bid) filter (r = 'CALL') cb, max(ask) filter (r = 'CALL') ca, max(bid) filter (r = 'PUT') pb, max(ask) filter (r = 'PUT') pa from x group by all),
    l as (select * from p qualify row_number() over (partition by session_date, strike, cutoff order by s desc) = 1),
    rt as (select min(session_date) - 1 created, 3.6::double rate from chain), r0 as (select l.*, rt.rate from l left join rt on l.session_date - rt.created between 1 and 7),
    r as (select *, 1 / (1 + coalesce(rate, 0) / 100 * ((57600 - s) / 60) / (1440 * 360)) dd, strike + 1.0 pr from r0),
    z as (select *, case when cutoff - s > 3600 then 'stale' when nc <> 1 or np <> 1 then 'unpaired' when not ok then 'invalid quote' else 'ok' end status, (cb + ca) / 2 - (pb + pa) / 2 cp from r)
    select session_date, strike, cutoff::bigint cutoff, s::bigint as second, status, rate is null rate_assumed, case when status = 'ok' then round(cp + strike * dd + 1e-9, 6) + 0.0 end spot, case when status = 'ok' then round(strike + cp / dd + 1e-9, 6) + 0.0 end forward, case when status = 'ok' then round(cb - pa + strike * dd + 1e-9, 6) + 0.0 end low, case when status = 'ok' then round(ca - pb + strike * dd + 1e-9, 6) + 0.0 end high,
    case when status <> 'ok' then 'unavailable' when pr < cb - pa + strike * dd then 'above' when pr > ca - pb + strike * dd then 'below' else 'inside' end comparison from z where false or true""".replace("strike + 1.0 pr", "6001.0::double pr"))
def parity_spot(spark, d):
    c = chain(spark, d)
    sec = (F.hour("ts") * 3600 + F.minute("ts") * 60 - 5 * 3600).cast("long")
    q = c.select("session_date", "strike", "right", "bid", "ask", sec.alias("second"), F.lit(34200).alias("open_second"), F.lit(57600).alias("close_second"), F.explode(F.array(F.lit(45000), F.lit(54000))).alias("cutoff"))
    days = c.select("session_date").distinct()
    prints = days.select("session_date", F.explode(F.sequence(F.lit(34200).cast("long"), F.lit(57600).cast("long"), F.lit(60).cast("long"))).alias("second"), F.lit(6001.0).alias("price"))
    rates = days.agg(F.min("session_date").alias("m")).select(F.date_sub("m", 1).alias("created"), F.lit(3.6).alias("rate"))
    return rounded(H.parity(q, prints, rates, max_age=3600))


@query("""select p_partkey, p_retailprice * 100 * p_size dollars, case when regexp_matches(p_retailprice::varchar, '^-?[0-9]+(\\.[0-9]{1,2})?$') then (p_retailprice::varchar::decimal(38,2) * 100)::bigint end cents, round(p_retailprice * 0.2::double * sqrt(p_size / 525600) + 1e-9, 6) + 0.0 expected_move from part""")
def premium_money(spark, d):
    p = X.table(spark, d, "part")
    text = F.col("p_retailprice").cast("string")
    return p.select("p_partkey", O.premium_dollars(F.col("p_retailprice"), F.col("p_size")).alias("dollars"), C.cents(text).alias("cents"), (F.round(O.expected_move(F.col("p_retailprice"), F.lit(0.2), F.col("p_size")) + 1e-9, 6) + F.lit(0.0)).alias("expected_move"))


@query("""with q as (select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 4 = 0 then 'X' else 'CALL' end r, l_quantity - 3 strike, l_extendedprice / 1000 - 5 bid, l_extendedprice / 1000 - 5 + l_discount - 0.02::double ask from lineitem)
    select l_orderkey, l_linenumber, l_partkey, r = 'CALL' and strike > 0 and bid >= 0 and ask >= bid and ask > 0 valid from q""")
def option_validity(spark, d):
    q = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 4 == 0, "X").otherwise("CALL").alias("right"), (F.col("l_quantity") - 3).alias("strike"), F.lit("2026-01-05").cast("date").alias("expiration"), (F.col("l_extendedprice") / 1000 - 5).alias("bid"), (F.col("l_extendedprice") / 1000 - 5 + F.col("l_discount") - 0.02).alias("ask"))
    return q.select("l_orderkey", "l_linenumber", "l_partkey", C.valid_option().alias("valid"))


@query(LATEST + """, n as (select session_date, max(ts) spot_ts from latest group by all), oi as (select session_date, root, expiration, strike, "right", max(oi_ts) t, max(open_interest) o from chain group by all)
    select l.session_date, l.strike, l."right", case when abs(date_diff('second', greeks_ts, ts)) <= 60 and abs(date_diff('second', underlying_ts, ts)) <= 60 then gamma end gamma, case when oi.t <= l.ts then oi.o end open_interest from latest l join n using (session_date) left join oi on oi.expiration = l.expiration and oi.strike = l.strike and oi."right" = l."right" where date_diff('second', ts, spot_ts) <= 1200""")
def snapshot(spark, d):
    """Latest contracts near the spot's time, with coherent greeks and known interest."""
    c = chain(spark, d)
    oi = c.groupBy(*H.CONTRACT).agg(F.max("oi_ts").alias("oi_ts"), F.max("open_interest").alias("open_interest"))
    q = H.latest_per_contract(c, "session_date").drop("open_interest", "oi_ts")
    near = H.near_spot(q, q.groupBy("session_date").agg(F.max("ts").alias("spot_ts")), "session_date", seconds=1200)
    return H.assembled(near, oi).select("session_date", "strike", "right", "gamma", "open_interest")


@query(f"""with {CHAIN}, {X.bars_sql(X.GAPS)}, pv as (select *, case when minute % 100 = 0 and (symbol = 'S05' or symbol = 'S02' and day(session_date) % 2 = 0) then 'B' else 'A' end provider from bars),
    mx as (select symbol, session_date from pv group by all having count(distinct provider) > 1), tp as (select * from pv anti join mx using (symbol, session_date)),
    ob as (select *, timestamp '2026-01-05 19:00:00' + to_days((session_date - date '2026-01-05')::int) cutoff from chain where ts <= timestamp '2026-01-05 19:00:00' + to_days((session_date - date '2026-01-05')::int)),
    st as (select session_date, arg_min(strike, row(abs(strike - spot), strike)) strike from ob join (select session_date, min(ts) m from ob where "right" = 'CALL' group by all) using (session_date) where ts = m and "right" = 'CALL' group by all),
    qt as (select session_date, count(*) quotes from ob join st using (session_date, strike) where "right" = 'CALL' group by all),
    la as (select * from ob qualify row_number() over (partition by session_date, root, expiration, strike, "right" order by {NEWEST}) = 1),
    ch as (select session_date, count(*) observed, count(*) filter (near) coherent, count(*) filter (near and oi_ts <= cutoff) interest_known from (select *, date_diff('second', ts, max(ts) over (partition by session_date)) <= 600 near from la) group by all),
    ix as (select session_date, count(*) index_bars, arg_max(close, minute) spot, lag(session_date) over (order by session_date) previous_date from tp where symbol = 'S01' group by session_date),
    ct as (select session_date, count(*) filter (symbol = 'S02') fund_bars, count(*) filter (symbol not in ('S01', 'S02')) context_bars from tp group by all), mc as (select session_date, count(*) mixed_symbols from mx group by all)
    select session_date, previous_date, coalesce(index_bars, 0) index_bars, coalesce(fund_bars, 0) fund_bars, coalesce(context_bars, 0) context_bars, coalesce(mixed_symbols, 0) mixed_symbols, round(spot + 1e-9, 6) + 0.0 spot, round(strike + 1e-9, 6) + 0.0 strike, coalesce(quotes, 0) quotes, coalesce(observed, 0) observed, coalesce(coherent, 0) coherent, coalesce(interest_known, 0) interest_known,
    coalesce(observed, 0) - coalesce(coherent, 0) excluded, coalesce(index_bars, 0) > 0 and coalesce(fund_bars, 0) > 0 intraday from ix full join ct using (session_date) full join mc using (session_date) full join qt using (session_date) full join st using (session_date) full join ch using (session_date)""")
def session_assembly(spark, d):
    """What each session is made of, from bars of all providers and all options known at 14:00 Eastern."""
    b, m = X.bars(spark, d), F.col("minute") % 100 == 0
    other = m & ((F.col("symbol") == "S05") | (F.col("symbol") == "S02") & (F.dayofmonth("session_date") % 2 == 0))
    cutoff = F.timestamp_seconds(F.unix_date("session_date").cast("long") * 86400 + 19 * 3600)
    p = S.parts(b.withColumn("provider", F.when(other, "B").otherwise("A")), chain(spark, d), cutoff, "S01", "S02", seconds=600)
    return rounded(S.summary(p))
