"""Bars, windows, session structure, premium and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import direction_label, valid_bar
from ..functions.options_math import expected_move
from ..functions.shared import written
from ..operators import bars as B
from ..operators import ema as E
from ..operators import levels as L
from ..operators import premium as M
from ..operators import readout as R
from . import fixtures as X
from .registry import query, rounded, shown

P = "partition by symbol, session_date order by minute"
BARS = "symbol session_date minute:l"


@query(shown(X.bars_sql() + f""", v as (select *, sum((high + low + close) / 3 * volume) over w / sum(volume) over w vwap from bars window w as ({P} rows unbounded preceding)),
    r as (select *, sum(b) over ({P} rows unbounded preceding) run from (select *, coalesce(minute - lag(minute) over ({P}) <> 1, true)::int b from v)),
    t as (select *, case when count(volume) over w >= 4 then volume / avg(volume) over w end rvol, sign(close - vwap) s from r window w as (partition by symbol, session_date, run order by minute rows between 20 preceding and 1 preceding)),
    u as (select *, lag(s) over ({P}) ps, lag(minute) over ({P}) pm from t),
    f as (select *, coalesce(s = 1 and ps = 1 and minute - pm = 1, false) above, coalesce(s = -1 and ps = -1 and minute - pm = 1, false) below, coalesce(sum((s * ps < 0)::int) over ({P} rows 13 preceding), 0) crosses from u)""", "f", f"{BARS} close:d vwap:d rvol:d above below crosses:l"))
def minute_slice(spark: SparkSession, d: str) -> DataFrame:
    """Scan, bars, validity, regular hours, VWAP, relative volume, confirmation: the flagship."""
    rows = B.relative_volume(B.vwap(B.regular_hours(X.bars(spark, d)).where(valid_bar())))
    return rounded(B.confirmations(rows).select("symbol", "session_date", "minute", "close", "vwap", "rvol", "above", "below", "crosses"))


@query(shown(X.bars_sql(), "bars", f"{BARS} open:d high:d low:d close:d volume:d"))
def tick_bars(spark, d):
    return rounded(X.bars(spark, d))


@query(shown(X.bars_sql(X.DENSE) + f""", g as (select *, count(*) over w = minute - 569 whole, sum(volume) over w v, sum((high + low + close) / 3 * volume) over w pv from bars window w as ({P} rows unbounded preceding)),
    f as (select *, case when whole and v > 0 then pv / v end strict_vwap from g)""", "f", f"{BARS} strict_vwap:d"))
def strict_prefix_vwap(spark, d):
    return rounded(B.strict_vwap(X.bars(spark, d, X.DENSE)).select("symbol", "session_date", "minute", "strict_vwap"))


@query(shown(X.bars_sql() + """, f as (select a.*, a.close / b1.close - 1 return_1, a.close / b5.close - 1 return_5, a.close / b15.close - 1 return_15 from bars a
    left join bars b1 on b1.symbol = a.symbol and b1.session_date = a.session_date and b1.minute = a.minute - 1
    left join bars b5 on b5.symbol = a.symbol and b5.session_date = a.session_date and b5.minute = a.minute - 5
    left join bars b15 on b15.symbol = a.symbol and b15.session_date = a.session_date and b15.minute = a.minute - 15)""", "f", f"{BARS} return_1:d return_5:d return_15:d"))
def offset_returns(spark, d):
    return rounded(B.returns(X.bars(spark, d)).select("symbol", "session_date", "minute", "return_1", "return_5", "return_15"))


@query(shown(X.bars_sql(X.DENSE) + f""", g as (select *, case when minute - lag(minute) over w = 1 then close / lag(close) over w - 1 end r from bars window w as ({P})),
    f as (select *, case when count(r) over w = 30 then stddev_pop(r) over w end volatility from g window w as ({P} range between 29 preceding and current row))""", "f", f"{BARS} volatility:d"))
def return_volatility(spark, d):
    return rounded(B.volatility(X.bars(spark, d, X.DENSE)).select("symbol", "session_date", "minute", "volatility"))


TEN = """, ten as (select symbol, session_date, ((minute - 570) // 10)::int bucket, arg_min(open, minute) as open, max(high) high, min(low) low, arg_max(close, minute) as close, sum(volume) volume, count(*) = 10 complete from bars where minute >= 570 group by all)"""


@query(shown(X.bars_sql() + TEN, "ten", "symbol session_date bucket:l open:d high:d low:d close:d volume:d complete"))
def ten_minute_bars(spark, d):
    return rounded(B.ten_minute(X.bars(spark, d)).select("symbol", "session_date", "bucket", "open", "high", "low", "close", "volume", "complete"))


@query(shown(X.bars_sql(X.GAPS) + """, dup as (select * from bars union all select * from bars where minute % 50 = 0), f as (select symbol, session_date, minute, count(*) over (partition by symbol, session_date, minute) = 1 single from dup)""", "f", f"{BARS} single"))
def duplicate_minutes(spark, d):
    b = X.bars(spark, d)
    return rounded(B.single_minutes(b.unionByName(b.where("minute % 50 = 0"))).select("symbol", "session_date", "minute", "single"))


@query(shown(X.levels_sql(), "levels", "symbol session_date previous_date prior_high:d prior_low:d prior_close:d pm_high:d pm_low:d"))
def session_levels(spark, d):
    return rounded(L.with_previous(L.session_ranges(X.bars(spark, d, X.PRE))))


REGIME = """case when prior_high > prior_low and pm_high >= pm_low then case when pm_low > prior_high then 'GAP-UP' when pm_high < prior_low then 'GAP-DOWN' when pm_high > prior_high and pm_low < prior_low then 'TWO-SIDED'
    when pm_high > prior_high then 'EXT-UP' when pm_low < prior_low then 'EXT-DOWN' else 'INSIDE' end end"""


@query(f"""with o as (select o_orderpriority symbol, o_orderdate::date session_date, max(o_totalprice) high, min(o_totalprice) low, count(*) n from orders group by all),
    l as (select *, lag(high) over w prior_high, lag(low) over w prior_low, high * 1.0 pm_high, low * 1.0 pm_low from o window w as (partition by symbol order by session_date))
    select symbol, session_date, {REGIME} regime from l""")
def daily_regime(spark, d):
    """Regime of each day's range against the day before, by order priority."""
    o = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("session_date")).agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.lit(None).cast("double").alias("close"), F.max("o_totalprice").alias("pm_high"), F.min("o_totalprice").alias("pm_low"))
    return L.with_previous(o).select("symbol", "session_date", L.regime(F.col("prior_high"), F.col("prior_low"), F.col("pm_high"), F.col("pm_low")).alias("regime"))


@query(shown(X.levels_sql() + f""", b as (select bars.*, prior_high, prior_low, pm_high, pm_low, (pm_high - pm_low) * 0.025 tol, pm_high - pm_low span from bars join levels using (symbol, session_date) where minute >= 570),
    c as (select *, sum((close > pm_high)::int) over k = 2 up, sum((close < pm_low)::int) over k = 2 down, high >= pm_high - tol top, low <= pm_low + tol bot from b window k as ({P} rows 1 preceding)),
    e as (select *, (top and not coalesce(lag(top) over w, false))::int te, (bot and not coalesce(lag(bot) over w, false))::int le from c window w as ({P})),
    g as (select *, sum(te) over u tops, sum(le) over u lows, min(case when up or down then minute end) over u bm, span / (prior_high - prior_low) * 100 pmr from e window u as ({P} rows unbounded preceding)),
    h as (select *, last_value(case when up or down then case when up then 'bull' else 'bear' end end ignore nulls) over ({P} rows unbounded preceding) ls, first_value(case when up or down then case when up then 'bull' else 'bear' end end ignore nulls) over ({P} rows unbounded preceding) bs from g),
    f as (select *, case when pm_high is null or pm_low is null then 'developing' when pmr <= 30 and bm < 600 then 'double distribution' when pmr > 30 and pmr < 70 and bm >= 600 then 'expanded typical' when bm is null and tops >= 2 and lows >= 2 then 'trading range' when bm is null and pmr >= 70 then 'contained' else 'indecisive' end day_type from h),
    s as (select *, case when day_type in ('double distribution', 'expanded typical') then bs else 'neutral' end side from f)""", "s", f"{BARS} pmr:d tops:l lows:l side day_type"))
def day_type(spark, d):
    b = X.bars(spark, d, X.PRE)
    return rounded(L.day_types(b, L.with_previous(L.session_ranges(b))))


MAPPED = """, m as (select symbol, session_date, unnest(['prior high', 'prior low', 'prior close', 'premarket high', 'premarket low', 'sigma up', 'sigma down']) as name, unnest([prior_high, prior_low, prior_close, pm_high * 2, pm_low * 2, prior_close + prior_close * 0.2 * sqrt(390 / 525600), prior_close - prior_close * 0.2 * sqrt(390 / 525600)]) price from levels)"""


@query(shown(X.levels_sql() + MAPPED + ", f as (select * from m where price is not null)", "f", "symbol session_date name price:d"))
def price_levels(spark, d):
    lv = L.with_previous(L.session_ranges(X.bars(spark, d, X.PRE)))
    return rounded(L.mapped_levels(lv, F.lit(2), expected_move(F.col("prior_close"), F.lit(0.2), F.lit(390))).drop("nth", "low", "high"))


#: Points and zones of a session as intervals.
INTERVALS = MAPPED.replace("unnest([", "unnest(range(7)) nth, unnest([", 1) + """, iv as (select symbol, session_date, nth, name, price low, price high from m where price is not null
    union all select symbol, session_date, 10 + z, ['high zone', 'low zone'][z + 1], [least(prior_high, pm_high), least(prior_low, pm_low)][z + 1], [greatest(prior_high, pm_high), greatest(prior_low, pm_low)][z + 1] from levels, range(2) t(z) where prior_high is not null and pm_high is not null and prior_low is not null and pm_low is not null)"""


def _intervals(b: DataFrame) -> DataFrame:
    lv = L.with_previous(L.session_ranges(b))
    return L.mapped_levels(lv, F.lit(2), expected_move(F.col("prior_close"), F.lit(0.2), F.lit(390))).drop("price").unionByName(L.zones(lv).withColumn("nth", F.col("nth") + 10))


@query(shown(X.levels_sql() + INTERVALS + """, f as (select b.symbol, b.session_date, b.minute, arg_min(l.name, row(l.low, l.nth)) filter (l.low > b.close) above, arg_min(l.name, row(-l.high, l.nth)) filter (l.high < b.close) below,
    coalesce(string_agg(l.name, ',' order by l.nth) filter (l.low <= b.close and l.high >= b.close), '') overlapping, count(*) filter (l.low - 500 <= b.close and l.high + 500 >= b.close) confluence from bars b left join iv l on l.symbol = b.symbol and l.session_date = b.session_date group by all)""", "f", f"{BARS} above below overlapping confluence:l"))
def level_lookup(spark, d):
    """Each price against its session's points and zones: strictly above, strictly below, overlapping, near."""
    b = X.bars(spark, d, X.PRE)
    return rounded(L.around(b, _intervals(b), near=500.0).drop("close"))


@query(shown(X.premium_sql(), "premium", f"{BARS} mid:d extrinsic:d spread:d valid baseline_bars:l z:d slope:d iv:d"))
def premium_points(spark, d):
    return rounded(M.premium_series(X.quotes(spark, d)).select("symbol", "session_date", "minute", "mid", "extrinsic", "spread", "valid", "baseline_bars", "z", "slope", "iv"))


POSTURE = f""", z0 as (select *, row_number() over ({P})::double k from premium where z is not null),
    z1 as (select symbol, session_date, minute, max(z) over pr prior_high, min(z) over pr prior_low, case when count(z) over t >= 5 then round(regr_slope(z, k) over t, 8) + 0.0 else 0 end trend, min(z) over r30 recent_low from z0
        window pr as ({P} rows between 29 preceding and 3 preceding), t as ({P} rows 9 preceding), r30 as ({P} rows 29 preceding)),
    posture as (select p.*, z1.prior_high, z1.prior_low, z1.trend, z1.recent_low, case when not (valid and z is not null and slope is not null) then 'unknown' when coalesce(z1.prior_high >= 2 and z > 0 and trend < -0.025, false) then 'positive-decay'
        when coalesce(z1.prior_low <= -2 and z < 0 and trend > 0.025, false) then 'negative-recovery' when slope > 0.005 then 'expansion' when slope < -0.005 then 'compression' else 'balanced' end phase from premium p left join z1 using (symbol, session_date, minute))"""


@query(shown(X.premium_sql() + POSTURE, "posture", f"{BARS} prior_high:d prior_low:d trend:d phase"))
def premium_posture(spark, d):
    return rounded(M.postures(M.premium_series(X.quotes(spark, d))).select("symbol", "session_date", "minute", "prior_high", "prior_low", "trend", "phase"))


def _pattern_rows(spark, d):
    """Posture of each minute with made-up levels that give every regime, and confirmations of the underlying against a made-up VWAP."""
    p = M.postures(M.premium_series(X.quotes(spark, d))).drop("prior_high", "prior_low")
    nth = F.col("minute") % 3
    p = p.withColumns({"vwap": F.lit(30000.0), "regime": F.when(nth == 0, "INSIDE").when(nth == 1, "EXT-UP").otherwise("EXT-DOWN"), "pm_high": F.lit(40000.0), "pm_low": F.lit(20000.0), "prior_high": F.lit(45000.0), "prior_low": F.lit(25000.0)})
    return M.direction_gate(B.confirmations(p))


PATTERN = X.premium_sql() + POSTURE + f""", k0 as (select symbol, session_date, minute, close, z, slope, phase, recent_low, valid, sign(close - 30000.0::double) s, case minute % 3 when 0 then 'INSIDE' when 1 then 'EXT-UP' else 'EXT-DOWN' end regime from posture),
    k1 as (select *, lag(s) over w ps, lag(minute) over w pm from k0 window w as ({P})),
    k2 as (select *, coalesce(s = 1 and ps = 1 and minute - pm = 1, false) above, coalesce(s = -1 and ps = -1 and minute - pm = 1, false) below, coalesce(sum((s * ps < 0)::int) over ({P} rows 13 preceding), 0) crosses from k1),
    k3 as (select *, case when crosses < 4 and phase not in ('positive-decay', 'negative-recovery') and above and z >= 1 then 'long' when crosses < 4 and phase not in ('positive-decay', 'negative-recovery') and below and z <= -1 then 'short' else 'neutral' end direction,
        case when z is null then null when regime = 'INSIDE' then case when close > 40000 and z > 0 and slope > 0 then 'INSIDE-RISE' when close < 20000 and z < 0 and slope < 0 then 'INSIDE-FALL' when close < 20000 and phase = 'negative-recovery' then 'INSIDE-SELLING' end
        when regime = 'EXT-UP' then case when phase = 'positive-decay' then 'EXT-UP-COOLING' when recent_low < -1 and z > 0 and above then 'EXT-UP-REBOUND' when z < -1 and slope < 0 and close < 45000 then 'EXT-UP-FAILURE' end
        else case when z < -2 and close < 25000 then 'EXT-DOWN-SELLING' when phase = 'negative-recovery' and close > 25000 then 'EXT-DOWN-REBOUND' when z >= -2 and z < 0 and slope >= 0 and above then 'EXT-DOWN-RECOVERY' end end code from k2),
    k4 as (select *, case when code in ('INSIDE-RISE', 'EXT-UP-REBOUND', 'EXT-DOWN-REBOUND', 'EXT-DOWN-RECOVERY') then 'long' when code = 'EXT-UP-COOLING' then 'both' when code is not null then 'short' end cs,
        case when code in ('EXT-UP-COOLING', 'EXT-UP-REBOUND', 'EXT-DOWN-REBOUND') then 'anticipation' when code is not null then 'momentum' end ck, case when regime = 'EXT-DOWN' then 25000 else 45000 end b from k3)"""


@query(shown(PATTERN, "k4", f"{BARS} regime direction code"))
def candidates(spark, d):
    return rounded(M.active_candidate(_pattern_rows(spark, d)).select("symbol", "session_date", "minute", "regime", "direction", "code"))


@query(shown(PATTERN + f""", x0 as (select *, sum((close > 25000)::int) over w2 u2, sum((close < 25000)::int) over w2 d2, sum((close > 45000)::int) over w2 u4, sum((close < 45000)::int) over w2 d4, coalesce(minute - pm = 1, false) adj,
    max((close <= 25000)::int) over wb = 1 wd2, max((close >= 25000)::int) over wb = 1 wu2, max((close <= 45000)::int) over wb = 1 wd4, max((close >= 45000)::int) over wb = 1 wu4 from k4 window w2 as ({P} rows 1 preceding), wb as ({P} rows between 11 preceding and 2 preceding)),
    x1 as (select *, case ck when 'momentum' then direction <> 'neutral' and (cs = 'both' or cs = direction) when 'anticipation' then adj and case when cs in ('short', 'both') then case when b = 25000 then d2 = 2 and wu2 else d4 = 2 and wu4 end else case when b = 25000 then u2 = 2 and wd2 else u4 = 2 and wd4 end end end passed0 from x0),
    x2 as (select *, coalesce(passed0, false) passed from x1)""", "x2", f"{BARS} code passed"))
def execution_checks(spark, d):
    rows = _pattern_rows(spark, d)
    rows = M.execution(M.active_candidate(rows.withColumns({"prior_low": F.lit(25000.0), "prior_high": F.lit(45000.0)})))
    return rounded(rows.select("symbol", "session_date", "minute", "code", "passed"))


@query(shown(PATTERN + f""", y0 as (select *, case when valid then code end c from k4), y1 as (select *, (c is distinct from lag(c) over ({P}))::int ch, row_number() over ({P}) rn from y0), y2 as (select *, sum(case when rn = 1 then (c is not null)::int else ch end) over ({P} rows unbounded preceding) run from y1 ),
    y3 as (select symbol, session_date, run, c code, min(minute) first_minute, max(minute) last_minute, count(*) samples from y2 where c is not null group by all),
    y4 as (select *, row_number() over (partition by symbol, session_date order by first_minute) episode, lag(code) over (partition by symbol, session_date order by first_minute) previous_code from y3)""", "y4", "symbol session_date episode:l code first_minute:l last_minute:l samples:l previous_code"))
def playbook_episodes(spark, d):
    rows = M.active_candidate(_pattern_rows(spark, d)).withColumn("fresh", F.col("valid"))
    return rounded(M.episodes(rows))


@query(shown(X.premium_sql() + f""", v as (select symbol, session_date, minute, close price, extrinsic from premium where valid),
    n as (select *, min(price) over w lo, max(price) over w hi, count(*) over w c, lead(minute, 2) over o - lag(minute, 2) over o sp from v window w as ({P} rows between 2 preceding and 2 following), o as ({P})),
    pv as (select symbol, session_date, minute, price, extrinsic, 'bullish' kind from n where c = 5 and sp = 4 and price <= lo union all select symbol, session_date, minute, price, extrinsic, 'bearish' from n where c = 5 and sp = 4 and price >= hi),
    pp as (select *, lag(minute) over k am, lag(price) over k ap, lag(extrinsic) over k ae from pv window k as (partition by symbol, session_date, kind order by minute)),
    pr as (select * from pp where minute - am between 5 and 40 and price > ap and extrinsic <= ae),
    tr as (select pr.symbol, pr.session_date, pr.kind, pr.am, pr.minute bm, case when pr.kind = 'bullish' then max(v.price) else min(v.price) end trig from pr join v on v.symbol = pr.symbol and v.session_date = pr.session_date and v.minute > pr.am and v.minute < pr.minute group by pr.symbol, pr.session_date, pr.kind, pr.am, pr.minute),
    cf as (select tr.*, min(v.minute) confirmed_minute from tr left join v on v.symbol = tr.symbol and v.session_date = tr.session_date and v.minute > tr.bm + 2 and case when tr.kind = 'bullish' then v.price > trig else v.price < trig end group by tr.symbol, tr.session_date, tr.kind, tr.am, tr.bm, tr.trig),
    f as (select symbol, session_date, kind, am first_minute, bm second_minute, trig as trigger_price, confirmed_minute from cf qualify row_number() over (partition by symbol, session_date order by bm desc, am desc, kind) <= 6)""", "f", "symbol session_date kind first_minute:l second_minute:l trigger_price:d confirmed_minute:l"))
def premium_divergence(spark, d):
    p = M.premium_series(X.quotes(spark, d)).where("valid").select("symbol", "session_date", "minute", F.col("close").alias("price"), "extrinsic")
    return rounded(M.divergences(p).withColumnRenamed("trigger", "trigger_price"))


def ema_sql(close: int, open: int = 570) -> str:  # noqa: A002
    """Buckets, fold and episodes of a tape named bars as a recursion over buckets: one open episode of either side at most."""
    def judged(me: str, other: str, sign: str, wrong: str) -> str:
        return f"""case when {me}_s = 'watching' or {me}_s = 'confirmed' then case when not ok then 'cancelled' when {me}_s = 'confirmed' and c {wrong} ne then 'invalidated'
            when {me}_s = 'watching' and x_{other} then 'cancelled' when {me}_s = 'watching' and e - {me}_c between 10 and 30 and lo <= pe and hi >= pe and c {sign} ne then 'confirmed'
            when {me}_s = 'watching' and e - {me}_c >= 30 then 'expired' else {me}_s end end {me}_j"""

    def side(me: str) -> str:
        opened = f"(x_{me} and coalesce({me}_j not in ('watching', 'confirmed'), true))"
        held = f"{me}_j in ('watching', 'confirmed')"
        return f"""case when {opened} then 'watching' when {held} then {me}_j end {me}_s, case when {opened} then e when {held} then {me}_c end {me}_c, case when {opened} then null when {held} and {me}_j <> {me}_s then e when {held} then {me}_r end {me}_r,
            case when {opened} then c when {held} then {me}_x end {me}_x, case when {opened} then null when {held} and {me}_j <> {me}_s then c when {held} then {me}_p end {me}_p, case when {opened} then null when {held} and {me}_j <> {me}_s then pe when {held} then {me}_f end {me}_f,
            case when {opened} then n when {held} then {me}_n end {me}_n, case when {me}_j not in ('watching', 'confirmed') then {{'side': '{me}', 'status': {me}_j, 'crossed': {me}_c, 'retested': {me}_r, 'ended': e, 'cross_price': {me}_x, 'confirm_price': {me}_p, 'reference': {me}_f, 'nth': {me}_n}} end {me}_o"""

    state = lambda me: f"null::varchar {me}_s, null::int {me}_c, null::int {me}_r, null::double {me}_x, null::double {me}_p, null::double {me}_f, null::int {me}_n, null::struct(side varchar, status varchar, crossed int, retested int, ended int, cross_price double, confirm_price double, reference double, nth int) {me}_o"
    names = lambda me: ", ".join(f"{me}_{k}" for k in "scrxpfno")
    return f""", cal as (select symbol, session_date, lag(session_date) over (partition by symbol order by session_date) prev, max(minute) filter (minute >= {open}) last from bars group by symbol, session_date),
    made as (select symbol, session_date, ((minute - {open}) // 10)::int b, max(high) hi, min(low) lo, arg_max(close, minute) c, count(*) = 10 and count(distinct minute) = 10 ok from bars where minute >= {open} group by all),
    steps as (select k.*, row_number() over (partition by symbol, session_date order by day, b) i from (select cal.symbol, cal.session_date, 0 as day, t.b::int b from cal join cal p on p.symbol = cal.symbol and p.session_date = cal.prev, lateral (select unnest(range(0, (p.last - {open}) // 10 + 1)) b) t
        union all select symbol, session_date, 1, t.b::int from cal, range(0, ({close} - {open}) // 10) t(b)) k),
    tape as (select s.symbol, s.session_date, s.day, s.b, s.i, {open} + (s.b + 1) * 10 e, hi, lo, c, coalesce(ok, false) ok from steps s join cal using (symbol, session_date) left join made m on m.symbol = s.symbol and m.b = s.b and m.session_date = case when s.day = 1 then s.session_date else cal.prev end),
    fold as (select symbol, session_date, 0::bigint i, 0 as day, -1 b, null::double ema, []::double[] seeds, null::double pc, null::double pe, 0 pb, 0 n, {state('bull')}, {state('bear')} from cal
        union all select symbol, session_date, i, day, b, ne, case when not ok then [] when ema is null then list_append(seeds, c) else seeds end, case when ok then c end, ne, case when not ok then 0 when day = 0 then pb + 1 else pb end,
            n + case when (x_bull and coalesce(bull_j not in ('watching', 'confirmed'), true)) or (x_bear and coalesce(bear_j not in ('watching', 'confirmed'), true)) then 1 else 0 end, {side('bull')}, {side('bear')}
        from (select *, {judged('bull', 'bear', '>', '<')}, {judged('bear', 'bull', '<', '>')} from (select *, coalesce(day = 1 and pc <= pe and c > ne, false) x_bull, coalesce(day = 1 and pc >= pe and c < ne, false) x_bear from
            (select t.symbol, t.session_date, t.i, t.day, t.b, t.e, t.hi, t.lo, t.c, t.ok, f.ema, f.seeds, f.pc, f.pe, f.pb, f.n, {names('f.bull')}, {names('f.bear')},
                case when not t.ok then null when f.ema is not null then f.ema + 2.0::double / 9 * (t.c - f.ema) when len(f.seeds) = 7 then (list_sum(f.seeds) + t.c) / 8 end ne from fold f join tape t on t.symbol = f.symbol and t.session_date = f.session_date and t.i = f.i + 1)))),
    over as (select symbol, session_date, bull_o o from fold where bull_o is not null union all select symbol, session_date, bear_o from fold where bear_o is not null),
    lastly as (select * from fold qualify row_number() over (partition by symbol, session_date order by i desc) = 1),
    open_bull as (select symbol, session_date, 'bull' side, case bull_s when 'watching' then 'expired' else bull_s end status, bull_c crossed, bull_r retested, case bull_s when 'watching' then {close} end ended, bull_x cross_price, bull_p confirm_price, bull_f reference, bull_n nth from lastly where bull_s is not null),
    open_bear as (select symbol, session_date, 'bear' side, case bear_s when 'watching' then 'expired' else bear_s end status, bear_c crossed, bear_r retested, case bear_s when 'watching' then {close} end ended, bear_x cross_price, bear_p confirm_price, bear_f reference, bear_n nth from lastly where bear_s is not null),
    eps as (select symbol, session_date, nth, case side when 'bull' then 'bullish' else 'bearish' end side, status, crossed, retested, ended, cross_price, confirm_price, reference from
        (select symbol, session_date, o.nth nth, o.side side, o.status status, o.crossed crossed, o.retested retested, o.ended ended, o.cross_price cross_price, o.confirm_price confirm_price, o.reference reference from over
        union all select symbol, session_date, nth, side, status, crossed, retested, ended, cross_price, confirm_price, reference from open_bull union all select symbol, session_date, nth, side, status, crossed, retested, ended, cross_price, confirm_price, reference from open_bear))"""


def recursive(sql: str) -> str:
    """The same with, so that one of its tables may read itself."""
    return sql.replace("with ", "with recursive ", 1)


EPISODE = "symbol session_date nth:l side status crossed:l retested:l ended:l cross_price:d confirm_price:d reference:d"


def _folded(spark, d, shape=X.GAPS, close=960):
    return E.fold(E.calendar_buckets(X.bars(spark, d, shape), close_at=close))


@query(recursive(shown(X.bars_sql(X.DENSE) + ema_sql(700) + ", f as (select symbol, session_date, b bucket, ema from fold where day = 1 and pc is not null)", "f", "symbol session_date bucket:l ema:d")))
def ema_seeded(spark, d):
    """EMA from a seed of eight closes, which the previous session's buckets give where there are any."""
    return rounded(E.ema_points(_folded(spark, d, X.DENSE, 700)))


@query(recursive(shown(X.bars_sql(X.GAPS) + ema_sql(960), "eps", EPISODE)))
def ema_retest_episodes(spark, d):
    """Cross and retest episodes on a tape with gaps: buckets without all minutes, or without any, start the EMA anew."""
    return rounded(E.ema_episodes(_folded(spark, d)))


@query(recursive(shown(X.bars_sql(X.DENSE) + ema_sql(700), "eps", EPISODE)))
def ema_retest_whole_tape(spark, d):
    """The same where every minute is there, session after session."""
    return rounded(E.ema_episodes(_folded(spark, d, X.DENSE, 700)))


@query(recursive(shown(X.bars_sql(X.DENSE) + ema_sql(720) + f""", g as (select symbol, session_date, unnest(range(540, 720))::int as minute from cal),
    ev as (select symbol, session_date, side, nth, unnest([crossed, retested, ended]) - 1 tm, unnest(['watching', 'confirmed', status]) what, unnest([0, 1, 2]) rk from eps),
    ba as (select symbol, session_date, side, tm, arg_max(what, (nth, rk)) what from ev where tm is not null group by all),
    pt as (select symbol, session_date, e - 1 tm, e, ema, case when ok then c end c, case when fold.ok then least(len(seeds), 8) else 0 end warm, pb, ok from (select f.*, t.ok ok, t.e e, t.c c from fold f join tape t using (symbol, session_date, i)) fold where day = 1),
    w0 as (select symbol, session_date, ema, least(len(seeds), 8) warm, pb from fold where day = 0 qualify row_number() over (partition by symbol, session_date order by i desc) = 1),
    f0 as (select g.*, b.minute latest_minute, p.tm is not null any_bucket, coalesce(p.ok, true) whole, case when p.tm is null then w0.ema else p.ema end ema, case when p.tm is null then w0.warm else p.warm end warm, case when p.tm is null then w0.pb else p.pb end prior_bars, q.e latest_end, q.c latest_close, coalesce(u.what, 'idle') bullish, coalesce(v.what, 'idle') bearish
        from g left join w0 using (symbol, session_date) asof left join (select * from bars where minute >= 570) b on b.symbol = g.symbol and b.session_date = g.session_date and b.minute <= g.minute asof left join pt p on p.symbol = g.symbol and p.session_date = g.session_date and p.tm <= g.minute
        asof left join (select * from pt where ok) q on q.symbol = g.symbol and q.session_date = g.session_date and q.tm <= g.minute asof left join (select * from ba where side = 'bullish') u on u.symbol = g.symbol and u.session_date = g.session_date and u.tm <= g.minute
        asof left join (select * from ba where side = 'bearish') v on v.symbol = g.symbol and v.session_date = g.session_date and v.tm <= g.minute),
    f as (select *, minute - latest_minute age, ema is not null and prior_bars > 0 seeded_from_prior, case when minute < 570 then 'premarket' when latest_minute is null then 'unavailable' when minute - latest_minute > 2 then 'stale' when not whole then 'unavailable' when latest_end is null or ema is null then 'warming' else 'ready' end status from f0)""",
    "f", f"{BARS} status ema:d latest_end:l latest_close:d warm:l prior_bars:l seeded_from_prior latest_minute:l age:l bullish bearish")))
def ema_clock(spark, d):
    """What is known of the EMA and its patterns at every minute, from half an hour before the open to the close; the tape ends twenty minutes before that."""
    b = X.bars(spark, d, X.DENSE)
    return rounded(E.clock(b, E.fold(E.calendar_buckets(b, close_at=720)), close_at=720))


@query(shown(X.bars_sql(X.GAPS) + f""", g as (select distinct symbol, session_date, (570 + m * 15)::int as minute from bars, range(0, 26) t(m)),
    f as (select g.*, b.close, b.minute as_of from g asof left join bars b on b.symbol = g.symbol and b.session_date = g.session_date and b.minute <= g.minute)""", "f", f"{BARS} close:d as_of:l"))
def as_of_close(spark, d):
    b = X.bars(spark, d)
    grid = b.select("symbol", "session_date").distinct().withColumn("minute", F.explode(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda m: (570 + m * 15).cast("int"))))
    return rounded(B.latest_as_of(grid, b, ["symbol", "session_date"], "minute", ["close"]))


@query(shown(X.bars_sql() + """, f as (select distinct symbol, session_date, minute from (select symbol, session_date, minute from bars where symbol = 'S01' union all select symbol, session_date, minute from bars where symbol = 'S02' union all select 'S01', session_date, minute from bars where symbol = 'S03'))""", "f", BARS))
def sample_grid(spark, d):
    b = X.bars(spark, d)
    return rounded(M.sample_minutes(b.where("symbol = 'S01'"), b.where("symbol = 'S02'"), b.where("symbol = 'S03'").withColumn("symbol", F.lit("S01"))))


@query(shown(X.premium_sql() + POSTURE + f""", l as (select *, case when z > 0 then 'above baseline' when z < 0 then 'below baseline' when z = 0 then 'at baseline' else 'no baseline' end label, last_value(case when valid then minute end ignore nulls) over ({P} rows unbounded preceding) lv from posture),
    f as (select *, coalesce(minute - lv > 2, true) stale from l)""", "f", f"{BARS} close:d z:d slope:d phase label stale"))
def minute_readout(spark, d):
    """One row a minute: premium reading, phase, label and staleness of the last valid premium."""
    p = M.postures(M.premium_series(X.quotes(spark, d)))
    w = B.by_minute().rowsBetween(B.Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("valid"), F.col("minute"))).over(w)
    return rounded(p.select("symbol", "session_date", "minute", "close", "z", "slope", "phase", direction_label(F.col("z")).alias("label"), F.coalesce(F.col("minute") - last > 2, F.lit(True)).alias("stale")))


@query(shown(X.premium_sql(X.GAPS) + """, gr as (select session_date, unnest(range(570, 960))::int as minute from (select distinct session_date from bars)),
    i as (select session_date, minute, 'p' n from premium where symbol = 'S00' and valid union all select session_date, minute, 'f' from bars where symbol = 'S02' union all select session_date, minute, 'x' from bars where symbol = 'S01'),
    f as (select gr.session_date, gr.minute, max(i.minute) filter (n = 'p') premium_as_of, max(i.minute) filter (n = 'f') fund_as_of, max(i.minute) filter (n = 'x') index_as_of from gr left join i on i.session_date = gr.session_date and i.minute <= gr.minute group by 1, 2),
    g as (select 'S00' symbol, *, coalesce(minute - premium_as_of > 2, true) or coalesce(minute - fund_as_of > 2, true) or coalesce(minute - index_as_of > 2, true) stale from f)""", "g", f"{BARS} premium_as_of:l fund_as_of:l index_as_of:l stale"))
def input_staleness(spark, d):
    """Each minute of each session: how old premium, fund and index are, and whether any is over two minutes old."""
    b = X.bars(spark, d)
    one = lambda s, rows: rows.where(F.col("symbol") == s).withColumn("symbol", F.lit("S00"))
    grid = b.select(F.lit("S00").alias("symbol"), "session_date").distinct().withColumn("minute", F.explode(F.sequence(F.lit(570), F.lit(959))))
    premium = M.premium_series(X.quotes(spark, d, X.GAPS)).where("valid")
    return rounded(M.stale_inputs(grid, {"premium": one("S00", premium), "fund": one("S02", b), "index": one("S01", b)}))


READOUT = X.premium_sql(X.PRE) + POSTURE + X.levels_sql(X.PRE)[len(X.bars_sql(X.PRE)) :] + f""", lv as (select *, {REGIME} regime from levels where symbol = 'S02'),
    v0 as (select bars.*, regime, prior_high, prior_low, pm_high, pm_low, case regime when 'EXT-DOWN' then prior_low else prior_high end bd, sum((high + low + bars.close) / 3 * volume) over w / sum(volume) over w vwap, first_value(bars.open) over w first_open from bars join lv using (symbol, session_date) where minute >= 570 window w as ({P} rows unbounded preceding)),
    v1 as (select *, sign(close - vwap) s, minute - lag(minute) over w = 1 adj from v0 window w as ({P})),
    v2 as (select *, lag(s) over w ps, coalesce(adj, false) and sum((close < bd)::int) over w2 = 2 and max((close >= bd)::int) over wb = 1 broke_down, coalesce(adj, false) and sum((close > bd)::int) over w2 = 2 and max((close <= bd)::int) over wb = 1 broke_up from v1
        window w as ({P}), w2 as ({P} rows 1 preceding), wb as ({P} rows between 11 preceding and 2 preceding)),
    v3 as (select *, coalesce(s = 1 and ps = 1 and adj, false) above, coalesce(s = -1 and ps = -1 and adj, false) below, coalesce(sum((s * ps < 0)::int) over ({P} rows 13 preceding), 0) crosses from v2),
    d0 as (select v3.*, (pm_high - pm_low) * 0.025 tol, (pm_high - pm_low) / (prior_high - prior_low) * 100 pmr, sum((close > pm_high)::int) over k = 2 up, sum((close < pm_low)::int) over k = 2 down from v3 window k as ({P} rows 1 preceding)),
    d1 as (select *, (high >= pm_high - tol and not coalesce(lag(high) over w >= pm_high - tol, false))::int te, (low <= pm_low + tol and not coalesce(lag(low) over w <= pm_low + tol, false))::int le from d0 window w as ({P})),
    d2 as (select *, sum(te) over u tops, sum(le) over u lows, min(case when up or down then minute end) over u bm, first_value(case when up or down then case when up then 'bull' else 'bear' end end ignore nulls) over u bs from d1 window u as ({P} rows unbounded preceding)),
    d3 as (select *, case when pm_high is null or pm_low is null then 'developing' when pmr <= 30 and bm < 600 then 'double distribution' when pmr > 30 and pmr < 70 and bm >= 600 then 'expanded typical' when bm is null and tops >= 2 and lows >= 2 then 'trading range' when bm is null and pmr >= 70 then 'contained' else 'indecisive' end day_type from d2),
    fd as (select *, case when day_type in ('double distribution', 'expanded typical') then bs else 'neutral' end day_side from d3),
    xd as (select session_date, minute, close, first_value(open) over (partition by session_date order by minute) anchor from bars where symbol = 'S01' and minute >= 570),
    pd as (select *, first_value(iv ignore nulls) over ({P} rows unbounded preceding) oiv from posture where symbol = 'S00'),
    gr as (select session_date, unnest(range(570, 960))::int as minute from (select distinct session_date from bars where symbol in ('S00', 'S01', 'S02'))),
    r0 as (select gr.*, xd.minute xm, xd.close price, anchor from gr asof left join xd on xd.session_date = gr.session_date and xd.minute <= gr.minute),
    r1 as (select r0.*, fd.minute fm, fd.close, first_open, vwap, regime, prior_high, prior_low, pm_high, pm_low, above, below, crosses, broke_down, broke_up, day_type, day_side from r0 asof left join fd on fd.session_date = r0.session_date and fd.minute <= r0.minute),
    r2 as (select r1.*, pd.minute pm, z, slope, phase, recent_low, oiv from r1 asof left join pd on pd.session_date = r1.session_date and pd.minute <= r1.minute),
    r3 as (select 'S00' symbol, *, close fund_price, anchor / first_open ratio, case when anchor > 0 and oiv > 0 then anchor * oiv * sqrt(390 / 525600) end expected_move, case when z > 0 then 'above baseline' when z < 0 then 'below baseline' when z = 0 then 'at baseline' else 'no baseline' end label,
        coalesce(minute - xm > 2, true) or coalesce(minute - fm > 2, true) or coalesce(minute - pm > 2, true) stale, crosses < 4 and phase not in ('positive-decay', 'negative-recovery') calm,
        case when z is null then null when regime = 'INSIDE' then case when close > pm_high and z > 0 and slope > 0 then 'INSIDE-RISE' when close < pm_low and z < 0 and slope < 0 then 'INSIDE-FALL' when close < pm_low and phase = 'negative-recovery' then 'INSIDE-SELLING' end
        when regime = 'EXT-UP' then case when phase = 'positive-decay' then 'EXT-UP-COOLING' when recent_low < -1 and z > 0 and above then 'EXT-UP-REBOUND' when z < -1 and slope < 0 and close < prior_high then 'EXT-UP-FAILURE' end
        when regime = 'EXT-DOWN' then case when z < -2 and close < prior_low then 'EXT-DOWN-SELLING' when phase = 'negative-recovery' and close > prior_low then 'EXT-DOWN-REBOUND' when z >= -2 and z < 0 and slope >= 0 and above then 'EXT-DOWN-RECOVERY' end end code from r2),
    r4 as (select *, anchor + expected_move sigma_up, anchor - expected_move sigma_down, ratio * pm_high premarket_high, ratio * pm_low premarket_low, case when calm and above and z >= 1 then 'long' when calm and below and z <= -1 then 'short' else 'neutral' end direction from r3),
    r5 as (select *, coalesce(case when code in ('EXT-UP-REBOUND', 'EXT-DOWN-REBOUND') then broke_up when code = 'EXT-UP-COOLING' then broke_down when code in ('INSIDE-RISE', 'EXT-DOWN-RECOVERY') then direction = 'long' when code is not null then direction = 'short' end, false) passed from r4)"""


@query(shown(READOUT, "r5", f"{BARS} price:d fund_price:d vwap:d anchor:d ratio:d expected_move:d sigma_up:d sigma_down:d premarket_high:d premarket_low:d regime day_type day_side z:d slope:d phase label above below crosses:l direction code passed stale"))
def session_readout(spark, d):
    """One row a minute of everything: S01 is the index, S02 its fund, S00 the option whose premium is read."""
    b = X.bars(spark, d, X.PRE)
    one = lambda s, rows: rows.where(F.col("symbol") == s).withColumn("symbol", F.lit("S00"))
    return rounded(R.minute_readout(one("S01", b), one("S02", b), one("S00", X.quotes(spark, d, X.PRE))).drop("sampled"))


#: Playbook, EMA and divergences beside the readout. Samples are minutes at which any of the three has a row of its own.
FULL = READOUT + ema_sql(960).replace("from bars", "from xbars") + f""", smp as (select distinct session_date, minute from bars where symbol in ('S00', 'S01', 'S02') and minute >= 570),
    h0 as (select r5.symbol, r5.session_date, r5.minute, case when not stale then code end c, s.minute is not null sm from r5 left join smp s on s.session_date = r5.session_date and s.minute = r5.minute),
    h1 as (select *, lag(c) over ({P}) pc from h0 where sm), h2 as (select *, sum((c is not null and c is distinct from pc)::int) over ({P} rows unbounded preceding) ep from h1),
    he as (select symbol, session_date, ep, any_value(c) code, min(minute) a, max(minute) b from h2 where c is not null group by all),
    h3 as (select h0.*, h2.ep, h2.c is not null going from h0 asof left join h2 on h2.symbol = h0.symbol and h2.session_date = h0.session_date and h2.minute <= h0.minute),
    hl as (select h3.symbol, h3.session_date, h3.minute, h3.c, h3.ep, h3.going, x.code lc, x.a la, max(h2.minute) lb from h3 left join he x on x.symbol = h3.symbol and x.session_date = h3.session_date and x.ep = h3.ep left join h2 on h2.symbol = h3.symbol and h2.session_date = h3.session_date and h2.ep = h3.ep and h2.c is not null and h2.minute <= h3.minute group by all),
    hp as (select hl.*, lc || ':' || la || '-' || lb latest, y.code || ':' || y.a || '-' || y.b sec, coalesce(going and c = lc, false) nw from hl left join he y on y.symbol = hl.symbol and y.session_date = hl.session_date and y.ep = hl.ep - 1),
    ev as (select symbol, session_date, side, nth, unnest([crossed, retested, ended]) - 1 tm, unnest(['watching', 'confirmed', status]) what, unnest([0, 1, 2]) rk from eps where symbol = 'S01'), ba as (select session_date, side, tm, arg_max(what, (nth, rk)) what from ev where tm is not null group by all),
    pt as (select f.session_date, t.e - 1 tm, f.ema, t.ok from fold f join tape t using (symbol, session_date, i) where f.day = 1 and f.symbol = 'S01'), w0 as (select session_date, ema from fold where symbol = 'S01' and i = (select max(i) from fold g where g.symbol = fold.symbol and g.session_date = fold.session_date and (g.day = 0))),
    xs as (select distinct session_date from xbars where symbol = 'S01'),
    em as (select gr.session_date, gr.minute, case when xs.session_date is null then null when p.tm is null then w0.ema else p.ema end ema, case when xs.session_date is null then null when b.minute is null then 'unavailable' when gr.minute - b.minute > 2 then 'stale' when not coalesce(p.ok, true) then 'unavailable' when q.tm is null or (case when p.tm is null then w0.ema else p.ema end) is null then 'warming' else 'ready' end status,
        case when xs.session_date is not null then coalesce(u.what, 'idle') end bullish, case when xs.session_date is not null then coalesce(v.what, 'idle') end bearish from gr left join xs on xs.session_date = gr.session_date left join w0 on w0.session_date = gr.session_date asof left join (select * from xbars where symbol = 'S01') b on b.session_date = gr.session_date and b.minute <= gr.minute
        asof left join pt p on p.session_date = gr.session_date and p.tm <= gr.minute asof left join (select * from pt where ok) q on q.session_date = gr.session_date and q.tm <= gr.minute asof left join (select * from ba where side = 'bullish') u on u.session_date = gr.session_date and u.tm <= gr.minute asof left join (select * from ba where side = 'bearish') v on v.session_date = gr.session_date and v.tm <= gr.minute),
    dv as (select session_date, minute, close price, extrinsic from premium where valid and symbol = 'S00'),
    dn as (select *, min(price) over w lo, max(price) over w hi, count(*) over w c, lead(minute, 2) over o - lag(minute, 2) over o sp from dv window w as (partition by session_date order by minute rows between 2 preceding and 2 following), o as (partition by session_date order by minute)),
    dp as (select session_date, minute, price, extrinsic, 'bullish' kind from dn where c = 5 and sp = 4 and price <= lo union all select session_date, minute, price, extrinsic, 'bearish' from dn where c = 5 and sp = 4 and price >= hi),
    dq as (select *, lag(minute) over k am, lag(price) over k ap, lag(extrinsic) over k ae from dp window k as (partition by session_date, kind order by minute)), dr as (select * from dq where minute - am between 5 and 40 and price > ap and extrinsic <= ae),
    dt as (select dr.session_date, dr.kind, dr.am, dr.minute bm, case when dr.kind = 'bullish' then max(v.price) else min(v.price) end trig from dr join dv v on v.session_date = dr.session_date and v.minute > dr.am and v.minute < dr.minute group by dr.session_date, dr.kind, dr.am, dr.minute),
    dc as (select dt.*, min(v.minute) cm from dt left join dv v on v.session_date = dt.session_date and v.minute > dt.bm + 2 and case when dt.kind = 'bullish' then v.price > trig else v.price < trig end group by all),
    dk as (select gr.session_date, gr.minute, list(kind || ':' || am || '-' || bm || case when cm <= gr.minute then '!' else '' end order by bm desc, am desc, kind)[1:6] ds from gr join dc on dc.session_date = gr.session_date and dc.bm + 2 <= gr.minute group by all),
    full_rows as (select r5.symbol, r5.session_date, r5.minute, r5.price, r5.code, r5.stale, em.ema, em.status ema_status, em.bullish, em.bearish, case when hp.nw then hp.latest end as current_episode, case when hp.nw then hp.sec else hp.latest end previous_episode, hp.latest latest_episode, coalesce(array_to_string(dk.ds, ' '), '') divergences
        from r5 join hp on hp.session_date = r5.session_date and hp.minute = r5.minute left join em on em.session_date = r5.session_date and em.minute = r5.minute left join dk on dk.session_date = r5.session_date and dk.minute = r5.minute)"""


@query(recursive(shown(FULL.replace(", cal as (", ", xbars as (select * from bars where minute >= 570), cal as (", 1), "full_rows", f"{BARS} price:d code stale ema:d ema_status bullish bearish current_episode previous_episode latest_episode divergences")))
def full_readout(spark, d):
    """The readout with the EMA's clock, what is known of divergences, and the playbook's current, previous and latest episode, at every minute."""
    b = written(X.bars(spark, d, X.PRE))
    one = lambda s, rows: rows.where(F.col("symbol") == s).withColumn("symbol", F.lit("S00"))
    rows = R.full_readout(one("S01", b), one("S02", b), one("S00", X.quoted(b)))
    told = lambda c: F.concat(F.col(f"{c}.code"), F.lit(":"), F.col(f"{c}.first_minute"), F.lit("-"), F.col(f"{c}.last_minute")).alias(f"{c}_episode")
    said = F.array_join(F.transform("divergences", lambda x: F.concat(x["kind"], F.lit(":"), x["first_minute"], F.lit("-"), x["second_minute"], F.when(x["confirmed_minute"].isNotNull(), "!").otherwise(""))), " ")
    return rounded(rows.select("symbol", "session_date", "minute", "price", "code", "stale", "ema", "ema_status", "bullish", "bearish", *map(told, ("current", "previous", "latest")), said.alias("divergences")))


@query(recursive(shown(X.levels_sql(X.PRE) + INTERVALS + ema_sql(960) + """, f as (select e.symbol, e.session_date, e.nth, side, status, crossed, retested, ended, cross_price, confirm_price, reference, coalesce(list(l.name order by l.nth) filter (e.reference >= l.low - 500 and e.reference <= l.high + 500), []) confluence,
    case side when 'bullish' then arg_min(l.name, row(l.low, l.nth)) filter (l.low > e.confirm_price) else arg_min(l.name, row(-l.high, l.nth)) filter (l.high < e.confirm_price) end target
    from eps e left join iv l on l.symbol = e.symbol and l.session_date = e.session_date where confirm_price is not null group by e.symbol, e.session_date, e.nth, side, status, crossed, retested, ended, cross_price, confirm_price, reference), g as (select *, array_to_string(confluence, ',') names from f)""", "g", f"{EPISODE} names target")))
def ema_level_targets(spark, d):
    """Levels, points and zones, frozen at each confirmed retest."""
    b = X.bars(spark, d, X.PRE)
    e = E.ema_episodes(E.fold(E.calendar_buckets(b)))
    return rounded(E.touched_levels(e, _intervals(b), tolerance=500.0).withColumn("names", F.array_join("confluence", ",")).drop("confluence"))
