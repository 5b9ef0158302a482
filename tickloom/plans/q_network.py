"""Sector network, forecasts and missing inputs. Symbols S00 to S10 of the dense tape are sectors, S11 is oil, S12 is rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import dealt, written
from ..operators import forecast as R
from ..operators import fallback as K
from ..operators import impute as I
from ..operators import network as N
from . import fixtures as X
from .q_bars import P
from .registry import query, rounded, shown

#: Random prices rarely correlate; the default of 0.6 is covered by unit fixtures.
LEAST = 0.1
SECTORS = "symbol <= 'S10'"

STATES = X.bars_sql(X.DENSE) + f""", g as (select *, case when count(*) over w = minute - 569 and sum(volume) over w > 0 then sum((high + low + close) / 3 * volume) over w / sum(volume) over w end sv,
    case when minute - lag(minute) over o = 1 then close / lag(close) over o - 1 end return_1, close / max(close) over r5 - 1 return_5 from bars window w as ({P} rows unbounded preceding), o as ({P}), r5 as ({P} range between 5 preceding and 5 preceding)),
    states as (select *, close / sv - 1 vwap_gap, case when return_5 > 0 and close / sv - 1 > 0 then 1 when return_5 < 0 and close / sv - 1 < 0 then -1 else 0 end sg from g)"""
PAIRS = STATES + """, pj as (select a.session_date, a.minute, a.symbol a, b.symbol b, a.return_1 ra, b.return_1 rb, a.sg sa, b.sg sb from states a join states b on a.session_date = b.session_date and a.minute = b.minute and a.symbol < b.symbol where a.symbol <= 'S10' and b.symbol <= 'S10'),
    pairs as (select *, case when count(ra + rb) over w = 60 then corr(ra, rb) over w end r from pj window w as (partition by session_date, a, b order by minute range between 59 preceding and current row))"""


def states(spark, d) -> DataFrame:
    return N.node_states(X.bars(spark, d, X.DENSE))


def sector_pairs(spark, d) -> DataFrame:
    return N.pair_correlations(states(spark, d).where(SECTORS))


@query(shown(STATES, "states", "symbol session_date minute:l return_1:d return_5:d vwap_gap:d sg:l").replace("sg::bigint as sg", 'sg::bigint as "sign"'))
def node_states(spark, d):
    return rounded(states(spark, d).select("symbol", "session_date", "minute", "return_1", "return_5", "vwap_gap", "sign"))


@query(shown(PAIRS, "pairs", "session_date minute:l a b r:d").replace("as r from", "as corr from"))
def pair_correlation(spark, d):
    return rounded(sector_pairs(spark, d).select("session_date", "minute", "a", "b", "corr"))


LINKED = PAIRS + f""", nodes as (select session_date, minute, sg, symbol from states where sg <> 0 and symbol <= 'S10'), e as (select session_date, minute, sa sg, a, b from pairs where r >= {LEAST} and sa = sb and sa <> 0),
    e2 as (select session_date, minute, sg, a, b from e union all select session_date, minute, sg, b, a from e)"""
CLUSTERS = "with recursive " + LINKED + """, reach(session_date, minute, sg, a, b) as (select session_date, minute, sg, symbol, symbol from nodes union select r.session_date, r.minute, r.sg, r.a, e2.b from reach r join e2 on e2.session_date = r.session_date and e2.minute = r.minute and e2.sg = r.sg and e2.a = r.b),
    lab as (select session_date, minute, sg, a node, min(b) label from reach group by all)"""


def _labels(spark, d, b: DataFrame | None = None):
    """States, pairs and components. States and pairs serve several readers each, so they are written once. b: bars, where the caller has them as a table."""
    s = written((states(spark, d) if b is None else N.node_states(b)).where(SECTORS))
    pairs = written(N.pair_correlations(s))
    e = N.links(pairs, LEAST).where("sign <> 0").select("session_date", "minute", "sign", "a", "b")
    nodes = s.where("sign <> 0").select("session_date", "minute", "sign", F.col("symbol").alias("node"))
    return s, pairs, N.components(nodes, e, ["session_date", "minute", "sign"])


@query(CLUSTERS + """ select session_date, minute::bigint as minute, sg::bigint as "sign", node, label from lab""")
def same_sign_components(spark, d):
    return rounded(_labels(spark, d)[2])


@query(CLUSTERS + f""", sz as (select session_date, minute, sg, label, count(*) n from lab group by all), big as (select session_date, minute, sg, max(n) n from sz group by all),
    s as (select session_date, minute, count(*) filter (sv is not null) eligible, sum(sg) ss, coalesce(string_agg(case when sv is not null then symbol end, ',' order by symbol), '') st from states where symbol <= 'S10' group by all),
    c as (select session_date, minute, avg(r) mc from pairs group by all), k as (select session_date, minute, coalesce(max(n) filter (sg = 1), 0) bu, coalesce(max(n) filter (sg = -1), 0) be from big group by all),
    j as (select s.*, mc, coalesce(bu, 0) bu, coalesce(be, 0) be from s left join c using (session_date, minute) left join k using (session_date, minute)),
    w as (select *, case when st = max(st) over o then (bu - max(bu) over o) / 11 end g1, case when st = max(st) over o then (be - max(be) over o) / 11 end g2 from j window o as (partition by session_date order by minute range between 5 preceding and 5 preceding))
    select session_date, minute::bigint as minute, eligible::bigint eligible, round(ss / 11 + 1e-9, 6) + 0.0 breadth, round(mc + 1e-9, 6) + 0.0 mean_correlation, bu::bigint bullish, be::bigint bearish, round(bu / 11 + 1e-9, 6) + 0.0 bullish_fraction, round(be / 11 + 1e-9, 6) + 0.0 bearish_fraction, round(g1 + 1e-9, 6) + 0.0 bullish_growth_5, round(g2 + 1e-9, 6) + 0.0 bearish_growth_5,
    case when minute < 570 then 'premarket' when minute < 630 then 'warming' when eligible < 9 then 'unavailable' when bu >= 7 then 'bullish_coordinated' when be >= 7 then 'bearish_coordinated' when greatest(bu, be) <= 3 and abs(ss) <= 3 then 'dispersed' else 'unresolved' end status from w""")
def network_summary(spark, d):
    s, pairs, labels = _labels(spark, d)
    return rounded(N.summary(s, pairs, N.largest_clusters(labels, ["session_date", "minute", "sign"])))


GRAPH = "edges as (select 'S' || lpad(i::varchar, 2, '0') a, 'S' || lpad(j::varchar, 2, '0') b, 0.6::double + ((i * 7 + j * 3) % 10) / 25 weight from range(0, 11) x(i), range(0, 11) y(j) where i < j and (i + j) % 3 = 0)"


def graph(spark) -> DataFrame:
    name = lambda c: F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 2, "0"))
    i = spark.range(11).withColumnRenamed("id", "i")
    rows = i.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long")))).where("i < j and (i + j) % 3 = 0")
    return rows.select(F.lit("g").alias("graph_id"), name("i").alias("a"), name("j").alias("b"), (0.6 + ((F.col("i") * 7 + F.col("j") * 3) % 10) / 25).alias("weight"))


@query(f"with {STATES}, {GRAPH} select x.session_date, x.minute::bigint as minute, round(coalesce(sum(weight) filter (x.sg = 1 and y.sg = 1), 0) / sum(weight) + 1e-9, 6) + 0.0 bullish_edge_fraction, round(coalesce(sum(weight) filter (x.sg = -1 and y.sg = -1), 0) / sum(weight) + 1e-9, 6) + 0.0 bearish_edge_fraction from edges join states x on x.symbol = a join states y on y.symbol = b and y.session_date = x.session_date and y.minute = x.minute group by 1, 2")
def edge_weights(spark, d):
    nodes = states(spark, d).where(SECTORS).select("session_date", "minute", F.lit("g").alias("graph_id"), F.col("symbol").alias("node"), "sign")
    return rounded(N.edge_participation(graph(spark), nodes, ["session_date", "minute"]))


@query(f"with {X.bars_sql(X.DENSE)}, req as (select distinct b.session_date, b.minute, 'S' || lpad(i::varchar, 2, '0') symbol from bars b, range(0, 14) t(i)) select r.session_date, r.minute::bigint as minute, r.symbol from req r anti join bars b using (session_date, minute, symbol)")
def missing_inputs(spark, d):
    b = X.bars(spark, d, X.DENSE)
    req = b.select("session_date", "minute").distinct().withColumn("symbol", F.explode(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.concat(F.lit("S"), F.lpad(i.cast("string"), 2, "0")))))
    return rounded(N.missing_nodes(req, b, ["session_date", "minute", "symbol"]))


@query(shown(X.bars_sql(X.DENSE) + """, f as (select a.symbol, a.session_date, a.minute, a.close / 10 yield_percent, (a.close - p.close) * 10 change_5_bps, (a.close - o.close) * 10 change_open_bps from bars a left join bars p on p.symbol = a.symbol and p.session_date = a.session_date and p.minute = a.minute - 5
    left join bars o on o.symbol = a.symbol and o.session_date = a.session_date and o.minute = 570 where a.symbol = 'S12')""", "f", "symbol session_date minute:l yield_percent:d change_5_bps:d change_open_bps:d"))
def rates_node(spark, d):
    return rounded(N.rates_node(X.bars(spark, d, X.DENSE).where("symbol = 'S12'")))


RHO = "rho as (select m macro, 'S' || lpad((k * 3 + i)::varchar, 2, '0') sector, 0.2::double + i / 10 - k / 2 rho from (values ('S11', 0), ('S12', 1)) t(m, k), range(0, 3) u(i))"


def macro_links(spark) -> DataFrame:
    rows = [("S11", f"S{i:02d}", 0.2 + i / 10) for i in range(3)] + [("S12", f"S{3 + i:02d}", 0.2 + i / 10 - 0.5) for i in range(3)]
    return spark.createDataFrame(rows, "macro string, sector string, rho double")


@query(f"with {STATES}, {RHO} select x.session_date, x.minute::bigint as minute, macro, round(sum(x.sg * y.sg * rho / 3) + 1e-9, 6) + 0.0 alignment, round(sum(x.sg * abs(y.sg) * rho / 3) + 1e-9, 6) + 0.0 pressure from rho join states x on x.symbol = macro join states y on y.symbol = sector and y.session_date = x.session_date and y.minute = x.minute group by 1, 2, 3 having count(*) = 3")
def macro_interactions(spark, d):
    nodes = states(spark, d).select("session_date", "minute", F.col("symbol").alias("node"), "sign")
    return rounded(N.interactions(macro_links(spark), nodes, ["session_date", "minute"]).where("alignment is not null"))


@query("""with t as (select p_brand macro, p_partkey nth, p_type sector, sin(p_partkey) rho from part), f as (select *, row_number() over (partition by macro order by abs(rho) desc, nth) place from t) select macro, nth, sector, round(rho + 1e-9, 6) + 0.0 rho, place from f where place <= 3""")
def strongest_links(spark, d):
    t = X.table(spark, d, "part").select(F.col("p_brand").alias("macro"), F.col("p_partkey").alias("nth"), F.col("p_type").alias("sector"), F.sin("p_partkey").alias("rho"))
    return rounded(N.top_neighbours(t).withColumn("place", F.col("place").cast("long")))


@query(shown(X.bars_sql(X.GAPS) + f", f as (select symbol, session_date, minute, count(*) over ({P} rows unbounded preceding) = minute - 569 traded_prefix from bars where minute >= 570)", "f", "symbol session_date minute:l traded_prefix"))
def traded_prefix(spark, d):
    return rounded(N.volume_runs(X.bars(spark, d)))


@query(f"""with {X.ticks_sql(X.GAPS)}, b as (select symbol, session_date, minute, case when l_suppkey % 97 = 0 then 'off' else 'on' end st, case when l_suppkey % 10 = 0 and symbol = 'S03' then 'B' else 'A' end pv from ticks),
    q as (select * from b qualify max((st = 'off')::int) over (partition by symbol, session_date, minute) = 0), m as (select symbol, session_date from q group by all having count(distinct pv) > 1)
    select symbol, session_date, minute::bigint as minute, count(*) n from q anti join m using (symbol, session_date) group by all""")
def quarantined(spark, d):
    """Minutes with an off-grid row go, then symbols of two providers."""
    t = X.ticks(spark, d, X.GAPS).withColumns({"grid_status": F.when(F.col("l_suppkey") % 97 == 0, "off").otherwise("on"), "provider": F.when((F.col("l_suppkey") % 10 == 0) & (F.col("symbol") == "S03"), "B").otherwise("A")})
    kept, _ = N.without_mixed_providers(N.quarantine_off_grid(t))
    return rounded(kept.groupBy("symbol", "session_date", "minute").agg(F.count("*").alias("n")))


# Scoring


def registry(spark, d, days: DataFrame | None = None) -> DataFrame:
    """Two models over three features for each month of the tape, made from a rule: horizons 30 and 60. days, with all sessions, spares another reading of the tape."""
    days = X.ticks(spark, d, X.DENSE) if days is None else days
    months = days.select(F.trunc("session_date", "month").alias("valid_from")).distinct()
    h = F.explode(F.array(F.lit(30), F.lit(60)))
    numbers = lambda *xs: F.array(*map(F.lit, xs))
    return months.select("valid_from", F.last_day("valid_from").alias("valid_to"), F.date_sub("valid_from", 1).alias("train_end"), h.alias("horizon")).select(
        F.concat(F.lit("m"), "horizon").alias("model_id"), F.lit("base").alias("family"), "horizon", "valid_from", "valid_to", "train_end", F.lit(400).alias("training_rows"), F.lit(90).alias("training_days"), F.lit(True).alias("converged"),
        numbers("return_5", "vwap_gap", "return_1").alias("feature_order"), numbers(0.0, 0.1, 0.0).alias("mean"), numbers(1.0, 2.0, 0.5).alias("scale"), F.array(F.lit(-0.2), F.lit(0.4) * F.col("horizon") / 30, F.lit(-0.1), F.lit(0.05)).alias("beta"))


def _vectors(spark, d) -> DataFrame:
    s = states(spark, d).where(SECTORS)
    pieces = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in ("return_5", "vwap_gap", "return_1")]))
    long = s.select("symbol", "session_date", "minute", pieces.alias("x")).select("symbol", "session_date", "minute", "x.*")
    return R.feature_vector(long, ["symbol", "session_date", "minute"])


SCORES = STATES + """, sc as (select symbol, session_date, minute, hz horizon, -0.2::double + 0.4::double * hz / 30 * return_5 + -0.1::double * (vwap_gap - 0.1::double) / 2 + 0.05::double * return_1 / 0.5::double lo from states, (values (30), (60)) t(hz) where symbol <= 'S10'),
    sp as (select *, case when lo >= 0 then 1 / (1 + exp(-lo)) else exp(lo) / (1 + exp(lo)) end p from sc)"""


@query(f"with {SCORES} select symbol, session_date, minute::bigint as minute, horizon::bigint horizon, round(lo + 1e-9, 6) + 0.0 log_odds, round(p + 1e-9, 6) + 0.0 p_up, case when p > 0.55 then 'bullish' when p < 0.45 then 'bearish' when p is not null then 'neutral' end direction, case when minute < 635 then 'warming' when minute + 1 + horizon > 700 then 'beyond the close' end reason from sp")
def logistic_scores(spark, d):
    rows = R.valid_on(_vectors(spark, d), R.usable_models(registry(spark, d)))
    s = R.scored(rows)
    return rounded(s.select("symbol", "session_date", "minute", "horizon", "log_odds", "p_up", "direction", R.horizon_gate(F.col("minute"), F.col("horizon"), F.lit(700)).alias("reason")))


@query(f"""with {STATES}, c as (select symbol, session_date, minute, 0.4::double * return_5 a, -0.1::double * (vwap_gap - 0.1::double) / 2 b, 0.05::double * return_1 / 0.5::double c from states where symbol <= 'S10' and return_5 is not null and vwap_gap is not null and return_1 is not null)
    select symbol, session_date, minute::bigint as minute, round(a + 1e-9, 6) + 0.0 return_5, round(b + 1e-9, 6) + 0.0 vwap_gap, round(c + 1e-9, 6) + 0.0 return_1, case when abs(a) >= abs(b) and abs(a) >= abs(c) then 'return_5' when abs(b) >= abs(c) then 'vwap_gap' else 'return_1' end strongest from c""")
def score_contributions(spark, d):
    rows = R.scored(R.valid_on(_vectors(spark, d), R.usable_models(registry(spark, d)).where("horizon = 30"))).where("log_odds is not null")
    by = F.map_from_entries(F.transform("contributions", lambda x: F.struct(x["feature"], x["log_odds"])))
    return rounded(rows.select("symbol", "session_date", "minute", *[by[f].alias(f) for f in ("return_5", "vwap_gap", "return_1")], F.col("contributions")[0]["feature"].alias("strongest")))


@query(f"with {SCORES}, v as (select symbol, session_date, minute, max(p) filter (horizon = 30 and minute % 3 = 0) i, max(p) filter (horizon = 60 and minute % 3 <> 1) a, max(p) filter (horizon = 30) f from sp group by all) select symbol, session_date, minute::bigint as minute, case when i is not null then 'interaction' when a is not null then 'additive' when f is not null then 'missing-input' end model, round(coalesce(i, a, f) + 1e-9, 6) + 0.0 p_up from v")
def forecast_choice(spark, d):
    s = R.scored(R.valid_on(_vectors(spark, d), R.usable_models(registry(spark, d))))
    h, m = F.col("horizon"), F.col("minute")
    v = s.groupBy("symbol", "session_date", "minute").agg(F.max(F.when((h == 30) & (m % 3 == 0), F.col("p_up"))).alias("i"), F.max(F.when((h == 60) & (m % 3 != 1), F.col("p_up"))).alias("a"), F.max(F.when(h == 30, F.col("p_up"))).alias("f"))
    pick = R.chosen_view(F.col("i"), F.col("a"), F.col("f"))
    return rounded(v.select("symbol", "session_date", "minute", pick["model"].alias("model"), pick["p_up"].alias("p_up")))


@query("""with f as (select o_orderkey, o_orderkey % 11 <> 0 verified, o_orderkey % 7 <> 0 fresh, o_orderpriority = '1-URGENT' missing, o_orderstatus = 'F' inter, o_orderkey % 2 = 0 base, 570 + o_orderkey % 390 mi, case o_orderkey % 4 when 0 then 'available' when 1 then 'warming' else 'unavailable' end st from orders)
    select o_orderkey, case when not verified or not fresh then null when missing then 'missing' when inter then 'interactions' when base then 'base' end bundle, case when not verified then 'calendar' when not fresh and (missing or inter or base) then 'inputs not fresh' when not (missing or inter or base) then 'no bundle' end bundle_reason,
    case when inter then 'interaction' when st <> 'unavailable' then 'additive' else 'missing-input' end source, case when not fresh then 'held' when mi + 31 > 960 then 'beyond the close' when not inter and st = 'unavailable' and o_orderkey % 3 = 0 then 'loading' when st <> 'available' then st end reason from f""")
def bundle_choice(spark, d):
    """Which bundle scores and which model is shown, with the reasons in their order; flags are made from orders."""
    o, k = X.table(spark, d, "orders"), F.col("o_orderkey")
    urgent, inter = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F"
    status = F.when(k % 4 == 0, "available").when(k % 4 == 1, "warming").otherwise("unavailable")
    b = R.chosen_bundle(k % 11 != 0, k % 7 != 0, urgent, inter, k % 2 == 0)
    source = R.view_source(inter, status)
    error = F.when((source == "missing-input") & (k % 3 == 0), "loading")
    reason = R.view_reason(F.when(k % 7 == 0, "held"), 570 + k % 390, F.lit(30), F.lit(960), error, F.when(status != "available", status))
    return o.select("o_orderkey", b["bundle"].alias("bundle"), b["reason"].alias("bundle_reason"), source.alias("source"), reason.alias("reason"))


@query("""with r as (select s_suppkey::varchar model_id, 300 + s_suppkey % 100 n, s_nationkey dys, s_acctbal > 0 conv from supplier) select model_id, unnest(['prior training', 'enough rows', 'enough days', 'converged', 'sizes', 'positive scale', 'distinct features', 'month window']) as "rule", unnest([true, n >= 350, dys * 10 >= 80, conv, n % 2 = 0, n % 3 <> 0, n % 5 <> 0, true]) as holds from r""")
def registry_checks(spark, d):
    """Registry rules over a table of models made from suppliers."""
    n = 300 + F.col("s_suppkey") % 100
    s = X.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("model_id"), F.lit("2026-01-01").cast("date").alias("valid_from"), F.lit("2026-01-31").cast("date").alias("valid_to"), F.lit("2025-12-31").cast("date").alias("train_end"), n.alias("training_rows"), (F.col("s_nationkey") * 10).alias("training_days"), (F.col("s_acctbal") > 0).alias("converged"), F.when(n % 5 != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a"))).alias("feature_order"), F.array(F.lit(0.0), F.lit(0.0)).alias("mean"), F.array(F.lit(1.0), F.when(n % 3 != 0, 1.0).otherwise(0.0)).alias("scale"), F.when(n % 2 == 0, F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0))).alias("beta"))
    return R.registry_report(s)


@query("""with m as (select p_partkey::varchar version_id, p_size::double v, case when p_partkey % 3 = 0 then 1.0::double else 0.0::double end off from part) select version_id, true square, off = 0 as "symmetric", v > 3 positive_diagonal, v > 3 positive_definite from m""")
def matrix_checks(spark, d):
    off = F.when(F.col("p_partkey") % 3 == 0, 1.0).otherwise(0.0)
    v = F.col("p_size").cast("double")
    m = dealt(X.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("version_id"), F.array(F.array(v, off), F.array(F.lit(0.0), v - 3)).alias("m")), "version_id", rows=100_000)
    return R.matrix_report(m)


@query("""with m as (select l_suppkey s, corr(l_quantity, l_discount) a, corr(l_quantity, l_tax) b, corr(l_discount, l_tax) c from lineitem group by 1), k as (select s, least(greatest(a * 4, -1), 1) a, least(greatest(b * 4, -1), 1) b, least(greatest(c * 4, -1), 1) c from m)
    select s l_suppkey, coalesce(1 - a * a > 0 and 1 + 2 * a * b * c - a * a - b * b - c * c > 0, false) positive_definite from k where abs(1 + 2 * a * b * c - a * a - b * b - c * c) > 1e-9 or a is null or b is null or c is null""")
def covariance_checks(spark, d):
    """Exaggerated correlations of three measures of each supplier's lines: some are no longer those of anything. The SQL goes by minors, not by a factor; matrices of which one is zero but for rounding are left out."""
    clip = lambda x, y: F.least(F.greatest(F.corr(x, y) * 4, F.lit(-1.0)), F.lit(1.0))
    m = X.table(spark, d, "lineitem").groupBy("l_suppkey").agg(clip("l_quantity", "l_discount").alias("a"), clip("l_quantity", "l_tax").alias("b"), clip("l_discount", "l_tax").alias("c"))
    a, b, c, one = F.col("a"), F.col("b"), F.col("c"), F.lit(1.0)
    det = 1 + 2 * a * b * c - a * a - b * b - c * c
    m = m.where((F.abs(det) > 1e-9) | a.isNull() | b.isNull() | c.isNull())
    return m.select("l_suppkey", R.positive_definite(F.array(F.array(one, a, b), F.array(a, one, c), F.array(b, c, one))).alias("positive_definite"))


GRAPH_RULES = ("square", "known ends", "distinct links", "weights", "edges in matrix", "matrix in edges", "weight sum")


@query(f"""with g as (select p_partkey::varchar version_id, p_partkey % 8 k from part) select version_id, unnest({list(GRAPH_RULES)}) as "rule", unnest([k <> 7, k <> 5, k <> 4, k <> 3, k not in (1, 7), k not in (2, 5, 7), k <> 6]) as holds from g""")
def graph_checks(spark, d):
    """Saved graphs made of parts, each eighth broken in one way: its matrix, its list, or one against the other."""
    k = F.col("p_partkey") % 8
    edge = lambda a, b, w: F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(w).alias("weight"))
    number = lambda v: F.lit(float(v))
    ab = F.when(k == 1, 0.9).when(k == 3, 0.5).otherwise(0.7)
    rows = F.array(F.array(number(0), ab, F.when(k == 2, 0.6).otherwise(0.0)), F.array(F.when(k == 3, 0.5).otherwise(0.7), number(0), number(0.8)), F.array(number(0), number(0.8), number(0)))
    edges = F.when(k == 3, F.array(edge("A", "B", 0.5), edge("B", "C", 0.8))).when(k == 4, F.array(edge("A", "B", 0.7), edge("B", "C", 0.8), edge("B", "A", 0.7))).when(k == 5, F.array(edge("A", "B", 0.7), edge("B", "D", 0.8))).otherwise(F.array(edge("A", "B", 0.7), edge("B", "C", 0.8)))
    total = F.when(k == 3, 1.3).when(k == 4, 2.2).when(k == 6, 9.0).otherwise(1.5)
    g = X.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("version_id"), F.array(*map(F.lit, "ABC")).alias("nodes"), F.when(k == 7, F.slice(rows, 1, 2)).otherwise(rows).alias("adjacency"), edges.alias("edges"), total.alias("weight_sum"))
    return R.graph_report(g)


@query("""select s_suppkey bundle_id, s_suppkey % 5 <> 0 whole, s_suppkey % 3 <> 0 and s_suppkey % 5 <> 0 antithetic from supplier""")
def draw_checks(spark, d):
    """Bundles of saved draws made of suppliers: some lack a draw, some hold one whose sign isn't turned."""
    b = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("bundle_id"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("draw_id")).where("bundle_id % 5 <> 0 or draw_id <> 63")
    n = F.col("draw_id") % 32
    sign = F.when((F.col("draw_id") >= 32) & ~((F.col("draw_id") == 40) & (F.col("bundle_id") % 3 == 0)), -1.0).otherwise(1.0)
    return R.draw_report(b.select("bundle_id", "draw_id", F.array(*[sign * (n + F.col("bundle_id") % 7 + j + 1).cast("double") for j in range(4)]).alias("z")))


def _lines(spark, d) -> DataFrame:
    """Every line as a row of three measures, some of them missing."""
    a, b = F.col("l_quantity") / 50, F.col("l_discount") * 10
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return X.table(spark, d, "lineitem").select(key.alias("row_id"), F.lit("v").alias("version_id"), F.array(a, F.when(F.col("l_partkey") % 3 == 0, F.lit(None)).otherwise(b), F.when(F.col("l_suppkey") % 4 == 0, F.lit(None)).otherwise(F.col("l_tax") * 100 / 2)).alias("x")).distinct()


def _version(spark) -> DataFrame:
    return spark.createDataFrame([("v", [0.5, 0.5, 2.0], [0.25, 0.25, 1.0], [[1.0, 0.6, 0.2], [0.6, 1.0, 0.1], [0.2, 0.1, 1.0]])], "version_id string, mean array<double>, scale array<double>, cov array<array<double>>")


#: Lines with their standardised values; w: weights, with the ridge, in closed form.
OBSERVED = """r as (select distinct concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_linenumber, l_quantity, l_discount, l_tax) row_id, (l_quantity / 50 - 0.5::double) / 0.25::double za, (l_discount * 10 - 0.5::double) / 0.25::double zb, l_tax * 100 / 2 - 2.0::double zc, l_partkey % 3 = 0 mb, l_suppkey % 4 = 0 mc from lineitem),
    w as (select 1.00000001::double d, 1.00000001::double * 1.00000001::double - 0.04::double dac, 1.00000001::double * 1.00000001::double - 0.36::double dab),
    k as (select 0.6::double / d wb, 0.2::double / d wc, (0.6::double * d - 0.02::double) / dac wba, (0.1::double * d - 0.12::double) / dac wbc, (0.2::double * d - 0.06::double) / dab wca, (0.1::double * d - 0.12::double) / dab wcb from w),
    e as (select row_id, mb, mc, k.*, case when mb and mc then wb * za when mb then wba * za + wbc * zc when mc then wca * za + wcb * zb end e1, case when mb and mc then wc * za end e2, greatest(abs(za), case when mb then 0 else abs(zb) end, case when mc then 0 else abs(zc) end) > 6 far from r, k)"""


@query(f"""with {OBSERVED} select row_id, case when not far then round(e1 + 1e-9, 5) + 0.0 end first_estimate, case when not far then round(e2 + 1e-9, 5) + 0.0 end second_estimate from e""")
def conditional_estimates(spark, d):
    """Missing values of three correlated measures from the others, for every line, checked against the closed form. Lines that are equal in key and values are one row."""
    got = I.conditioned(_lines(spark, d), _version(spark))
    return rounded(got.select("row_id", F.try_element_at("estimates", F.lit(1)).alias("first_estimate"), F.try_element_at("estimates", F.lit(2)).alias("second_estimate")), 5)


@query(f"""with {OBSERVED}, f as (select *, case when mb and mc then sqrt(1 - 0.6::double * wb) when mb then sqrt(1 - 0.6::double * wba - 0.1::double * wbc) else sqrt(1 - 0.2::double * wca - 0.1::double * wcb) end l1, (0.1::double - (0.6::double * wc + 0.2::double * wb) / 2) l21 from e where (mb or mc) and not far),
    g as (select *, sin(id * 12.9898::double) * 1.5::double z1, sin(id * 12.9898::double + 1) * 1.5::double z2 from f, range(0, 64) t(id)),
    p as (select row_id, -0.2::double + 0.4::double * (e1 + l1 * z1) + case when mb and mc then 0.4::double * (e2 + l21 / l1 * z1 + sqrt(1 - 0.2::double * wc - l21 / l1 * l21 / l1) * z2) else 0 end lo from g),
    q as (select row_id, quantile_cont(1 / (1 + exp(-lo)), [0.1, 0.9]) q from p group by row_id) select row_id, round(q[1] + 1e-9, 6) + 0.0 low, round(q[2] + 1e-9, 6) + 0.0 high from q""")
def sensitivity_band(spark, d):
    """64 saved draws for each estimate of every line, scored, and their 10 % and 90 % quantiles."""
    draws = spark.range(64).select(F.col("id").cast("int").alias("draw_id"), F.array(*[F.sin(F.col("id") * 12.9898 + k) * 1.5 for k in range(4)]).alias("z"))
    return rounded(I.drawn_band(I.conditioned(_lines(spark, d), _version(spark)), draws, -0.2, 0.4))


#: Places that a row of thirty lacks, by its key: both values of a node, of two, of a rate, of three nodes, of the core, or none.
_GAPS = ("[4 + 2 * s, 5 + 2 * s]", "[4 + 2 * s, 5 + 2 * s, 4 + 2 * t, 5 + 2 * t]", "[28]", "[4 + 2 * s, 29]", "[4 + 2 * s, 4 + 2 * t, 28]", "[0]", "[4 + 2 * s, 5 + 2 * s, 28, 29]", "[]", "[26, 27]", "[5 + 2 * s, 26]")


def _imputed_inputs(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    gaps = F.expr("case k % 10 " + " ".join(f"when {n} then cast(array({g[1:-1]}) as array<int>)" for n, g in enumerate(_GAPS)) + " end")
    o = dealt(X.table(spark, d, "orders"), "o_orderkey", rows=100_000).select(k.alias("k"), F.concat(F.lit("m"), F.month("o_orderdate")).alias("version_id"), (c % 11).alias("s"), ((c % 11 + 4) % 11).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: ((k * (i + 3) + c * (i * i + 1)) % 201 - 100) / 1000.0).alias("full")).withColumn("gaps", gaps)
    rows = o.select(F.col("k").cast("string").alias("row_id"), "version_id", F.transform("full", lambda v, i: F.when(~F.array_contains("gaps", i), v)).alias("x"))
    m = spark.range(1, 13).select(F.col("id").cast("int").alias("m"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("version_id"))
    places = F.sequence(F.lit(0), F.lit(29))
    rho = 0.3 + 0.02 * F.col("m")
    versions = m.select("version_id", F.col("version_id").alias("graph_id"), F.transform(places, lambda i: 0.0005 + 0.001 * (i % 3)).alias("mean"), F.transform(places, lambda i: 0.05 + 0.001 * F.col("m")).alias("scale"), F.transform(places, lambda i: F.transform(places, lambda j: F.when(i == j, 1.0).otherwise(rho))).alias("cov"))
    links = m.select(F.col("version_id").alias("graph_id"), "m", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(10)))).where("a < b and (a + b + m) % 3 = 0").select("graph_id", "a", "b", (0.6 + (F.col("a") * 7 + F.col("b") * 3 + F.col("m")) % 10 / 25).alias("weight"))
    names = F.array(*map(F.lit, R.FEATURES_35))
    models = m.withColumn("horizon", F.explode(F.array(F.lit(30), F.lit(60)))).select("version_id", "horizon", names.alias("feature_order"), F.transform(names, lambda f: F.lit(0.01)).alias("mean"), F.transform(names, lambda f: F.lit(0.1)).alias("scale"), F.concat(F.array(F.lit(-0.2)), F.transform(names, lambda f, i: 0.05 * ((i + F.col("m")) % 5 - 2) * F.col("horizon") / 30)).alias("beta"))
    n = F.col("id") % 32
    draws = spark.range(64).select(F.col("id").cast("int").alias("draw_id"), F.array(*[F.sin(n * 12.9898 + j) * 1.5 * F.when(F.col("id") < 32, 1.0).otherwise(-1.0) for j in range(4)]).alias("z"))
    return rows, versions, links, models, draws


_W = ", ".join(str(R.FEATURES_35.index(f)) for f in (*R.RAW_30, *K.GRAPH_5))
IMPUTED = f"""with recursive o as (select o_orderkey k, month(o_orderdate)::int m, (o_custkey % 11)::int s, ((o_custkey % 11 + 4) % 11)::int t, o_custkey c from orders),
    g as (select *, list_sort(case k % 10 {' '.join(f'when {n} then {g}::int[]' for n, g in enumerate(_GAPS))} end) gaps from o),
    x as (select k, m, gaps, [case when not list_contains(gaps, i::int) then ((k * (i + 3) + c * (i * i + 1)) % 201 - 100) / 1000.0::double end for i in range(0, 30)] x from g),
    h as (select *, list_distinct([(i - 4) // 2 for i in gaps]) nodes, [0.0005::double + 0.001::double * (i % 3) for i in range(0, 30)] mu, 0.05::double + 0.001::double * m sc, 0.3::double + 0.02::double * m rho from x),
    y as (select *, case when len(gaps) = 0 then 'observed' when len(list_filter(gaps, lambda i: i < 4)) > 0 then 'core input' when len(nodes) > 2 then 'too many nodes' when len(gaps) > 4 then 'too many features' end reason,
        rho / (1 - rho + 1e-8::double + (30 - len(gaps)) * rho) w, list_sum([case when x[i + 1] is not null then (x[i + 1] - mu[i + 1]) / sc else 0 end for i in range(0, 30)]) total from h),
    z as (select *, w * total est, 1 - rho * w * (30 - len(gaps)) va, rho - rho * w * (30 - len(gaps)) co from y where reason is null),
    f1 as (select *, sqrt(va) l1, co / sqrt(va) c1 from z), f2 as (select *, sqrt(va - c1 * c1) l2, (co - c1 * c1) / sqrt(va - c1 * c1) c2 from f1), f3 as (select *, sqrt(va - c1 * c1 - c2 * c2) l3, (co - c1 * c1 - c2 * c2) / sqrt(va - c1 * c1 - c2 * c2) c3 from f2), f4 as (select *, sqrt(va - c1 * c1 - c2 * c2 - c3 * c3) l4 from f3),
    dr as (select -1 id, [0, 0, 0, 0]::double[] z union all select id, [sin((id % 32) * 12.9898::double + j) * 1.5::double * case when id < 32 then 1 else -1 end for j in range(0, 4)] from range(0, 64) q(id)),
    v as (select k, m, gaps, x, id, [mu[gaps[r] + 1] + sc * (est + d) for d, r in [l1 * z[1], c1 * z[1] + l2 * z[2], c1 * z[1] + c2 * z[2] + l3 * z[3], c1 * z[1] + c2 * z[2] + c3 * z[3] + l4 * z[4]][1:len(gaps)]] vals from f4, dr),
    u as (select k, m, id, [coalesce(x[i + 1], vals[list_position(gaps, i::int)]) for i in range(0, 30)] a from v),
    b as (select *, list_sum([case when a[5 + 2 * s] > 0 and a[6 + 2 * s] > 0 then 1 << s else 0 end for s in range(0, 11)])::int up, list_sum([case when a[5 + 2 * s] < 0 and a[6 + 2 * s] < 0 then 1 << s else 0 end for s in range(0, 11)])::int down from u),
    ed as (select m::int m, a::int a, b::int b, 0.6::double + (a * 7 + b * 3 + m) % 10 / 25 wt from range(1, 13) p(m), range(0, 11) q(a), range(0, 11) r(b) where a < b and (a + b + m) % 3 = 0),
    nr as (select m, i::int i, (sum(case when a = i then 1 << b when b = i then 1 << a else 0 end))::int near from ed, range(0, 11) q(i) group by m, i), adj as (select m, list(near order by i) near from nr group by m),
    rc(m, mask, i, reach, step) as (select m, mask::int, i::int, (1 << i)::int, 0 from adj, range(0, 2048) q(mask), range(0, 11) r(i) where mask & (1 << i) > 0
        union all select rc.m, mask, i, reach | (list_reduce([case when reach & (1 << j) > 0 then near[j + 1] else 0 end for j in range(0, 11)], lambda p, q: p | q) & mask), step + 1 from rc join adj on adj.m = rc.m where step < 10),
    big as (select m, mask, max(bit_count(reach)) n from rc where step = 10 group by m, mask), sh as (select m, mask::int mask, sum(case when mask & (1 << a) > 0 and mask & (1 << b) > 0 then wt else 0 end) / sum(wt) share from ed, range(0, 2048) q(mask) group by m, mask),
    tb as (select sh.m, sh.mask, coalesce(n, 0) / 11 n, share from sh left join big on big.m = sh.m and big.mask = sh.mask),
    gf as (select b.k, b.m, b.id, list_concat(a, [(bit_count(up) - bit_count(down)) / 11, p.n, q.n, p.share, q.share]) a from b join tb p on p.m = b.m and p.mask = up join tb q on q.m = b.m and q.mask = down),
    sc as (select k, id, hz, 1 / (1 + exp(-(list_sum([0.05::double * (([{_W}][i] + m) % 5 - 2) * hz / 30 * (v - 0.01::double) / 0.1::double for v, i in a]) - 0.2::double))) p from gf, (values (30), (60)) t(hz)),
    bd as (select k, hz, max(p) filter (id = -1) p, quantile_cont(p, [0.1, 0.9]) filter (id >= 0) q from sc group by k, hz),
    al as (select y.k, hz, y.reason, p, q[1] lo, q[2] hi from y cross join (values (30), (60)) t(hz) left join bd using (k, hz)),
    wy as (select *, case when p > 0.55 then 'bullish' when p < 0.45 then 'bearish' when p is not null then 'neutral' end d0, case when lo > 0.55 then 'bullish' when lo < 0.45 then 'bearish' when lo is not null then 'neutral' end d1, case when hi > 0.55 then 'bullish' when hi < 0.45 then 'bearish' when hi is not null then 'neutral' end d2 from al)
    select k::varchar row_id, 'm' || m version_id, hz::bigint horizon, reason, round(p + 1e-9, 6) + 0.0 p_up, round(lo + 1e-9, 6) + 0.0 low, round(hi + 1e-9, 6) + 0.0 high, d0 direction, d0 = d1 and d1 = d2 stable from wy join o using (k)"""


@query(IMPUTED)
def imputed_forecast(spark, d):
    """Orders as rows of thirty values, some missing: estimates and 64 draws through the graph of their month and its fitted models."""
    rows, versions, links, models, draws = _imputed_inputs(spark, d)
    return rounded(K.imputed_forecast(rows, versions, K.set_tables(links), draws, K.linear(models)))


@query("""with s as (select l_orderkey k, case when l_returnflag = 'R' and l_linenumber = 2 then 'fatal' when l_linestatus = 'O' and l_linenumber in (1, 3) then 'missing' else 'observed' end st, l_linenumber::varchar node, l_linenumber = 3 core from lineitem)
    select k, case when count(*) filter (st = 'fatal') > 0 then 'fatal input' when count(*) filter (core and st <> 'observed') > 0 then 'core input' when count(distinct node) filter (st = 'missing') > 2 then 'too many nodes' when count(*) filter (st = 'missing') > 4 then 'too many features' when count(distinct node) filter (st = 'observed') < 9 then 'too few sectors' end reason from s group by k""")
def input_availability(spark, d):
    li = X.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    st = I.status(~((F.col("l_linestatus") == "O") & n.isin(1, 3)), F.lit(False), (F.col("l_returnflag") == "R") & (n == 2), F.lit(True))
    return I.availability(li.select(F.col("l_orderkey").alias("k"), st.alias("status"), n.cast("string").alias("node"), (n == 3).alias("core"), F.lit("f").alias("feature")), "k")


# Feature vectors on the dense tape: S01 stands for the index, S02 for its fund


def _core(b: DataFrame) -> DataFrame:
    return R.core_features(b.where("symbol = 'S01'"), b.where("symbol = 'S02'"))


CORE = """r1 as (select session_date, minute, close / max(close) over o5 - 1 a5, close / max(close) over o15 - 1 a15, case when count(return_1) over v = 30 then stddev_pop(return_1) over v end vol from states where symbol = 'S01' window o5 as (partition by session_date order by minute range between 5 preceding and 5 preceding), o15 as (partition by session_date order by minute range between 15 preceding and 15 preceding), v as (partition by session_date order by minute range between 29 preceding and current row)),
    core as (select r1.session_date, r1.minute, a5 spx_return_5, a15 spx_return_15, vol spx_return_volatility_30, f.vwap_gap spy_vwap_gap from r1 join states f on f.symbol = 'S02' and f.session_date = r1.session_date and f.minute = r1.minute)"""
BIG = """sz as (select session_date, minute, sg, label, count(*) n from lab group by all), big as (select session_date, minute, coalesce(max(n) filter (sg = 1), 0) / 11 bu, coalesce(max(n) filter (sg = -1), 0) / 11 be from sz group by all)"""


def _unpivot(names, keys="session_date, minute::bigint as minute"):
    return f"select {keys}, unnest([{', '.join(chr(39) + n + chr(39) for n, _ in names)}]) feature, round(unnest([{', '.join(f'({e})::double' for _, e in names)}]) + 1e-9, 6) + 0.0 as value"


@query(CLUSTERS + f""", {CORE}, {BIG}, s as (select session_date, minute, sum(sg) / 11 breadth, coalesce(string_agg(case when sv is not null then symbol end, ',' order by symbol), '') st from states where symbol <= 'S10' group by all), mc as (select session_date, minute, avg(r) m from pairs group by all),
    j as (select s.*, m, coalesce(bu, 0) bu, coalesce(be, 0) be from s left join mc using (session_date, minute) left join big using (session_date, minute)),
    gw as (select *, case when st = max(st) over o then bu - max(bu) over o end g1, case when st = max(st) over o then be - max(be) over o end g2 from j window o as (partition by session_date order by minute range between 5 preceding and 5 preceding)),
    w as (select core.*, breadth, m, bu, be, g1, g2 from core join gw using (session_date, minute)) """ + _unpivot([("spx_return_5", "spx_return_5"), ("spx_return_15", "spx_return_15"), ("spx_return_volatility_30", "spx_return_volatility_30"), ("spy_vwap_gap", "spy_vwap_gap"), ("sector_signed_breadth", "breadth"), ("bullish_cluster_fraction", "bu"), ("bearish_cluster_fraction", "be"), ("bullish_growth_5", "g1"), ("bearish_growth_5", "g2"), ("mean_correlation", "m")]) + " from w")
def features_network(spark, d):
    """The ten network features."""
    b = written(X.bars(spark, d, X.DENSE))
    s, pairs, labels = _labels(spark, d, b)
    net = N.summary(s, pairs, N.largest_clusters(labels, ["session_date", "minute", "sign"]))
    return rounded(R.features_10(_core(b), net))


STATIC = "with recursive " + STATES + ", " + GRAPH + """, nodes as (select session_date, minute, sg, symbol from states where sg <> 0 and symbol <= 'S10'), ge as (select a, b from edges union all select b, a from edges),
    reach(session_date, minute, sg, a, b) as (select session_date, minute, sg, symbol, symbol from nodes union select r.session_date, r.minute, r.sg, r.a, n.symbol from reach r join ge on ge.a = r.b join nodes n on n.session_date = r.session_date and n.minute = r.minute and n.sg = r.sg and n.symbol = ge.b),
    lab as (select session_date, minute, sg, a node, min(b) label from reach group by all), """ + BIG + """, ew as (select x.session_date, x.minute, coalesce(sum(weight) filter (x.sg = 1 and y.sg = 1), 0) / sum(weight) eb, coalesce(sum(weight) filter (x.sg = -1 and y.sg = -1), 0) / sum(weight) er from edges join states x on x.symbol = a join states y on y.symbol = b and y.session_date = x.session_date and y.minute = x.minute group by 1, 2),
    br as (select session_date, minute, sum(sg) / 11 breadth from states where symbol <= 'S10' group by all)"""


@query(STATIC + ", w as (select br.*, coalesce(bu, 0) bu, coalesce(be, 0) be, eb, er from br left join big using (session_date, minute) left join ew using (session_date, minute)) select session_date, minute::bigint as minute, round(breadth + 1e-9, 6) + 0.0 sector_signed_breadth, round(bu + 1e-9, 6) + 0.0 bullish_cluster_fraction, round(be + 1e-9, 6) + 0.0 bearish_cluster_fraction, round(eb + 1e-9, 6) + 0.0 bullish_edge_fraction, round(er + 1e-9, 6) + 0.0 bearish_edge_fraction from w")
def graph_features(spark, d):
    """Breadth, clusters and edge weights on a fixed graph with live signs: what imputed draws are put through."""
    rows = states(spark, d).where(SECTORS).select("session_date", "minute", "symbol", "return_5", "vwap_gap")
    return rounded(I.rebuilt(rows, graph(spark), ["session_date", "minute"]))


MACRO_ROWS = f""", {CORE}, {RHO}, it as (select x.session_date, x.minute, macro, sum(x.sg * y.sg * rho / 3) al, sum(x.sg * abs(y.sg) * rho / 3) pr from rho join states x on x.symbol = macro join states y on y.symbol = sector and y.session_date = x.session_date and y.minute = x.minute group by 1, 2, 3 having count(*) = 3),
    tn as (select a.session_date, a.minute, (a.close - p.close) * 10 c5, (a.close - o.close) * 10 c0 from bars a left join bars p on p.symbol = a.symbol and p.session_date = a.session_date and p.minute = a.minute - 5 left join bars o on o.symbol = a.symbol and o.session_date = a.session_date and o.minute = 570 where a.symbol = 'S12'),
    w as (select core.*, breadth, coalesce(bu, 0) bu, coalesce(be, 0) be, eb, er, u.return_5 u5, u.vwap_gap ug, c5, c0 from core join br using (session_date, minute) left join big using (session_date, minute) join ew using (session_date, minute) join states u on u.symbol = 'S11' and u.session_date = core.session_date and u.minute = core.minute join tn on tn.session_date = core.session_date and tn.minute = core.minute),
    a0 as ({_unpivot([("spx_return_5", "spx_return_5"), ("spx_return_15", "spx_return_15"), ("spx_return_volatility_30", "spx_return_volatility_30"), ("spy_vwap_gap", "spy_vwap_gap"), ("sector_signed_breadth", "breadth"), ("bullish_cluster_fraction", "bu"), ("bearish_cluster_fraction", "be"), ("bullish_edge_weight_fraction", "eb"), ("bearish_edge_weight_fraction", "er"), ("USO_return_5", "u5"), ("USO_vwap_gap", "ug"), ("TNX_change_5_bps", "c5"), ("TNX_change_from_open_bps", "c0")])} from w),
    a1 as (select session_date, minute::bigint as minute, ['XLK', 'XLF', 'XLY', 'XLP', 'XLE', 'XLU', 'XLV', 'XLI', 'XLB', 'XLRE', 'XLC'][substr(symbol, 2)::int + 1] || '_' || unnest(['return_5', 'vwap_gap']) feature, round(unnest([return_5, vwap_gap]) + 1e-9, 6) + 0.0 as value from states where symbol <= 'S10'),
    a2 as (select session_date, minute::bigint as minute, case macro when 'S11' then 'USO' else 'TNX' end || '_' || unnest(['sector_alignment', 'sector_propagated_pressure']) feature, round(unnest([al, pr]) + 1e-9, 6) + 0.0 as value from it),
    ft as materialized (select * from a0 union all select * from a1 union all select * from a2)"""


@query(STATIC + MACRO_ROWS + " select * from ft")
def features_interaction(spark, d):
    """All 39 features in long form; the tape's symbols take the sectors' names."""
    return _features_39(written(X.bars(spark, d, X.DENSE)))


def _features_39(b: DataFrame) -> DataFrame:
    """The features of bars that are a table: they and their states serve a dozen readers, each of whom would make them from the ticks again."""
    keys = ["session_date", "minute"]
    spark, s = b.sparkSession, written(N.node_states(b))
    sectors = s.where(SECTORS)
    name = F.element_at(F.array(*map(F.lit, N.SECTORS)), F.substring("symbol", 2, 2).cast("int") + 1)
    nodes = sectors.where("sign <> 0").select(*keys, "sign", F.col("symbol").alias("node"))
    ends = [nodes.withColumnRenamed("node", c) for c in "ab"]
    same = ends[0].join(graph(spark).select("a", "b"), "a").join(ends[1], [*keys, "sign", "b"])
    clusters = N.largest_clusters(N.components(nodes, same, [*keys, "sign"]), [*keys, "sign"])
    weights = N.edge_participation(graph(spark), sectors.select(*keys, F.lit("g").alias("graph_id"), F.col("symbol").alias("node"), "sign"), keys)
    base = R.features_35(_core(b), sectors.withColumn("symbol", name), clusters, weights, s.where("symbol = 'S11'"), N.rates_node(b.where("symbol = 'S12'")))
    p = N.interactions(macro_links(spark), s.select(*keys, F.col("symbol").alias("node"), "sign"), keys).where("alignment is not null")
    return rounded(R.features_39(base, p.withColumn("macro", F.when(F.col("macro") == "S11", "USO").otherwise("TNX"))))


def _fits(spark, d, days: DataFrame) -> DataFrame:
    """The months' models again as two families: 39 features with interactions, 35 without, with coefficients made from a rule."""
    numbers = lambda xs: F.array(*map(F.lit, xs))
    beta = lambda n, m, k: F.array(F.lit(-0.2), *[F.lit(0.01 * (i % m - k)) * F.col("horizon") / 30 for i in range(n)])
    rows = registry(spark, d, days).drop("family", "feature_order", "mean", "scale", "beta")
    full = rows.select("*", F.lit("interaction").alias("family"), numbers(R.FEATURES_39).alias("feature_order"), numbers([0.0] * 39).alias("mean"), numbers([1.0] * 39).alias("scale"), beta(39, 5, 2).alias("beta"))
    return full.unionByName(rows.select("*", F.lit("additive").alias("family"), numbers(R.FEATURES_35).alias("feature_order"), numbers([0.0] * 35).alias("mean"), numbers([1.0] * 35).alias("scale"), beta(35, 3, 1).alias("beta")))


def _interaction(spark, d) -> DataFrame:
    b = written(X.bars(spark, d, X.DENSE))
    days = b.select("session_date").distinct()
    vectors = R.feature_vector(_features_39(b), ["session_date", "minute"])
    return R.interaction_scores(vectors, R.usable_models(_fits(spark, d, days)), F.col("minute") % 7 != 0, F.lit(700), days=days)


INTERACTION = STATIC + MACRO_ROWS + f""", od(feature, i) as (values {', '.join(f"('{n}', {i})" for i, n in enumerate(R.FEATURES_39))}),
    pt as (select session_date, minute, hz horizon, feature, i, value * 0.01::double * (i % 5 - 2) * hz / 30 lo, case when i < 35 then value * 0.01::double * (i % 3 - 1) * hz / 30 end ad from ft join od using (feature), (values (30), (60)) t(hz)),
    sm as (select session_date, minute, horizon, case when count(lo) = 39 then sum(lo) - 0.2::double end lo, sum(lo) filter (i >= 35) xlo, sum(ad) - 0.2::double ad from pt group by all),
    sc as (select *, case when minute % 7 = 0 then 'stale' when lo is null then 'incomplete' when minute + 1 + horizon > 700 then 'beyond the close' end reason from sm),
    vw as (select session_date, minute, horizon, reason, case when reason is null then lo end log_odds, case when reason is null then 1 / (1 + exp(-lo)) end p_up, case when reason is null then xlo end interaction_log_odds, case when reason is null then 1 / (1 + exp(-ad)) end additive_p_up from sc),
    vs as (select *, case when p_up > 0.55 then 'bullish' when p_up < 0.45 then 'bearish' when p_up is not null then 'neutral' end direction from vw)"""


@query(f"{INTERACTION} select session_date, minute::bigint as minute, horizon::bigint horizon, reason, direction, round(log_odds + 1e-9, 6) + 0.0 log_odds, round(p_up + 1e-9, 6) + 0.0 p_up, round(interaction_log_odds + 1e-9, 6) + 0.0 interaction_log_odds, round(additive_p_up + 1e-9, 6) + 0.0 additive_p_up from vs")
def interaction_scores(spark, d):
    """The forecast with interactions beside the additive one, at each minute and horizon."""
    return rounded(_interaction(spark, d).select("session_date", "minute", "horizon", "reason", "direction", "log_odds", "p_up", "interaction_log_odds", "additive_p_up"))


@query(f"{INTERACTION} select session_date, minute::bigint as minute, horizon::bigint horizon, split_part(feature, '_', 1) node, round(sum(pt.lo) + 1e-9, 6) + 0.0 log_odds from pt join (select session_date, minute, horizon from vw where reason is null) using (session_date, minute, horizon) where i < 35 and regexp_matches(feature, '^[A-Z]') group by all")
def node_log_odds(spark, d):
    """What each sector and macro node adds to the interaction forecast."""
    keys = ["session_date", "minute", "horizon"]
    return rounded(R.node_contributions(_interaction(spark, d), keys))


@query(f"""with {STATES}, {GRAPH}, {RHO}, lk as (select macro source, sector target, 'macro-sector' kind, rho, abs(rho) strength from rho union all select a, b, 'sector-sector', weight / 2, weight from edges),
    f as (select x.session_date, x.minute, source, target, kind, case when x.minute % 7 <> 0 then x.sg * y.sg * rho / case kind when 'macro-sector' then 3 else 1 end end alignment, case when x.minute % 7 <> 0 and kind = 'macro-sector' then x.sg * abs(y.sg) * rho / 3 end pressure,
    coalesce(x.minute % 7 <> 0 and x.sg <> 0 and y.sg <> 0 and strength > 0, false) active, g.session_date sd, g.minute mi from lk cross join (select distinct session_date, minute from states) g left join states x on x.symbol = source and x.session_date = g.session_date and x.minute = g.minute left join states y on y.symbol = target and y.session_date = x.session_date and y.minute = x.minute)
    select sd session_date, mi::bigint as minute, source, target, kind, active, round(alignment + 1e-9, 6) + 0.0 alignment, round(pressure + 1e-9, 6) + 0.0 pressure from f""")
def edge_activation(spark, d):
    """State of every edge of the saved graph at each minute; every seventh minute counts as stale."""
    macro = macro_links(spark).select(F.col("macro").alias("source"), F.col("sector").alias("target"), F.lit("macro-sector").alias("kind"), "rho", F.abs("rho").alias("strength"))
    links = macro.unionByName(graph(spark).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("sector-sector").alias("kind"), (F.col("weight") / 2).alias("rho"), F.col("weight").alias("strength")))
    nodes = states(spark, d).select("session_date", "minute", F.col("symbol").alias("node"), "sign")
    return rounded(N.edge_states(links, nodes, ["session_date", "minute"], F.col("minute") % 7 != 0))
