"""Evaluation audits, alerts and scalar checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import alerts as A
from ..operators import evaluate as E
from ..sources import calendar as K
from . import fixtures as X
from .registry import query, rounded

OUT = "o as (select l.doc_id, d.source, (d.n_chars % 1000) / 999 p, l.toxic y from labels l join documents d using (doc_id))"


def outcomes(spark, d) -> DataFrame:
    docs = X.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return X.table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "source", ((F.col("n_chars") % 1000) / 999).alias("p"), F.col("toxic").alias("y"))


@query(f"with {OUT} select source, round(avg((p - y) ** 2) + 1e-9, 6) + 0.0 brier, round(avg((0.5 - y) ** 2) + 1e-9, 6) + 0.0 baseline, count(*) n, 0::bigint invalid from o group by source")
def brier_scores(spark, d):
    return rounded(E.brier(outcomes(spark, d), "source"))


@query(f"with {OUT} select least(floor(p * 10), 9)::bigint bin, round(avg(p) + 1e-9, 6) + 0.0 mean_p, round(avg(y) + 1e-9, 6) + 0.0 frequency, count(*) n from o group by 1")
def calibration_bins(spark, d):
    return rounded(E.calibration(outcomes(spark, d)))


@query("""select l_orderkey trade_id, sum((case when l_linenumber % 2 = 0 then -1 else 1 end) * l_quantity::bigint * ((l_extendedprice * 100)::bigint % 1000 - 500) * 100)::bigint gross_cents, sum(2 * l_quantity::bigint * (65 + 5 * 100))::bigint cost_cents,
    sum((case when l_linenumber % 2 = 0 then -1 else 1 end) * l_quantity::bigint * ((l_extendedprice * 100)::bigint % 1000 - 500) * 100)::bigint - sum(2 * l_quantity::bigint * 565)::bigint net_cents from lineitem group by 1""")
def round_trips(spark, d):
    li = X.table(spark, d, "lineitem")
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    legs = li.select(F.col("l_orderkey").alias("trade_id"), (sign * F.col("l_quantity").cast("long")).alias("quantity"), F.lit(500).alias("entry_cents"), (F.round(F.col("l_extendedprice") * 100).cast("long") % 1000).alias("exit_cents"))
    return E.round_trips(legs, fee=65, slip=5)


@query("""with d as (select o_orderpriority book, o_orderdate::date as day, sum((o_totalprice * 100)::bigint - 25000000) cents from orders group by all), e as (select *, sum(cents) over (partition by book order by day rows unbounded preceding) eq from d),
    p as (select *, greatest(0, max(eq) over (partition by book order by day rows unbounded preceding)) pk from e) select book, max(pk - eq)::bigint drawdown_cents from p group by book""")
def drawdowns(spark, d):
    o = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("book"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long") - 25000000).alias("cents"))
    return E.max_drawdown(o, "book")


CHRONO = "c as (select event_id, ts bar_end, ts + to_seconds((event_id % 5 - 1)::int) available_at, ts + to_seconds((event_id % 7)::int) decision_at, ts + interval 7 second entry_at, ts + to_seconds((5 + event_id % 11)::int) exit_at, case when event_id % 13 <> 0 then ts + interval 20 second end deadline_at from events)"


@query(f"with {CHRONO} select event_id, case when available_at < bar_end then 'available_at' when decision_at < available_at then 'decision_at' when entry_at < decision_at then 'entry_at' when exit_at < entry_at then 'exit_at' when deadline_at is null or deadline_at < exit_at then 'deadline_at' end violation from c")
def chronology_audit(spark, d):
    sec = lambda n: F.make_dt_interval(secs=n)
    e, t = F.col("event_id"), F.col("ts")
    rows = X.table(spark, d, "events").select("event_id", t.alias("bar_end"), (t + sec(e % 5 - 1)).alias("available_at"), (t + sec(e % 7)).alias("decision_at"), (t + sec(F.lit(7))).alias("entry_at"), (t + sec(5 + e % 11)).alias("exit_at"), F.when(e % 13 != 0, t + sec(F.lit(20))).alias("deadline_at"))
    return E.chronology(rows).select("event_id", "violation")


@query("""with m as (select s_suppkey model_id, timestamp '1995-01-01' + to_days((s_suppkey * 17 % 2000)::int) lt from supplier) select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem join m on model_id = l_suppkey where not lt < l_shipdate""")
def training_leaks(spark, d):
    m = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"), (F.lit("1995-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("s_suppkey") * 17 % 2000).cast("int"))).alias("labels_through"))
    dec = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_suppkey").alias("model_id"), F.col("l_shipdate").alias("decision_at"))
    return E.leaks(dec, m).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def reversal_samples(spark, d) -> DataFrame:
    """A session for each user: codes by value, one usable sample for most events, a review now and then."""
    v = F.floor("value").cast("long")
    codes = F.array(*[F.lit(c) for c in ("EXT-UP-COOLING", "EXT-UP-REBOUND", "INSIDE-RISE", "EXT-UP-FAILURE")])
    e = X.table(spark, d, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scope"), F.col("event_id").cast("int").alias("seq"), ((F.col("event_id") % 400) + 570).cast("int").alias("cutoff"), F.when(v % 6 < 4, F.element_at(codes, (v % 6 % 4).cast("int") + 1)).alias("code"), (F.col("event_type") != "error").alias("usable"), (v % 11 == 0).alias("acknowledged"))


@query()
def reversal_fold(spark, d):
    """End state of every scope; tests compare it with the plain step."""
    return rounded(A.warnings(reversal_samples(spark, d)))


@query("""with s as (select 'u' || user_id scope_id, floor(value)::bigint v, event_type from events), c as (select *, case when v % 6 < 4 then ['EXT-UP-COOLING', 'EXT-UP-REBOUND', 'INSIDE-RISE', 'EXT-UP-FAILURE'][(v % 6)::int + 1] end code from s)
    select code, case when code = 'EXT-UP-REBOUND' then 'bullish' else 'bearish' end direction, case when code = 'EXT-UP-REBOUND' then 'bearish' else 'bullish' end review, count(*) n from c where code in ('EXT-UP-COOLING', 'EXT-UP-REBOUND', 'EXT-UP-FAILURE') group by all""")
def reversal_copy(spark, d):
    s = reversal_samples(spark, d).withColumn("code", A.detected_code(F.array("code"))).where("code is not null")
    return s.withColumn("c", A.copy_of(F.col("code"))).groupBy("code", "c.direction", "c.review").agg(F.count("*").alias("n"))


@query(r"""with e as (select event_id, case event_id % 6 when 0 then value::varchar when 1 then '' when 2 then 'NaN' when 3 then 'inf' when 4 then ' x' else props end t from events)
    select event_id, case when event_id % 6 = 0 then t::double end num, case when regexp_matches(upper(trim(t)), '^[A-Z0-9^=._/-]{1,40}$') then upper(trim(t)) end sym from e""")
def coercions(spark, d):
    k = F.col("event_id") % 6
    t = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "").when(k == 2, "NaN").when(k == 3, "inf").when(k == 4, " x").otherwise(F.col("props"))
    e = X.table(spark, d, "events").withColumn("t", t)
    return e.select("event_id", C.number(F.col("t")).alias("num"), C.symbol_name(F.col("t")).alias("sym"))


@query(r"""with e as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then '2026-02-30' when 2 then strftime(o_orderdate, '%Y/%m/%d') else '2026-1-5' end t, o_orderdate::date d from orders)
    select o_orderkey, case when o_orderkey % 4 = 0 then t::date end strict, coalesce(case when o_orderkey % 4 = 0 then t::date end between date '1996-01-01' and date '1998-12-31', false) inside from e""")
def strict_dates(spark, d):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, "2026-02-30").when(k == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("2026-1-5")
    s = C.strict_date(t)
    return X.table(spark, d, "orders").select("o_orderkey", s.alias("strict"), F.coalesce(C.in_range(s, F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date")), F.lit(False)).alias("inside"))


@query("""with e as (select event_id, ts, ((ts at time zone 'UTC') at time zone 'America/New_York') l from events) select event_id, l::date session_date, (extract(hour from l) * 60 + extract(minute from l))::bigint as minute, case when extract(microsecond from ts) % 60000000 < 1000 then 'on' else 'off' end grid from e""")
def eastern_minutes(spark, d):
    e = X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    date, minute = C.to_eastern(F.col("ts"))
    return rounded(e.select("event_id", date.alias("session_date"), minute.alias("minute"), C.grid_status(F.col("ts")).alias("grid")))


@query("""with o as (select o_orderkey, case when o_orderkey % 50 = 0 then timestamp '2026-03-08 02:30:00' when o_orderkey % 50 = 1 then timestamp '2026-11-01 01:30:00' else o_orderdate + to_minutes((o_orderkey % 1440)::int) end w from orders), l as (select *, w at time zone 'America/New_York' z from o)
    select o_orderkey, case when ((z at time zone 'America/New_York') = w) and not ((z + interval 1 hour) at time zone 'America/New_York' = w) and not ((z - interval 1 hour) at time zone 'America/New_York' = w) then strftime(z at time zone 'UTC', '%Y-%m-%d %H:%M:%S') end utc from l""")
def eastern_wall_clock(spark, d):
    k = F.col("o_orderkey") % 50
    w = F.when(k == 0, "2026-03-08 02:30:00").when(k == 1, "2026-11-01 01:30:00").otherwise(F.date_format(F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int")), "yyyy-MM-dd HH:mm:ss"))
    return X.table(spark, d, "orders").select("o_orderkey", F.date_format(C.eastern_to_utc(w), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("""with o as (select distinct o_orderdate::date d from orders) select d session_date, strftime((d + to_minutes(570)) at time zone 'America/New_York' at time zone 'UTC', '%Y-%m-%d %H:%M:%S') opens, strftime((d + to_minutes(959) + to_seconds(59)) at time zone 'America/New_York' at time zone 'UTC', '%Y-%m-%d %H:%M:%S') closes from o""")
def session_clock(spark, d):
    o = X.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("session_date")).distinct()
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return o.select("session_date", show(C.session_utc(F.col("session_date"), F.lit(570))).alias("opens"), show(C.session_utc(F.col("session_date"), F.lit(959), end=True)).alias("closes"))


@query("""with r as (select min(o_orderdate)::date a, max(o_orderdate)::date b from orders), d as (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date session_date from r),
    h as (select distinct o_orderdate::date session_date from orders where o_custkey % 97 = 0), e as (select o_orderdate::date session_date, min(780 + o_custkey % 60) cm from orders where o_custkey % 89 = 0 group by 1)
    select d.session_date, 570::bigint open_minute, coalesce(e.cm, 960)::bigint close_minute, dayofweek(d.session_date) in (0, 6) or h.session_date is not null closed, d.session_date between date '1995-06-01' and date '1999-06-01' verified,
        case when dayofweek(d.session_date) in (0, 6) then 'weekend' when h.session_date is not null then 'holiday' when e.cm is not null then 'early' else 'regular' end kind from d left join h using (session_date) left join e using (session_date)""")
def cash_calendar(spark, d):
    """Every day of the orders' span, with holidays and early closes by rule."""
    o = X.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_custkey")
    a, b = o.agg(F.min("date"), F.max("date")).first()
    closed = o.where("o_custkey % 97 = 0").select("date").distinct()
    early = o.where("o_custkey % 89 = 0").groupBy("date").agg(F.min(780 + F.col("o_custkey") % 60).cast("int").alias("close_minute"))
    return rounded(K.calendar(spark, str(a), str(b), closed, early, "1995-06-01", "1999-06-01"))
