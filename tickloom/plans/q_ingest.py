"""Sources, sinks and point-in-time reads. Landed files are written from the given tables, in each provider's shape, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.shared import shared_dir
from ..operators import bars as B
from ..sources import archive as A
from ..sources import calendar as K
from ..sources import ingest as I
from . import fixtures as X
from .registry import query, rounded, shown


def _bars(spark, d) -> DataFrame:
    """Bars with a UTC time; every 17th minute lacks a price."""
    ts = C.session_utc(F.col("session_date"), F.col("minute"))
    return X.bars(spark, d).withColumns({"ts": ts, "low": F.when(F.col("minute") % 17 != 0, F.col("low"))})


@query(shown(X.bars_sql() + ", f as (select * from bars where minute % 17 <> 0)", "f", "symbol session_date minute:l open:d high:d low:d close:d volume:d"))
def read_chart_json(spark, d):
    """Parallel arrays of each symbol and session."""
    path = shared_dir(spark)
    b = _bars(spark, d).withColumn("timestamp", F.unix_timestamp("ts"))
    arrays = b.groupBy("symbol", "session_date").agg(F.array_sort(F.collect_list(F.struct("timestamp", "open", "high", "low", "close", "volume"))).alias("x"))
    arrays.select(F.lower("symbol").alias("symbol"), *[F.col(f"x.{c}").alias(c) for c in ("timestamp", "open", "high", "low", "close", "volume")]).write.json(path)
    rows = I.chart_json(spark, path)
    date, minute = C.to_eastern(F.col("ts"))
    return rounded(rows.select("symbol", "session_date", minute.alias("minute"), "open", "high", "low", "close", "volume"))


DAILY = "dl as (select o_orderdate::date session_date, min(o_totalprice) low, max(o_totalprice) high, count(*)::double volume from orders group by 1)"


@query(f"with {DAILY} select 'ORD' symbol, session_date, round(low + 1e-9, 6) + 0.0 as open, round(high + 1e-9, 6) + 0.0 high, round(low + 1e-9, 6) + 0.0 low, round(high + 1e-9, 6) + 0.0 as close, volume + 0.0 volume, 'session-date' ts_kind from dl")
def read_daily_csv(spark, d):
    path = shared_dir(spark)
    o = X.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.min("o_totalprice").alias("Open"), F.max("o_totalprice").alias("High"), F.min("o_totalprice").alias("Low"), F.max("o_totalprice").alias("Close"), F.count("*").alias("Volume"))
    o.write.csv(path, header=True)
    return rounded(I.daily_csv(spark, path, "ORD").where("corrupt is null").select("symbol", "session_date", "open", "high", "low", "close", "volume", "ts_kind"))


@query("select 'RATE' series, o_orderdate::date as date, max(o_totalprice) / 100000 as value from orders group by o_orderdate::date having count(*) % 5 <> 0")
def read_rate_csv(spark, d):
    """A dot stands for a missing value."""
    path = shared_dir(spark)
    o = X.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.when(F.count("*") % 5 == 0, ".").otherwise((F.max("o_totalprice") / 100000).cast("string")).alias("value"))
    o.write.csv(path, header=True)
    return I.rate_csv(spark, path, "RATE")


@query("""with p as (select page_id, url from pages where regexp_matches(url, '^https://')), h as (select *, regexp_extract(url, '^https?://([^/:?#]+)', 1) host, timestamp '2026-01-01' + to_seconds((page_id * 37 % 86400)::int) t from p)
    select 'page ' || page_id title, url link, strftime(t, '%Y-%m-%d %H:%M:%S') published from h where host like '%.net' order by t desc, url limit 100""")
def read_rss(spark, d):
    """Feed items written as XML; the newest hundred of allowed hosts."""
    path = shared_dir(spark)
    p = X.table(spark, d, "pages")
    t = F.timestamp_seconds(F.lit(1767225600) + F.col("page_id") * 37 % 86400)
    p.select(F.concat(F.lit("page "), F.col("page_id")).alias("title"), F.col("url").alias("link"), F.concat(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("pubDate")).write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    hosts = p.select(F.parse_url("url", F.lit("HOST")).alias("host")).where("host like '%.net'").distinct()
    return I.rss(spark, path, hosts, 100).select("title", "link", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""select p_partkey, 'SPXW' root, date '2026-01-05' expiration, p_retailprice strike, case when p_partkey % 2 = 0 then 'CALL' else 'PUT' end as "right", p_size / 4 bid, p_size / 4 + 0.5 ask, p_size / 100 vega, strftime(timestamp '2026-01-05 14:30:00' + to_seconds((p_partkey % 23400)::int), '%Y-%m-%d %H:%M:%S') seen_at from part""")
def read_option_json(spark, d):
    path = shared_dir(spark)
    p = X.table(spark, d, "part")
    wall = F.date_format(F.timestamp_seconds(F.lit(1767605400) + F.col("p_partkey") % 23400), "yyyy-MM-dd'T'HH:mm:ss")
    point = F.struct(wall.alias("timestamp"), (F.col("p_size") / 4).alias("bid"), (F.col("p_size") / 4 + 0.5).alias("ask"), F.col("p_size").cast("double").alias("vega"), F.col("p_partkey").cast("double").alias("underlying_price"), wall.alias("underlying_timestamp"))
    p.select(F.struct(F.lit("SPXW").alias("root"), F.lit("2026-01-05").alias("expiration"), F.col("p_retailprice").alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "c").otherwise("put").alias("right")).alias("contract"), F.array(point).alias("data")).write.json(path)
    rows = I.option_json(spark, path)
    return rows.select(F.col("underlying_price").cast("long").alias("p_partkey"), "root", "expiration", "strike", "right", "bid", "ask", "vega", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


@query(shown(X.bars_sql(), "bars", "symbol session_date minute:l close:d").replace(" from bars", ", null::double volume from bars"))
def read_index_json(spark, d):
    path = shared_dir(spark)
    wall = F.date_format(F.timestamp_seconds(F.unix_date("session_date") * 86400 + F.col("minute") * 60), "yyyy-MM-dd HH:mm:ss")
    X.bars(spark, d).select("symbol", wall.alias("timestamp"), "open", "high", "low", "close", "volume").write.json(path)
    rows = I.price_json(spark, path, index=True)
    return rounded(rows.select("symbol", "session_date", C.to_eastern(F.col("ts"))[1].alias("minute"), "close", "volume"))


@query("""with e as (select event_id, value v, event_id % 3 k from events) select event_id, unnest(case k when 0 then [v] when 1 then [v, v + 1] else [v, v + 1, v + 2] end) price from e""")
def read_one_or_many(spark, d):
    """A field that is one object or a list."""
    e = X.table(spark, d, "events")
    one = lambda n: F.format_string('{"price": %s}', (F.col("value") + n).cast("string"))
    text = F.when(F.col("event_id") % 3 == 0, one(0)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), one(0), F.lit(","), one(1), F.lit("]"))).otherwise(F.concat(F.lit("["), one(0), F.lit(","), one(1), F.lit(","), one(2), F.lit("]")))
    rows = e.withColumn("t", text)
    return rows.select("event_id", F.explode(I.one_or_many("t", "struct<price:double>")).alias("x")).select("event_id", "x.price")


EVENTS = "e as (select event_id, user_id, event_type, value, ts, ts + to_seconds((event_id % 600)::int) first_seen, ts + to_seconds((event_id % 400)::int - 200) greeks_ts from events), cut as (select max(ts) - interval 5 day c from events)"


def _facts(spark, d):
    e = X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sec = lambda n: F.make_dt_interval(secs=n)
    return e.select("event_id", "user_id", "event_type", F.col("value").alias("gamma"), "ts", (F.col("ts") + sec(F.col("event_id") % 600)).alias("first_seen_ts"), (F.col("ts") + sec(F.col("event_id") % 400 - 200)).alias("greeks_ts"), F.when(F.col("event_id") % 9 == 0, "session-date").when(F.col("event_id") % 2 == 0, "bar-open").otherwise("quote").alias("ts_kind"), F.lit("5m").alias("interval"))


@query(f"with {EVENTS} select event_id, case when not coalesce(greeks_ts > c, false) then value end gamma from e, cut where ts <= c and first_seen <= c and event_id % 9 <> 0 and (event_id % 2 <> 0 or ts + interval 5 minute <= c)")
def point_in_time(spark, d):
    f = _facts(spark, d)
    cut = F.lit(f.agg(F.max("ts")).first()[0]) - F.expr("interval 5 days")
    return A.known_at(f, cut).select("event_id", "gamma")


@query(f"with {EVENTS} select event_id, case when event_id % 7 <> 0 and greeks_ts <= c then value end open_interest from e, cut")
def interest_withheld(spark, d):
    f = _facts(spark, d).withColumn("oi_ts", F.when(F.col("event_id") % 7 != 0, F.col("greeks_ts"))).withColumn("open_interest", F.col("gamma"))
    cut = F.lit(f.agg(F.max("ts")).first()[0]) - F.expr("interval 5 days")
    return A.withheld_interest(f, cut).select("event_id", "open_interest")


@query("""with e as (select user_id, event_type, ts, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) n from events), k as (select user_id, event_type, date_trunc('hour', ts) h from events union all select user_id, event_type, date_trunc('hour', ts) from events where event_id % 2 = 0),
    g as (select user_id, h, count(distinct event_type) v, count(*) n, max(event_type) t from k group by all) select user_id, strftime(h, '%Y-%m-%d %H') as "hour", v = 1 clean, case when v = 1 then t end event_type, n from g""")
def duplicate_conflicts(spark, d):
    """Equal duplicates collapse, different ones under one key are reported."""
    e = X.table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type", "event_id")
    rows = e.unionByName(e.where("event_id % 2 = 0")).drop("event_id")
    good, bad = I.clean(rows, ["user_id", "hour"])
    n = rows.groupBy("user_id", "hour").agg(F.count("*").alias("n"))
    both = good.select("user_id", "hour", F.lit(True).alias("clean"), "event_type").unionByName(bad.select("user_id", "hour", F.lit(False).alias("clean"), F.lit(None).cast("string").alias("event_type")))
    return both.join(n, ["user_id", "hour"])


@query("""with e as (select user_id, event_type, value, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 end p from events), b as (select user_id, min(p) m from e group by 1) select user_id, event_type provider, count(*) n from e join b using (user_id) where p = m group by all""")
def provider_priority(spark, d):
    pr = spark.createDataFrame([("view", 1, True), ("click", 2, True), ("purchase", 3, True), ("error", 0, False)], "provider string, priority int, enabled boolean")
    e = X.table(spark, d, "events").withColumnRenamed("event_type", "provider")
    return I.by_priority(e, pr, ["user_id"]).groupBy("user_id", "provider").agg(F.count("*").alias("n"))


@query("""with e as (select event_type, case when event_type = 'error' then null when event_type = 'click' and event_id % 2 = 0 then null else ts end ts from events) select event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as_of, strftime(min(ts), '%Y-%m-%d %H:%M:%S') oldest, count(*) as "rows", case when count(ts) = 0 then 'unavailable' when count(ts) < count(*) then 'partial' else 'ok' end status from e group by 1""")
def provenance(spark, d):
    e = X.table(spark, d, "events")
    ts = F.when(F.col("event_type") == "error", None).when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0), None).otherwise(F.col("ts"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return I.envelope(e.withColumn("ts", ts), "event_type").select("event_type", show("as_of").alias("as_of"), show("oldest_as_of").alias("oldest"), "rows", "status")


@query("""select event_id, case event_type when 'error' then 'delayed' when 'view' then 'daily' else 'realtime' end source_mode, case event_type when 'error' then 900 else 0 end::bigint delay_seconds from events""")
def source_delays(spark, d):
    inst = spark.createDataFrame([("error", "p", "delayed", 900), ("view", "p", "daily", 0)], "symbol string, provider string, mode string, delay_seconds int")
    e = X.table(spark, d, "events").withColumnRenamed("event_type", "symbol")
    return rounded(I.labelled(e, inst).select("event_id", "source_mode", "delay_seconds"))


@query("""with l as (select user_id, max(ts) m from events where event_type <> 'error' group by 1), n as (select max(ts) t from events), r as (select range user_id from range(0, 200)) select bool_and(coalesce(date_diff('millisecond', m, t) / 1000.0 - 60 <= 7200, false)) "current", count(*) filter (not coalesce(date_diff('millisecond', m, t) / 1000.0 - 60 <= 7200, false)) late from r left join l using (user_id), n""")
def feed_freshness(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "delayed").otherwise("realtime").alias("source_mode"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return A.freshness(spark.range(200).withColumnRenamed("id", "symbol"), e, now, 7200)


@query("""select user_id, count(*) filter (event_type = 'signup') synthetic, count(*) filter (event_type <> 'signup') observed, count(*) filter (event_type = 'signup') > 0 and count(*) filter (event_type <> 'signup') > 0 refused from events group by 1""")
def mode_mixing(spark, d):
    e = X.table(spark, d, "events").withColumn("source_mode", F.when(F.col("event_type") == "signup", "synthetic").otherwise("realtime"))
    return A.one_class(e, "user_id")


@query("""with p as (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date as date), u as (select distinct user_id from events), h as (select user_id, ts::date as date from events where event_type = 'purchase' group by all), g as (select * from u cross join p) select user_id::varchar symbol, date from g anti join h using (user_id, date)""")
def backfill(spark, d):
    """Days of each user without a verified entry."""
    e = X.table(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("date"), "event_type")
    return A.backfill_plan(spark, e, "2024-01-01", "2024-01-30", "2024-02-01", e.where("event_type = 'purchase'").select("symbol", "date").distinct())


@query("""select event_type kind, count(*) n, 'ok' as "check", strftime(ts::date, '%Y-%m-%d') as date from events where ts < timestamp '2024-01-11' group by all""")
def archive_round_trip(spark, d):
    """Written by provider, kind, symbol and date, verified against the manifest, and scanned with a date filter that prunes."""
    path = shared_dir(spark)
    e = X.table(spark, d, "events").select(F.lit("p").alias("provider"), F.col("event_type").alias("kind"), F.lit("ALL").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_id", "value", "user_id")
    A.write_archive(e, path)
    checks = A.verify(spark, path).select("kind", "date", "check")
    rows = A.scan(spark, path, end="2024-01-10").groupBy("kind", "date").agg(F.count("*").alias("n"))
    return rows.join(checks, ["kind", "date"])


@query("""with c as (select event_type kind, strftime(ts::date, '%Y-%m-%d') as date, count(*) n from events group by all)
    select kind, date, case kind when 'purchase' then 'missing' else 'ok' end as "check", kind in ('purchase', 'error') has_foreign, case kind when 'purchase' then 0 else n end n from c""")
def archive_damage(spark, d):
    """Purchases are written over behind the archive's back and errors get files that are no tables: both are told, and all sound entries are read."""
    path = shared_dir(spark)
    e = X.table(spark, d, "events").select(F.lit("p").alias("provider"), F.col("event_type").alias("kind"), F.lit("ALL").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_id", "value", "user_id")
    batch = A.write_archive(e, path).first()[A.BATCH]
    folder = f"{path}/data/{A.BATCH}={batch}"
    e.where("kind = 'purchase'").withColumn("value", F.col("value") + 1).repartition(*A.PARTITIONS).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*A.PARTITIONS).parquet(folder)
    e.where("kind = 'error'").select(F.lit("no table").alias("line"), *A.PARTITIONS).distinct().write.mode("append").partitionBy(*A.PARTITIONS).text(folder)
    checks = A.verify(spark, path).select("kind", "date", "check", (F.col("foreign") > 0).alias("has_foreign"))
    rows = A.scan(spark, path).groupBy("kind", "date").agg(F.count("*").alias("n"))
    return checks.join(rows, ["kind", "date"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""select o_orderkey, sha256('date=' || strftime(o_orderdate, '%Y-%m-%d') || case when o_orderkey % 3 <> 0 then '&kind=' || o_orderpriority else '' end || '&symbol=' || o_custkey) "key" from orders""")
def request_keys(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("kind"), F.col("o_custkey").alias("symbol"))
    return o.select("o_orderkey", A.request_key("symbol", "kind", "date").alias("key"))


@query(shown(X.bars_sql() + ", b as (select *, minute % 17 <> 0 and low > 0 ok from bars), f as (select session_date, symbol, count(*) filter (ok) valid, count(*) filter (not ok) invalid from b group by all)", "f", "symbol session_date valid:l invalid:l"))
def bar_validity(spark, d):
    b = _bars(spark, d).withColumn("ok", C.valid_bar(True))
    return b.groupBy("symbol", "session_date").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


@query(shown(X.bars_sql() + ", f as (select * from bars where minute % 17 <> 0 and minute <= 700 and minute % 13 <> 0 and minute % 11 <> 0)", "f", "symbol session_date minute:l close:d"))
def minute_admission(spark, d):
    """Rows of another interval, or off the grid, or without a price, or after the cutoff are not admitted."""
    m = F.col("minute")
    rows = _bars(spark, d).withColumns({"interval": F.when(m % 13 == 0, "5m").otherwise("1m"), "ts_kind": F.lit("bar-open"), "ts": F.when(m % 11 == 0, F.col("ts") + F.make_dt_interval(secs=F.lit(7))).otherwise(F.col("ts"))}).drop("minute")
    return rounded(B.admitted(rows, F.lit(700)).select("symbol", "session_date", "minute", "close"))


@query("""select event_id from events where coalesce(case when event_id % 4 = 0 then date '2024-01-15' end, ts::date) between date '2024-01-10' and date '2024-01-15'""")
def date_override(spark, d):
    """A session date counts before the date of the time."""
    e = X.table(spark, d, "events").withColumn("session_date", F.when(F.col("event_id") % 4 == 0, F.lit("2024-01-15").cast("date")))
    return B.between_dates(e, F.lit("2024-01-10").cast("date"), F.lit("2024-01-15").cast("date")).select("event_id")


@query("""with c as (select distinct o_orderdate::date session_date from orders) select o_orderkey, case when dayofweek(o_orderdate) not in (0, 6) and o_orderdate::date between date '1995-06-01' and date '1999-06-01' then o_totalprice end price from orders""")
def calendar_gate(spark, d):
    """On closed or unverified days there is no reading."""
    o = X.table(spark, d, "orders").withColumn("session_date", F.to_date("o_orderdate"))
    a, b = o.agg(F.min("session_date"), F.max("session_date")).first()
    none = spark.createDataFrame([], "date date, close_minute int")
    cal = K.calendar(spark, str(a), str(b), none.select("date"), none, "1995-06-01", "1999-06-01")
    return K.gated(o.withColumn("price", F.col("o_totalprice")), cal, ["price"]).select("o_orderkey", "price")


@query("""select event_id, user_id, value, null::double price from events where event_type = 'click' union all select event_id, user_id, null, value from events where event_type = 'view'""")
def kinds_united(spark, d):
    e = X.table(spark, d, "events")
    return B.united(e.where("event_type = 'click'").select("event_id", "user_id", "value"), e.where("event_type = 'view'").select("event_id", "user_id", F.col("value").alias("price")))
