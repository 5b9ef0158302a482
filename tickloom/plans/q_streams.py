"""Live semantics: each query streams the given tables to the end and returns what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..operators import chain as H
from ..operators import ema as E
from ..streaming import live as S
from . import fixtures as X
from . import q_bars, q_news
from .q_evaluate import reversal_samples
from .registry import query, rounded, shown


def _events(spark, d) -> DataFrame:
    schema = X.table(spark, d, "events").schema
    # a pattern, as a stream reads folders and the table may be one file
    return S.landed(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _ticks(spark, d) -> DataFrame:
    return _events(spark, d).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("nth"))


def _bars_sql(minutes: int) -> str:
    return f"""with e as (select *, time_bucket(interval {minutes} minute, ts) w from events), m as (select date_trunc('milliseconds', max(ts)) - interval 2 minute t from events), g as (select event_type symbol, w, first(value order by ts, event_id) as open, max(value) high, min(value) low, last(value order by ts, event_id) as close, count(*)::double volume from e group by all)
    select symbol, strftime(w, '%Y-%m-%d %H:%M:%S') seen_at, open, high, low, close, volume from g, m where w + interval {minutes} minute <= t"""


def _bars(spark, d, minutes):
    bars = S.completed_bars(_ticks(spark, d), minutes)
    return S.finished(bars, shared_dir(spark)).withColumn("seen_at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts")


@query(_bars_sql(1))
def stream_minute_bars(spark, d):
    return _bars(spark, d, 1)


@query(_bars_sql(10))
def stream_ten_minute_bars(spark, d):
    return _bars(spark, d, 10)


@query("""with e as (select *, time_bucket(interval 10 minute, ts, interval 5 minute) w from events), m as (select date_trunc('milliseconds', max(ts)) - interval 2 minute t from events), g as (select event_type symbol, w, first(value order by ts, event_id) as open, max(value) high, min(value) low, last(value order by ts, event_id) as close, count(*)::double volume from e group by all)
    select symbol, strftime(w, '%Y-%m-%d %H:%M:%S') seen_at, open, high, low, close, volume from g, m where w + interval 10 minute <= t""")
def stream_offset_bars(spark, d):
    """Ten-minute windows that begin at five past, as those of a session that opens off the clock's tens."""
    bars = S.completed_bars(_ticks(spark, d), 10, offset="5 minutes")
    return S.finished(bars, shared_dir(spark)).withColumn("seen_at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts")


@query("select event_id from events where event_id % 200 <= 60")
def stream_known_in_time(spark, d):
    e = _events(spark, d).withColumn("first_seen_ts", F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 200))
    return S.finished(S.known_in_time(e).select("event_id"), shared_dir(spark))


@query("select distinct user_id from events")
def stream_distinct(spark, d):
    """Repeats within the watermark's span are dropped; all events are in one span here."""
    e = _events(spark, d).select("user_id", "ts")
    return S.finished(S.distinct_within(e, "user_id", "60 days").select("user_id"), shared_dir(spark))


def _latest(spark, e: DataFrame, path: str) -> DataFrame:
    """The latest row of each user, merged batch by batch, of events."""
    e.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(S.upsert_latest(spark, f"{path}/latest", ["user_id"], ["ts", "event_id"])).start().awaitTermination()
    return S.latest_rows(spark, f"{path}/latest", e.schema)


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def stream_latest(spark, d):
    """Latest row of each key, merged batch by batch."""
    path = shared_dir(spark)
    return _latest(spark, _events(spark, d).select("user_id", "ts", "event_id", "value"), path).select("user_id", "event_id", "value")


@query("select user_id, event_id, value from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) qualify date_trunc('milliseconds', ts) >= max(date_trunc('milliseconds', ts)) over () - interval 6 hour")
def stream_latest_bounded(spark, d):
    """Latest row of each key, and of these only those within six hours of the newest, as a chain keeps quotes within a minute of it."""
    path = shared_dir(spark)
    e = _events(spark, d).select("user_id", F.date_trunc("millisecond", "ts").alias("ts"), "event_id", "value")
    latest = _latest(spark, e, path)
    return H.bounded_snapshot(latest.withColumn("all", F.lit(0)), "all", seconds=6 * 3600).select("user_id", "event_id", "value")


@query("select user_id::varchar symbol, date_trunc('milliseconds', max(ts)) + interval 120 second < (select date_trunc('milliseconds', max(ts)) from events) as late from events group by user_id")
def stream_freshness(spark, d):
    """Users as inputs: late is what was last said of each when all events had come."""
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("symbol"), "ts")
    out = S.finished(S.freshness_alerts(e), shared_dir(spark), "update")
    return out.groupBy("symbol").agg(F.max_by("late", "epoch").alias("late"))


@query("""with r as (select distinct user_id from events union all select max(user_id) + 1 from events), w as (select time_bucket(interval 6 hour, min(ts)) a, max(ts) + interval 24 hour b from events), b as (select unnest(generate_series(a, b, interval 6 hour)) t from w),
    g as (select r.user_id, b.t, e.ts from r cross join b asof left join (select user_id u, date_trunc('milliseconds', ts) ts from events) e on e.u = r.user_id and e.ts <= b.t), l as (select user_id, t, coalesce(t - ts > interval 6 hour, true) late from g)
    select user_id::varchar symbol, strftime(t, '%Y-%m-%d %H:%M:%S') seen_at, late from (select *, lag(late) over (partition by user_id order by t) was from l) where late is distinct from was""")
def stream_roster(spark, d):
    """Users as inputs that must come, one of whom never does; a clock beats every six hours and goes on for a day after all has stopped."""
    path = shared_dir(spark)
    e = X.table(spark, d, "events")
    roster = e.select(F.col("user_id").cast("string").alias("symbol")).distinct().unionAll(e.agg((F.max("user_id") + 1).cast("string").alias("symbol")))
    six = F.expr("interval 6 hours")
    ends = e.agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("a") / 21600) * 21600)
    ends.select(F.explode(F.sequence(start, F.col("b") + F.expr("interval 24 hours"), six)).alias("ts")).write.parquet(f"{path}/beats")
    beats = S.landed(spark, f"{path}/beats", "ts timestamp")
    rows = _events(spark, d).select(F.col("user_id").cast("string").alias("symbol"), F.date_trunc("millisecond", "ts").alias("ts"))
    out = S.finished(S.roster_alerts(rows, beats, roster, "6 hours"), f"{path}/run")
    return out.select("symbol", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "late")


@query(f"""with {q_news.ARTICLES}, parts as (select min(assessed_at) a, max(assessed_at) b from arts), cut as (select k, a + (b - a) * (k + 1) / 4 c from parts, range(0, 4) t(k)), last as (select k, max(assessed_at) now from arts join cut on assessed_at <= c group by k),
    ok as (select arts.*, k, now from arts join cut on assessed_at <= c join last using (k) where published_at <= received_at and received_at <= first_observed_at and first_observed_at <= assessed_at)
    select k::bigint part, url, article_id, published_at >= now - interval 4000 hour active from ok qualify row_number() over (partition by k, url order by received_at desc, first_observed_at desc, published_at desc, article_id desc) = 1""")
def stream_corrections(spark, d):
    """What is known of every url after each of four parts of the articles, by the stream's changes up to then; the look-back is 4,000 hours here."""
    path = shared_dir(spark)
    a = q_news.articles(spark, d).drop("title")
    a.write.parquet(f"{path}/all")
    a = spark.read.parquet(f"{path}/all")
    us = F.unix_micros("assessed_at")
    lo, hi = a.agg(F.min(us), F.max(us)).first()
    part = F.when(us <= lo, 0).otherwise(F.ceil((us - lo) * 4 / max(1, (hi or 0) - (lo or 0))) - 1)
    a = a.withColumn("part", part.cast("int"))
    for k in range(4):
        a.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{path}/in")
        out = S.finished(S.corrections(S.landed(spark, f"{path}/in", a.drop("part").schema), "4000 hours", keep="36500 days").withColumn("part", F.lit(k)), f"{path}/run", "update")
    said = F.max_by(F.struct("article_id", "active"), "epoch").alias("s")
    upto = [out.where(F.col("part") <= k).groupBy("url").agg(said).select(F.lit(k).alias("part"), "url", "s.*") for k in range(4)]
    return rounded(upto[0].unionByName(upto[1]).unionByName(upto[2]).unionByName(upto[3]))


@query()
def stream_reversal(spark, d):
    """The stateful stream over the same samples as reversal_fold; tests compare the two."""
    e = _events(spark, d)
    samples = reversal_samples(spark, d)
    v = F.floor("value").cast("long")
    codes = F.array(*[F.lit(c) for c in ("EXT-UP-COOLING", "EXT-UP-REBOUND", "INSIDE-RISE", "EXT-UP-FAILURE")])
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scope"), F.col("event_id").cast("int").alias("seq"), ((F.col("event_id") % 400) + 570).cast("int").alias("cutoff"), F.when(v % 6 < 4, F.element_at(codes, (v % 6 % 4).cast("int") + 1)).alias("code"), (F.col("event_type") != "error").alias("usable"), (v % 11 == 0).alias("acknowledged"))
    out = S.finished(S.reversal_warnings(rows.select(samples.columns)), shared_dir(spark), "update")
    last = out.groupBy("scope").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("scope", "epoch")]), "epoch").alias("s"))
    return rounded(last.select("scope", "s.*"))


@query("""with p as (select user_id, (row_number() over (partition by user_id order by ts, event_id) * 1)::int as minute, value, event_type <> 'error' ok from events), g as (select *, sum((not ok)::int) over (partition by user_id order by minute rows unbounded preceding) run from p),
    w as (select *, count(*) over b n, avg(value) over b a, stddev_pop(value) over b sd from g where ok window b as (partition by user_id, run order by minute rows 59 preceding)) select user_id::varchar symbol, minute::bigint as minute, n baseline_bars, case when n >= 5 and sd > 1e-8 then round((value - a) / sd + 1e-9, 6) + 0.0 end z from w""")
def stream_baseline(spark, d):
    """Rolling baseline of an unbroken run kept as state; minutes are made by numbering each user's events."""
    from pyspark.sql import Window

    path = shared_dir(spark)
    e = X.table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    points = e.select(F.col("user_id").cast("string").alias("symbol"), n.alias("minute"), F.col("value").alias("extrinsic"), (F.col("event_type") != "error").alias("valid"))
    points.write.parquet(f"{path}/points")
    stream = S.landed(spark, f"{path}/points", points.schema)
    return rounded(S.finished(S.running_baseline(stream), f"{path}/run"))


@query("select count(distinct strftime(ts, '%Y-%m-%d')) steps, count(*) as \"rows\" from events")
def stream_replay(spark, d):
    """An archive replayed file by file, one day at each step."""
    path = shared_dir(spark)
    e = X.table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    e.repartition("day").write.partitionBy("day").parquet(f"{path}/archive")
    schema = spark.read.parquet(f"{path}/archive").schema
    stream = S.landed(spark, f"{path}/archive", schema, 1).groupBy("day").count()
    out = S.finished(stream, f"{path}/run", "update")
    return out.agg(F.count_distinct("day").alias("steps"), F.sum("count").alias("rows"))


#: Parts in which buckets land, in the order of time.
PARTS = 4


def _streamed_ema(spark, d) -> DataFrame:
    """Buckets of all sessions land part by part, parts end within sessions, and a file is a batch or more."""
    path = shared_dir(spark)
    b = E.calendar_buckets(X.bars(spark, d, X.DENSE), close_at=700)
    b = b.withColumn("at", F.datediff("session_date", F.lit("2026-01-05").cast("date")) * 39 + F.col("bucket"))
    b.write.parquet(f"{path}/all")
    b = spark.read.parquet(f"{path}/all")
    upto = F.lit(b.agg(F.max("at")).first()[0] or 0) + 1
    for k in range(PARTS):
        b.where(F.floor(F.col("at") * PARTS / upto) == k).repartition("symbol").write.mode("append").parquet(f"{path}/buckets")
    stream = S.landed(spark, f"{path}/buckets", b.schema, files_per_trigger=6)
    out = S.finished(S.ema_states(stream), f"{path}/run", "update")
    of = ["symbol", "session_date", "kind", "nth"]
    last = out.groupBy(*of).agg(F.max_by(F.struct(*[c for c in out.columns if c not in (*of, "epoch")]), "epoch").alias("s"))
    return last.select("symbol", F.to_date("session_date").alias("session_date"), "kind", "nth", "s.*")


@query(q_bars.recursive(shown(X.bars_sql(X.DENSE) + q_bars.ema_sql(700) + ", f as (select symbol, session_date, b bucket, ema from fold where day = 1 and pc is not null)", "f", "symbol session_date bucket:l ema:d")))
def stream_ema(spark, d):
    """EMA of every session, its state kept over batches."""
    return rounded(_streamed_ema(spark, d).where("kind = 'point'").select("symbol", "session_date", F.col("nth").alias("bucket"), "ema"))


@query(q_bars.recursive(shown(X.bars_sql(X.DENSE) + q_bars.ema_sql(700), "eps", q_bars.EPISODE)))
def stream_ema_episodes(spark, d):
    """Episodes of every session as the stream last gave them."""
    return rounded(_streamed_ema(spark, d).where("kind = 'episode'").drop("kind", "ema"))
