"""Market-like tables derived from the driver's tables by integer rules, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
#: Orders that fill the sessions of a shape once; the next ones fill new sessions, so these grow with the table at one density.
FILL = 15_000
#: (sessions of a fill, symbols, minutes, first minute): with gaps; without gaps; with a premarket.
GAPS, DENSE, PRE = (3, 13, 390, 570), (1, 13, 130, 570), (3, 13, 420, 540)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_number(k: int) -> Column:
    return (F.floor(F.col("l_orderkey") / FILL) * k + F.col("l_orderkey") % k).cast("int")


def ticks(spark: SparkSession, sf_dir: str, shape: tuple[int, int, int, int]) -> DataFrame:
    k, s, m, first = shape
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("S"), F.lpad((F.col("l_partkey") % s).cast("string"), 2, "0")).alias("symbol"), F.date_add(F.lit("2026-01-05").cast("date"), day_number(k)).alias("session_date"), (first + (F.col("l_partkey") * 31 + F.col("l_orderkey") * 7 + F.col("l_linenumber")) % m).cast("int").alias("minute"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), *ORDER)


def bars(spark: SparkSession, sf_dir: str, shape: tuple[int, int, int, int] = GAPS) -> DataFrame:
    return B.minute_bars(ticks(spark, sf_dir, shape), *ORDER)


def ticks_sql(shape: tuple[int, int, int, int]) -> str:
    k, s, m, first = shape
    return f"""ticks as (select 'S' || lpad((l_partkey % {s})::varchar, 2, '0') symbol, date '2026-01-05' + (l_orderkey // {FILL} * {k} + l_orderkey % {k})::int session_date,
        ({first} + (l_partkey * 31 + l_orderkey * 7 + l_linenumber) % {m})::int as minute, l_extendedprice / l_quantity price, l_quantity size, {', '.join(ORDER)} from lineitem)"""


def bars_sql(shape: tuple[int, int, int, int] = GAPS) -> str:
    by = ", ".join(ORDER)
    return f"""{ticks_sql(shape)}, bars as (select symbol, session_date, minute, first(price order by {by}) as open, max(price) high, min(price) low, last(price order by {by}) as close, sum(size) volume from ticks group by all)"""


def quotes(spark: SparkSession, sf_dir: str, shape: tuple[int, int, int, int] = DENSE) -> DataFrame:
    """One call quote a minute for each symbol, around a made-up underlying from 6000 to 6100; some are wide or out of step."""
    return quoted(bars(spark, sf_dir, shape))


def quoted(b: DataFrame) -> DataFrame:
    cents = F.floor(F.col("close") * 100).cast("long")
    und = 6000 + (cents % 10000) / 100
    worth = F.greatest(F.lit(0.0), und - 6050) + 5 + (F.col("volume").cast("long") % 40) / 8
    half = F.when(F.col("minute") % 37 == 0, 4.0).otherwise(0.25)
    return b.select("symbol", "session_date", "minute", "close", (worth - half).alias("bid"), (worth + half).alias("ask"), F.lit(6050.0).alias("strike"), F.lit("CALL").alias("right"), und.alias("underlying"), ((F.col("minute") * 7 + cents % 13) % 66).cast("int").alias("lag_seconds"), (0.1 + (cents % 50) / 500).alias("iv"), ((cents % 7) / 100).alias("iv_error"))


def quotes_sql(shape: tuple[int, int, int, int] = DENSE) -> str:
    return bars_sql(shape) + """, q0 as (select *, floor(close * 100)::bigint c from bars), q1 as (select *, 6000 + (c % 10000) / 100 und, case when minute % 37 = 0 then 4.0::double else 0.25::double end half from q0),
        q2 as (select *, greatest(0.0::double, und - 6050) + 5 + (volume::bigint % 40) / 8 worth from q1),
        quotes as (select symbol, session_date, minute, close, worth - half bid, worth + half ask, 6050.0::double strike, 'CALL' as "right", und underlying, ((minute * 7 + c % 13) % 66)::int lag_seconds, 0.1::double + (c % 50) / 500 iv, (c % 7) / 100 iv_error from q2)"""


def levels_sql(shape: tuple[int, int, int, int] = PRE) -> str:
    return bars_sql(shape) + """, ranges as (select symbol, session_date, max(high) filter (minute >= 570) high, min(low) filter (minute >= 570) low, arg_max(close, minute) filter (minute >= 570) as close,
        max(high) filter (minute < 570) pm_high, min(low) filter (minute < 570) pm_low from bars group by all),
        levels as (select symbol, session_date, lag(session_date) over w previous_date, lag(high) over w prior_high, lag(low) over w prior_low, lag(close) over w prior_close, pm_high, pm_low from ranges window w as (partition by symbol order by session_date))"""


def premium_sql(shape: tuple[int, int, int, int] = DENSE) -> str:
    return quotes_sql(shape) + """, p0 as (select *, (bid + ask) / 2 mid, (bid + ask) / 2 - greatest(0.0::double, underlying - strike) ex, (ask - bid) / ((bid + ask) / 2) spread from quotes),
        p1 as (select *, underlying > 0 and bid > 0 and ask >= bid and spread <= 0.25 and ex >= -0.05 and abs(lag_seconds) <= 60 valid from p0),
        p2 as (select *, (coalesce(minute - lag(minute) over w <> 1, true) or not valid or not coalesce(lag(valid) over w, false))::int brk from p1 window w as (partition by symbol, session_date order by minute)),
        p3 as (select *, sum(brk) over (partition by symbol, session_date order by minute rows unbounded preceding) run, case when valid then greatest(0.0::double, ex) end extrinsic from p2),
        p4 as (select *, count(extrinsic) over b n, stddev_pop(extrinsic) over b sd, avg(extrinsic) over b av, regr_slope(extrinsic, minute::double) over (partition by symbol, session_date, run order by minute rows 2 preceding) sl from p3
            window b as (partition by symbol, session_date, run order by minute rows 59 preceding)),
        premium as (select symbol, session_date, minute, close, mid, extrinsic, spread, valid, case when valid then n else 0 end baseline_bars, case when valid and n >= 5 and sd > 1e-8 then round((extrinsic - av) / sd, 8) + 0.0 end z, case when valid and n >= 5 then round(sl, 8) + 0.0 end slope, case when iv_error < 0.05 then iv end iv from p4)"""
