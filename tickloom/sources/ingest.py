"""Landed provider files to normalised rows. Each reader takes a path that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import eastern_to_utc, number, symbol_name

BARS = ("symbol", "ts", "interval", "ts_kind", "session_date", "open", "high", "low", "close", "volume")
#: Symbols that a provider writes differently.
ALIASES = {"^GSPC": "SPX", "^SPX": "SPX", "^TNX": "TNX", "^VIX": "VIX"}


def _alias(c):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), c), c)


def chart_json(spark: SparkSession, path: str, interval: str = "1m") -> DataFrame:
    """Parallel arrays (symbol, timestamp[], open[] ...) to bars; rows without all four prices are dropped. Daily rows carry a session date only."""
    schema = "symbol string, timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"
    raw = spark.read.schema(schema).json(path)
    rows = raw.select(_alias(symbol_name(F.col("symbol"))).alias("symbol"), F.explode(F.arrays_zip("timestamp", "open", "high", "low", "close", "volume")).alias("x")).select("symbol", "x.*")
    ts = F.timestamp_seconds("timestamp")
    daily = interval.endswith("d")
    rows = rows.where("open is not null and high is not null and low is not null and close is not null")
    return rows.select("symbol", ts.alias("ts"), F.lit(interval).alias("interval"), F.lit("session-date" if daily else "bar-open").alias("ts_kind"), F.to_date(F.from_utc_timestamp(ts, "America/New_York")).alias("session_date"), "open", "high", "low", "close", "volume")


def daily_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Date,Open,High,Low,Close,Volume with a header; lines that don't fit are in corrupt."""
    schema = T.StructType([T.StructField("Date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close", "Volume")], T.StructField("corrupt", T.StringType())])
    raw = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt", enforceSchema=False)
    return raw.select(F.lit(symbol).alias("symbol"), F.lit(None).cast("timestamp").alias("ts"), F.lit("1d").alias("interval"), F.lit("session-date").alias("ts_kind"), F.col("Date").alias("session_date"), *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")], "corrupt")


def rate_csv(spark: SparkSession, path: str, series: str) -> DataFrame:
    """date,value; a dot is missing and dropped, never zero."""
    raw = spark.read.csv(path, header=True, schema="date date, value string", enforceSchema=True)
    return raw.select(F.lit(series).alias("series"), "date", number(F.when(F.col("value") != ".", F.col("value"))).alias("value")).where("date is not null and value is not null")


def rss(spark: SparkSession, path: str, hosts: DataFrame, limit: int = 100) -> DataFrame:
    """Items of feeds with an allowed https host and a time, newest first. hosts (host) is a table of any size and joined; repeated and null hosts change nothing."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace("pubDate", r"^\w+,\s*", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    rows = raw.select(F.trim("title").alias("title"), "link", at.alias("published_at"))
    ok = F.col("link").startswith("https://") & F.col("published_at").isNotNull()
    allowed = hosts.select(F.col("host").alias("_host"))
    rows = rows.where(ok).join(allowed, F.parse_url("link", F.lit("HOST")) == F.col("_host"), "left_semi")
    return rows.orderBy(F.desc("published_at"), "link").limit(max(1, min(limit, 100)))


def option_json(spark: SparkSession, path: str) -> DataFrame:
    """(contract, data[]) to flat quotes: vega by 100, right in upper case, New York wall clock to UTC."""
    schema = "contract struct<root string, expiration string, strike double, right string>, data array<struct<timestamp string, bid double, ask double, bid_size double, ask_size double, delta double, gamma double, theta double, vega double, iv double, underlying_price double, underlying_timestamp string>>"
    raw = spark.read.schema(schema).json(path).select("contract.*", F.explode("data").alias("d")).select("root", F.col("expiration").try_cast("date").alias("expiration"), "strike", F.upper("right").alias("right"), "d.*")
    right = F.when(F.col("right").isin("C", "CALL"), "CALL").when(F.col("right").isin("P", "PUT"), "PUT")
    return raw.withColumns({"right": right, "vega": F.col("vega") / 100, "ts": eastern_to_utc(F.col("timestamp")), "underlying_ts": eastern_to_utc(F.col("underlying_timestamp"))}).drop("timestamp", "underlying_timestamp")


def price_json(spark: SparkSession, path: str, index: bool) -> DataFrame:
    """One bar a line, New York wall clock; an index has no volume."""
    raw = spark.read.schema("symbol string, timestamp string, open double, high double, low double, close double, volume double").json(path)
    ts = eastern_to_utc(F.col("timestamp"))
    return raw.select(symbol_name(F.col("symbol")).alias("symbol"), ts.alias("ts"), F.lit("1m").alias("interval"), F.lit("bar-open").alias("ts_kind"), F.to_date(F.from_utc_timestamp(ts, "America/New_York")).alias("session_date"), "open", "high", "low", "close", (F.lit(None).cast("double") if index else F.col("volume")).alias("volume"))


def one_or_many(text: str, item: str) -> F.Column:
    """A JSON field that holds one object or a list of them, as an array of the struct type item."""
    return F.coalesce(F.when(F.col(text).startswith("["), F.from_json(text, f"array<{item}>")), F.array(F.from_json(text, item)))


def labelled(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Provider, mode and delay of each symbol; instruments (symbol, provider, mode, delay_seconds) is joined, realtime is the default."""
    i = instruments.select("symbol", F.col("mode").alias("_m"), F.col("delay_seconds").alias("_d"))
    return rows.join(i, "symbol", "left").withColumns({"source_mode": F.coalesce("_m", F.lit("realtime")), "delay_seconds": F.coalesce("_d", F.lit(0))}).drop("_m", "_d")


def envelope(rows: DataFrame, *keys: str) -> DataFrame:
    """Provenance of each batch: newest and oldest time, rows, and ok, partial (some rows without a time) or unavailable."""
    return rows.groupBy(*keys).agg(F.max("ts").alias("as_of"), F.min("ts").alias("oldest_as_of"), F.count("*").alias("rows"), F.when(F.count("ts") == 0, "unavailable").when(F.count("ts") < F.count("*"), "partial").otherwise("ok").alias("status"))


def by_priority(rows: DataFrame, priorities: DataFrame, keys: list[str], pinned: str | None = None) -> DataFrame:
    """Rows of the first enabled provider in order that has any for the key; a pinned provider never falls back. priorities (provider, priority, enabled)."""
    p = priorities.where("enabled")
    p = p.where(F.col("provider") == pinned) if pinned else p
    j = rows.join(p.select("provider", "priority"), "provider")
    best = j.groupBy(*keys).agg(F.min("priority").alias("_best"))
    return j.join(best, keys).where("priority = _best").drop("_best", "priority")


def clean(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Equal duplicates of a key collapse; a key with different rows goes to the second table, with how many versions it has."""
    values = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.count_distinct(F.xxhash64(*values)).alias("versions"), F.count("*").alias("rows"), F.max(F.struct(*values)).alias("v"))
    return one.where("versions = 1").select(*keys, "v.*"), one.where("versions > 1").select(*keys, "versions", "rows")
