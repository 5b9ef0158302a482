"""Parquet archive with a manifest, point-in-time reads, integrity checks and backfill plans."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import interval_seconds

PARTITIONS = ("provider", "kind", "symbol", "date")
#: Folder level above the partitions: one write. A repeated entry lies in the folder of each write.
BATCH = "archive_batch"
#: Rows of a file at most, so that a file's bytes fit in one row when they are hashed.
FILE_ROWS = 2_000_000
#: Damaged or foreign files that a scan leaves out by name.
MOST_DAMAGED = 10_000


def request_key(*columns: str) -> Column:
    """SHA-256 of the non-null parameters in the order of their names."""
    entries = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("&", *entries), 256)


def _within(df: DataFrame, kind: str | None = None, provider: str | None = None, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Filters on partition columns, which prune folders before any file is opened."""
    for c, v in (("kind", kind), ("provider", provider)):
        df = df.where(F.col(c) == v) if v else df
    df = df.where(F.col("symbol").isin(symbols)) if symbols else df
    df = df.where(F.col("date") >= start) if start else df
    return df.where(F.col("date") <= end) if end else df


def _read(spark: SparkSession, path: str, form: str, columns: str, batch: str | None = None) -> DataFrame:
    """Files under data with the partition columns as strings (so "007" stays what it is) and each file's path below data."""
    folders = ", ".join(f"{c} string" for c in (BATCH, *PARTITIONS))
    r = spark.read.format(form).schema(f"{columns}, {folders}" if columns else folders).option("basePath", f"{path}/data")
    return r.load(f"{path}/data/{BATCH}={batch}" if batch else f"{path}/data")


def _file() -> Column:
    return F.concat(F.lit(f"{BATCH}="), F.substring_index("_metadata.file_path", f"/data/{BATCH}=", -1))


def _stored(spark: SparkSession, path: str, batch: str | None = None) -> DataFrame:
    return _read(spark, path, "binaryFile", "path string, modificationTime timestamp, length bigint, content binary", batch)


def _hashed(stored: DataFrame) -> DataFrame:
    return stored.select(BATCH, *PARTITIONS, request_key(*PARTITIONS).alias("key"), _file().alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def write_archive(rows: DataFrame, path: str, status: str = "complete") -> DataFrame:
    """Rows with PARTITIONS columns, as one batch. Gives the manifest rows of the batch: an entry is what has the same PARTITIONS.

    First the data, then length, SHA-256 and row count of every file written, last the manifest: a batch without it doesn't exist for
    readers. A large entry is dealt to several tasks and files of at most FILE_ROWS rows. An entry written again replaces the earlier one.
    Null and empty partition values are both null. A column named like BATCH is an error.
    """
    if BATCH in rows.columns:
        raise ValueError(f"{BATCH} names the archive's own folders")
    spark, batch = rows.sparkSession, f"b{uuid.uuid4().hex}"
    data = rows.withColumns({c: F.col(c).cast("string") for c in PARTITIONS})
    data.hint("rebalance", *PARTITIONS).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*PARTITIONS).parquet(f"{path}/data/{BATCH}={batch}")
    counts = _read(spark, path, "parquet", "", batch).groupBy(_file().alias("file")).agg(F.count("*").alias("n"))
    _hashed(_stored(spark, path, batch)).join(counts, "file").write.mode("append").parquet(f"{path}/files")
    files = spark.read.parquet(f"{path}/files").where(F.col(BATCH) == batch)
    columns = data.drop(*PARTITIONS).schema.json()
    return _commit(files.groupBy(BATCH, *PARTITIONS, "key").agg(F.sum("n").alias("row_count"), F.count("*").alias("n_files")), path, status, columns)


def write_unavailable(requests: DataFrame, path: str) -> DataFrame:
    """Entries (PARTITIONS) that were asked for and not to be had: no rows; earlier ones of the same key are no longer read."""
    batch = f"b{uuid.uuid4().hex}"
    asked = requests.select(F.lit(batch).alias(BATCH), *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in PARTITIONS]).distinct()
    return _commit(asked.select("*", request_key(*PARTITIONS).alias("key"), F.lit(0).cast("long").alias("row_count"), F.lit(0).cast("long").alias("n_files")), path, "unavailable", None)


def _commit(found: DataFrame, path: str, status: str, columns: str | None) -> DataFrame:
    manifest = found.withColumns({"status": F.lit(status), "written_at": F.current_timestamp(), "columns": F.lit(columns).cast("string")})
    manifest.write.mode("append").parquet(f"{path}/manifest")
    return manifest


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's latest row of each key."""
    m = spark.read.parquet(f"{path}/manifest")
    return m.groupBy("key").agg(F.max_by(F.struct(*m.columns), F.struct("written_at", BATCH)).alias("e")).select("e.*")


def verify_files(spark: SparkSession, path: str, **within) -> DataFrame:
    """Every file, recorded or found, within the filters of scan, against its bytes: ok, missing, length, sha256, foreign (in no manifest) or superseded."""
    now = entries(spark, path).select(BATCH, "key", F.lit(True).alias("_now"))
    recorded = _within(spark.read.parquet(f"{path}/files"), **within).join(now, [BATCH, "key"], "left")
    recorded = recorded.withColumns({"r_length": F.col("length"), "r_sha256": F.col("sha256")}).drop("length", "sha256")
    found = _hashed(_within(_stored(spark, path), **within))
    j = recorded.alias("r").join(found.alias("f"), "file", "full")
    check = (
        F.when(F.col("r_sha256").isNull(), "foreign").when(F.col("_now").isNull(), "superseded").when(F.col("f.sha256").isNull(), "missing")
        .when(F.col("f.length") != F.col("r_length"), "length").when(F.col("f.sha256") != F.col("r_sha256"), "sha256").otherwise("ok")
    )
    either = [F.when(F.col("r_sha256").isNull(), F.col(f"f.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in (BATCH, *PARTITIONS, "key")]
    return j.select("file", *either, check.alias("check"))


def verify(spark: SparkSession, path: str, **within) -> DataFrame:
    """Each current entry: check is the worst of its files (missing, then length, then sha256, else ok), foreign the number of files in its folders that no manifest knows."""
    files = verify_files(spark, path, **within).where("check <> 'superseded'")
    has = lambda c: F.bool_or(F.col("check") == c)
    worst = files.groupBy("key").agg(F.when(has("missing"), "missing").when(has("length"), "length").when(has("sha256"), "sha256").alias("bad"), F.count_if(F.col("check") == "foreign").alias("foreign"))
    rows = _within(entries(spark, path), **within).join(worst, "key", "left")
    return rows.select("key", *PARTITIONS, "status", "row_count", F.coalesce("bad", F.lit("ok")).alias("check"), F.coalesce("foreign", F.lit(0)).alias("foreign"))


def scan(spark: SparkSession, path: str, kind: str | None = None, provider: str | None = None, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, interval: str | None = None, checked: bool = True) -> DataFrame:
    """Rows of the current entries that aren't unavailable, with the columns of all writes (later types count), partition values as strings.

    checked hashes the files in question first: a damaged entry is left out whole and foreign files aren't opened, so neither can fail
    the read or add rows; verify tells which. Over MOST_DAMAGED such files are an error: that archive wants repair. Nothing else is left
    out: an error while reading a sound file stays an error.
    """
    within = {"kind": kind, "provider": provider, "symbols": symbols, "start": start, "end": end}
    written = spark.read.parquet(f"{path}/manifest").where("columns is not null").groupBy("columns").agg(F.max("written_at").alias("at")).orderBy("at").collect()
    fields = {f.name: f for w in written for f in StructType.fromJson(json.loads(w.columns)).fields}
    data = _within(_read(spark, path, "parquet", StructType(list(fields.values())).toDDL()), **within)
    if checked:
        wrong = verify_files(spark, path, **within).where("check not in ('ok', 'superseded')").select("check", "file", F.concat_ws("/", BATCH, "key").alias("entry")).limit(MOST_DAMAGED + 1).collect()
        if len(wrong) > MOST_DAMAGED:
            raise ValueError(f"over {MOST_DAMAGED} files of the archive are damaged or foreign")
        foreign, damaged = ([r[c] for r in wrong if (r.check == "foreign") == (c == "file")] for c in ("file", "entry"))
        data = data.where(~_file().isin(foreign)) if foreign else data
        data = data.where(~F.concat_ws("/", BATCH, request_key(*PARTITIONS)).isin(sorted(set(damaged)))) if damaged else data
    there = entries(spark, path).where("status <> 'unavailable'").select(BATCH, F.col("key").alias("_key"))
    rows = data.join(there, (data[BATCH] == there[BATCH]) & (request_key(*PARTITIONS) == F.col("_key")), "left_semi").drop(BATCH)
    return rows.where(F.col("interval") == interval) if interval else rows


def known_at(rows: DataFrame, as_of: Column) -> DataFrame:
    """Point in time: only what was known, with later facts nulled. Rows with a date alone are never minute facts."""
    t = lambda c: F.col(c).isNull() | (F.col(c) <= as_of) if c in rows.columns else F.lit(True)
    kept = rows.where((F.col("ts") <= as_of) & t("first_seen_ts") & t("bid_ts") & t("ask_ts"))
    if "ts_kind" in rows.columns:
        length = F.coalesce(interval_seconds(F.col("interval")), F.lit(0)) if "interval" in rows.columns else F.lit(0)
        kept = kept.where(~F.col("ts_kind").isin("session-date", "observation-date") & ((F.col("ts_kind") != "bar-open") | (F.col("ts").cast("double") + length <= as_of.cast("double"))))
    for stamp, facts in (("greeks_ts", ("delta", "gamma", "theta", "vega", "iv")), ("oi_ts", ("open_interest",)), ("underlying_ts", ("underlying_price",))):
        if stamp in rows.columns:
            late = F.col(stamp) > as_of
            kept = kept.withColumns({c: F.when(~F.coalesce(late, F.lit(False)), F.col(c)) for c in facts if c in rows.columns})
    return kept


def withheld_interest(chain: DataFrame, cutoff: Column, strict: bool = True) -> DataFrame:
    """Open interest without a stamp (in a strict replay) or stamped after the cutoff is null."""
    known = (F.col("oi_ts") <= cutoff) | (F.lit(not strict) & F.col("oi_ts").isNull())
    return chain.withColumn("open_interest", F.when(F.coalesce(known, F.lit(False)), F.col("open_interest")))


def freshness(required: DataFrame, bars: DataFrame, now: Column, most: int = 120) -> DataFrame:
    """One row: are all required symbols there with a last bar that ended at most so many seconds ago, from a realtime provider."""
    last = bars.where("source_mode = 'realtime'").groupBy("symbol").agg(F.max("ts").alias("last"))
    j = required.join(last, "symbol", "left")
    ok = F.coalesce(now.cast("double") - F.col("last").cast("double") - 60 <= most, F.lit(False))
    return j.agg(F.bool_and(ok).alias("current"), F.count_if(~ok).alias("late"))


def one_class(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys whose rows mix synthetic and observed modes: they are refused."""
    made = F.col("source_mode") == "synthetic"
    return rows.groupBy(*keys).agg(F.count_if(made).alias("synthetic"), F.count_if(~made).alias("observed")).withColumn("refused", (F.col("synthetic") > 0) & (F.col("observed") > 0))


def backfill_plan(spark: SparkSession, symbols: DataFrame, start: str, end: str, today: str, verified: DataFrame | None = None, max_days: int = 31) -> DataFrame:
    """(symbol, date) still to fetch: all days of the span that the verified entries don't have. A span over max_days or into the future is an error."""
    days = spark.sql(f"select datediff(date '{end}', date '{start}') + 1 as n, date '{end}' > date '{today}' as ahead").first()
    if days.n < 1 or days.n > max_days or days.ahead:
        raise ValueError(f"a span must have 1 to {max_days} days and end by {today}")
    grid = symbols.select("symbol").distinct().withColumn("date", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return grid.join(verified.select("symbol", F.col("date").cast("date").alias("date")), ["symbol", "date"], "left_anti") if verified is not None else grid
