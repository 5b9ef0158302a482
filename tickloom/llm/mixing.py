"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 7
#: Exponent of the default target: a source's weight is its number of documents to this power.
TEMPER = 0.5
#: Sources that the table of rates is broadcast for: 16 bytes and a name each. Beyond, the join is left to Spark.
BROADCAST_SOURCES = 100_000
#: A Poisson variable of mean over 1 is the sum of several of at most 1; terms up to 20 exhaust a double's 53 bits at mean 1.
TERMS = 20


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float = 1.0, temper: float = TEMPER) -> DataFrame:
    """(source, rate): how often a document of the source shall occur on average, so that sources reach their weights and all together total times the rows.

    weights: (source, weight), not negative; a source without one gets none. A null source is a source like any other.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        w = weights.select(F.col("source").alias("s"), F.col("weight").cast("double"))
        n = n.join(w, n["source"].eqNullSafe(w["s"]), "left").drop("s").na.fill({"weight": 0.0})
    whole = n.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights"))
    return n.crossJoin(whole).select("source", F.when(F.col("weights") > 0, F.lit(total) * F.col("rows") * F.col("weight") / F.col("weights") / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))  # crossJoin: one row


def uniform(*key: Column) -> Column:
    """A number from 0 up to 1 from the first 52 bits of a digest of the key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(SEED)), *key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(rate: Column, key: Column) -> Column:
    """Inverts the Poisson distribution of this mean at hash-seeded numbers."""
    parts = F.ceil(rate).cast("int")
    mean = rate / parts

    def one(j: Column) -> Column:
        u = uniform(key, j.cast("string"))
        terms = F.transform(F.sequence(F.lit(0), F.lit(TERMS)), lambda k: F.exp(-mean) * F.pow(mean, k) / F.factorial(k))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        return F.aggregate(terms, start, lambda a, t: F.struct((a["sum"] + t).alias("sum"), (a["n"] + F.when(a["sum"] + t < u, 1).otherwise(0)).alias("n")), lambda a: a["n"])

    return F.when(parts > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), F.lit(0), lambda a, j: a + one(j))).otherwise(F.lit(0))


def mixed(spark: SparkSession, docs: DataFrame, weights: DataFrame | None = None, total: float = 1.0) -> DataFrame:
    """A row for each copy of each document: row (all columns of docs as a struct, so that no name can clash), n_copies, copy_no (from 1) and mix_order, the shuffle key; dealt and sorted by that.

    A document of rate r occurs a Poisson-distributed number of times with mean r, always the same for its doc_id and the seed. Rows
    with the same doc_id occur equally often; a null doc_id counts as the text "null". Extra columns pass through unchanged. An empty
    table gives an empty result. A hot source is no hot task: its rows are only counted, after combining in each task.
    """
    rate = rates(docs.select("source"), weights, total).withColumnRenamed("source", "name")
    if rate.count() <= BROADCAST_SOURCES:
        rate = F.broadcast(rate)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))
    rows = rows.join(rate, F.col("row.source").eqNullSafe(F.col("name"))).select("row", copies(F.col("rate"), key).alias("n_copies")).where("n_copies > 0")
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    rows = rows.withColumn("mix_order", F.md5(F.concat_ws("|", F.lit("order"), F.lit(str(SEED)), key, F.col("copy_no").cast("string"))))
    return rows.repartition("mix_order").sortWithinPartitions("mix_order")


def mix(spark: SparkSession, docs: DataFrame, weights: DataFrame | None = None, total: float = 1.0) -> DataFrame:
    """Each document as often as its source's weight says, in shuffled order, with its own columns; see mixed()."""
    return mixed(spark, docs, weights, total).select("row.*")
