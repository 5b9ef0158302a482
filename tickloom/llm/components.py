"""Connected components of a link table by alternating large-star and small-star steps; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored


def _linked_to_least(pairs: DataFrame) -> DataFrame:
    """Every (u, v) with the least of u and all its v. The minimum is combined before its shuffle; AQE splits the join for a u with many links."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: (a, b) long ids. Returns (id, component), the least id reachable, for each id that occurs in a link between two ids.

    Each round is written to the shared folder. It ends when a round changes no link. An empty link table gives an empty result.
    """
    folder = shared_dir(spark)
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, last = stored(spark, stars, f"{folder}/0"), None
    for k in range(1, max_rounds + 1):
        both = stars.select("u", "v").unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _linked_to_least(large)
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        before, stars = stars, stored(spark, small.where("u <> v").distinct(), f"{folder}/{k}")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == last and stars.join(before, ["u", "v"], "left_anti").isEmpty():  # as many links, and the same ones
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        last = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
