"""Cash calendar as a date dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CLOSE, OPEN


def calendar(spark: SparkSession, start: str, end: str, closed: DataFrame, early: DataFrame, verified_from: str, verified_to: str, overrides: DataFrame | None = None) -> DataFrame:
    """Each day: (session_date, open_minute, close_minute, closed, verified, kind). closed (date), early (date, close_minute), overrides (date, open_minute, close_minute, closed)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session_date"))
    weekend = F.dayofweek("session_date").isin(1, 7)
    rows = days.join(closed.select(F.col("date").alias("session_date"), F.lit(True).alias("_c")), "session_date", "left").join(early.select(F.col("date").alias("session_date"), F.col("close_minute").alias("_e")), "session_date", "left")
    known = F.col("session_date").between(F.lit(verified_from).cast("date"), F.lit(verified_to).cast("date"))
    shut = weekend | F.coalesce("_c", F.lit(False))
    rows = rows.select("session_date", F.lit(OPEN).alias("open_minute"), F.coalesce("_e", F.lit(CLOSE)).alias("close_minute"), shut.alias("closed"), known.alias("verified"), F.when(weekend, "weekend").when(F.col("_c"), "holiday").when(F.col("_e").isNotNull(), "early").otherwise("regular").alias("kind"))
    if overrides is None:
        return rows
    o = overrides.select(F.col("date").alias("session_date"), F.col("open_minute").alias("_o"), F.col("close_minute").alias("_x"), F.col("closed").alias("_s"))
    j = rows.join(o, "session_date", "left")
    there = F.col("_s").isNotNull()
    return j.select("session_date", F.when(there, F.col("_o")).otherwise(F.col("open_minute")).alias("open_minute"), F.when(there, F.col("_x")).otherwise(F.col("close_minute")).alias("close_minute"), F.coalesce("_s", "closed").alias("closed"), (F.col("verified") | there).alias("verified"), F.when(there, "override").otherwise(F.col("kind")).alias("kind"))


def gated(rows: DataFrame, cal: DataFrame, columns: list[str]) -> DataFrame:
    """On sessions that are closed or not verified the columns become null."""
    c = cal.select("session_date", (F.col("verified") & ~F.col("closed")).alias("_ok"))
    j = rows.join(c, "session_date", "left")
    return j.withColumns({x: F.when(F.coalesce("_ok", F.lit(False)), F.col(x)) for x in columns}).drop("_ok")
