"""Evaluation audits: scores, calibration, money, drawdown, chronology and training cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("bar_end", "available_at", "decision_at", "entry_at", "exit_at", "deadline_at")


def valid_outcome() -> Column:
    return F.coalesce(F.col("p").between(0, 1) & F.col("y").isin(0, 1), F.lit(False))


def brier(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Mean squared error of p against y over valid rows, with the count of invalid ones and the score of always saying one half."""
    ok = valid_outcome()
    return outcomes.groupBy(*keys).agg(F.avg(F.when(ok, F.pow(F.col("p") - F.col("y"), 2))).alias("brier"), F.avg(F.when(ok, F.pow(0.5 - F.col("y"), 2))).alias("baseline"), F.count_if(ok).alias("n"), F.count_if(~ok).alias("invalid"))


def calibration(outcomes: DataFrame, bins: int = 10) -> DataFrame:
    """Mean forecast and observed frequency by equal bins of p."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return outcomes.where(valid_outcome()).groupBy(b.cast("int").alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("frequency"), F.count("*").alias("n"))


def round_trips(legs: DataFrame, fee: int = 100, slip: int = 0, multiplier: int = 100) -> DataFrame:
    """legs (trade_id, quantity, entry_cents, exit_cents): gross, costs and net in whole cents; costs are for both sides of each leg."""
    q = F.col("quantity").cast("decimal(18,0)")
    gross = F.sum(q * (F.col("exit_cents") - F.col("entry_cents")) * multiplier).cast("long")
    costs = F.sum(F.abs(q) * 2 * (fee + slip * multiplier)).cast("long")
    return legs.groupBy("trade_id").agg(gross.alias("gross_cents"), costs.alias("cost_cents")).withColumn("net_cents", F.col("gross_cents") - F.col("cost_cents"))


def max_drawdown(daily: DataFrame, *keys: str) -> DataFrame:
    """daily (keys, day, cents): deepest fall of the running sum from its peak, which begins at zero."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("_e", F.sum("cents").over(w))
    rows = rows.withColumn("_p", F.greatest(F.lit(0), F.max("_e").over(w)))
    return rows.groupBy(*keys).agg(F.max(F.col("_p") - F.col("_e")).alias("drawdown_cents"))


def chronology(records: DataFrame) -> DataFrame:
    """Adds violation: the first stage that comes before the one before it, or is missing; null if all is in order."""
    tests = [F.when(F.col(STAGES[0]).isNull(), STAGES[0])]
    tests += [F.when(F.col(b).isNull() | (F.col(b) < F.col(a)), b) for a, b in zip(STAGES, STAGES[1:], strict=False)]
    return records.withColumn("violation", F.coalesce(*tests))


def leaks(decisions: DataFrame, models: DataFrame) -> DataFrame:
    """Decisions whose model saw labels from the decision's time or later."""
    return decisions.join(models.select("model_id", "labels_through"), "model_id").where(~F.coalesce(F.col("labels_through") < F.col("decision_at"), F.lit(False)))
