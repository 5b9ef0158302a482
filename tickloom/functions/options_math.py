"""Option mathematics as Column expressions over whole chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of the five-term approximation of the normal distribution.
CDF_STEP, CDF_SCALE = 0.2316419, 0.3989422804014327
CDF_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + CDF_STEP * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(CDF_TERMS):
        poly = (poly + c) * t
    tail = CDF_SCALE * F.exp(-x * x / 2) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def black_scholes(spot: Column, strike: Column, years: Column, iv: Column, rate: Column, right: Column) -> Column:
    """Struct of price, delta, gamma, theta a day and vega a point; null for inputs that are missing or not positive."""
    root = F.sqrt(years)
    d1 = (F.log(spot / strike) + (rate + iv * iv / 2) * years) / (iv * root)
    d2 = d1 - iv * root
    pdf, disc, call = F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi), F.exp(-rate * years), right == "CALL"
    side = F.when(call, 1.0).otherwise(-1.0)
    paid = strike * disc * normal_cdf(side * d2)
    price = side * (spot * normal_cdf(side * d1) - paid)
    theta = (-spot * pdf * iv / (2 * root) - side * rate * paid) / 365
    delta = normal_cdf(d1) - F.when(call, 0.0).otherwise(1.0)
    ok = right.isin("CALL", "PUT") & (spot > 0) & (strike > 0) & (years > 0) & (iv > 0) & rate.isNotNull()
    return F.when(ok, F.struct(price.alias("price"), delta.alias("delta"), (pdf / (spot * iv * root)).alias("gamma"), theta.alias("theta"), (spot * pdf * root / 100).alias("vega")))


def intrinsic(spot: Column, strike: Column, right: Column) -> Column:
    return F.when(right == "CALL", F.greatest(F.lit(0.0), spot - strike)).otherwise(F.greatest(F.lit(0.0), strike - spot))


def expected_move(anchor: Column, iv: Column, minutes: Column) -> Column:
    """One standard deviation over the minutes left."""
    return F.when((anchor > 0) & (iv > 0) & (minutes >= 0), anchor * iv * F.sqrt(minutes / 525600))


def discount(rate_percent: Column, minutes_left: Column) -> Column:
    return 1 / (1 + rate_percent / 100 * minutes_left / (1440 * 360))


def premium_dollars(points: Column, contracts: Column) -> Column:
    return points * 100 * contracts


def taylor(priced: DataFrame, grid: Column) -> DataFrame:
    """priced rows with delta and gamma for each move of the underlying in grid, an array: moved, and the price's move to first and second order."""
    rows = priced.withColumn("moved", F.explode(grid))
    first = F.col("moved") * F.col("delta")
    return rows.withColumns({"by_delta": first, "by_gamma": first + F.col("moved") * F.col("moved") / 2 * F.col("gamma")})
