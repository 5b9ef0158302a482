"""Reversal warnings: retained until reviewed, rearmed after five clear minutes. The same step serves batch folds and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes that warn: what they say, and the side of a position to review.
CODES = {"EXT-UP-COOLING": ("bearish", "bullish"), "EXT-UP-FAILURE": ("bearish", "bullish"), "EXT-UP-REBOUND": ("bullish", "bearish"), "EXT-DOWN-REBOUND": ("bullish", "bearish")}
REARM = 5
STATE = "struct<cutoff:int,code:string,detected:int,acknowledged:boolean,clear:int,last_clear:int,warnings:int>"
OUT = "struct<cutoff:int,code:string,detected:int,clear:int,warnings:int>"


def detected_code(matches: Column, codes: tuple[str, ...] = tuple(CODES)) -> Column:
    """First of the warning codes among an array of matches."""
    return F.coalesce(*[F.when(F.array_contains(matches, c), c) for c in codes])


def copy_of(code: Column) -> Column:
    """Direction of a warning and the side to review."""
    say = lambda i: F.coalesce(*[F.when(code == k, v[i]) for k, v in CODES.items()])
    return F.struct(say(0).alias("direction"), say(1).alias("review"))


def _step(s: Column, x: Column) -> Column:
    match = F.coalesce(x["usable"] & x["code"].isin(*CODES), F.lit(False))
    acked = s["acknowledged"] | F.coalesce(x["acknowledged"], F.lit(False))
    new = match & (s["code"].isNull() | (s["code"] != x["code"]) | (acked & (s["clear"] >= REARM)))
    back = x["cutoff"] < s["cutoff"]
    clear = F.when(s["last_clear"] == x["cutoff"], s["clear"]).when(s["last_clear"] == x["cutoff"] - 1, s["clear"] + 1).otherwise(1)
    out = F.struct(x["cutoff"].alias("cutoff"), F.when(new, x["code"]).otherwise(s["code"]).alias("code"), F.when(new, x["cutoff"]).otherwise(s["detected"]).alias("detected"), F.when(new, False).otherwise(acked).alias("acknowledged"), F.when(~x["usable"] | match, 0).otherwise(clear).alias("clear"), F.when(~x["usable"] | match, F.lit(None).cast("int")).otherwise(x["cutoff"]).alias("last_clear"), (s["warnings"] + new.cast("int")).alias("warnings"))
    fresh = F.struct(x["cutoff"].alias("cutoff"), F.when(match, x["code"]).alias("code"), F.when(match, x["cutoff"]).alias("detected"), F.lit(False).alias("acknowledged"), F.when(x["usable"] & ~match, 1).otherwise(0).alias("clear"), F.when(x["usable"] & ~match, x["cutoff"]).alias("last_clear"), (s["warnings"] + match.cast("int")).alias("warnings"))
    return F.when(back, fresh).otherwise(out).cast(STATE)


def warnings(samples: DataFrame) -> DataFrame:
    """samples (scope, seq, cutoff, code, usable, acknowledged), folded by scope in the order of seq: one row for each scope with its end state.

    An acknowledgement on a sample counts before the sample. A cutoff before the last one starts anew. A scope is one session, so its array is short.
    """
    rows = samples.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("seq", "cutoff", "code", "usable", "acknowledged"))).alias("x"))
    start = F.struct(F.lit(-1).alias("cutoff"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("int").alias("detected"), F.lit(False).alias("acknowledged"), F.lit(0).alias("clear"), F.lit(None).cast("int").alias("last_clear"), F.lit(0).alias("warnings")).cast(STATE)
    return rows.select("scope", F.aggregate("x", start, _step).alias("s")).select("scope", "s.*")
