"""Column expressions: coercion, validity, time axis and labels. All run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"
OPEN, CLOSE = 570, 960


def number(c: Column) -> Column:
    """Text or number to double; null, empty and non-finite values become null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def symbol_name(c: Column) -> Column:
    """Trimmed upper case; null unless 1 to 40 characters of A-Z 0-9 ^ = . _ / -."""
    up = F.upper(F.trim(c))
    return F.when(up.rlike(r"^[A-Z0-9^=._/-]{1,40}$"), up)


def strict_date(c: Column) -> Column:
    """YYYY-MM-DD that is a day of the calendar; else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def in_range(date: Column, start: Column, end: Column) -> Column:
    return date.between(start, end)


def valid_price(o: Column, h: Column, lo: Column, c: Column) -> Column:
    """Finite, positive, and high and low enclose open and close."""
    whole = o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull() & ~F.isnan(o + h + lo + c)
    return F.coalesce(whole & (F.least(o, h, lo, c) > 0) & (h < float("inf")) & (h >= F.greatest(o, lo, c)) & (lo <= F.least(o, h, c)), F.lit(False))


def valid_bar(require_volume: bool = False) -> Column:
    """Price envelope holds; volume is null or not negative, or with require_volume present and not negative."""
    v = F.col("volume")
    volume = (v.isNotNull() & (v >= 0)) if require_volume else (v.isNull() | (v >= 0))
    return valid_price(F.col("open"), F.col("high"), F.col("low"), F.col("close")) & F.coalesce(volume, F.lit(False))


def valid_option() -> Column:
    """Right is CALL or PUT, strike positive, expiration present, bid not negative, ask positive and not under bid."""
    ok = F.col("right").isin("CALL", "PUT") & (F.col("strike") > 0) & F.col("expiration").isNotNull() & (F.col("bid") >= 0) & (F.col("ask") >= F.col("bid")) & (F.col("ask") > 0)
    return F.coalesce(ok, F.lit(False))


def to_eastern(ts: Column) -> tuple[Column, Column]:
    """UTC time to the session's date and minutes since midnight in New York."""
    local = F.from_utc_timestamp(ts, EASTERN)
    return F.to_date(local), F.hour(local) * 60 + F.minute(local)


def eastern_to_utc(wall: Column) -> Column:
    """Wall clock in New York to UTC. Null in the spring gap and in the hour that autumn repeats; text with an offset is taken as it is."""
    offset = wall.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    local = F.when(~offset, wall).try_cast("timestamp_ntz").cast("timestamp")
    utc = F.to_utc_timestamp(local, EASTERN)
    hour = F.expr("interval 1 hour")
    back = F.from_utc_timestamp(utc, EASTERN)
    twice = (F.from_utc_timestamp(utc + hour, EASTERN) == local) | (F.from_utc_timestamp(utc - hour, EASTERN) == local)
    return F.when(offset, wall.try_cast("timestamp")).when((back == local) & ~twice, utc)


def session_utc(date: Column, minute: Column, end: bool = False) -> Column:
    """Start of a session's minute in UTC, or its last millisecond."""
    seconds = minute * 60 + (F.lit(59) if end else F.lit(0))
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(date) * 86400 + seconds), EASTERN) + (F.expr("interval 999 milliseconds") if end else F.expr("interval 0 seconds"))


def grid_status(ts: Column) -> Column:
    """on: a whole minute; off: a minute with seconds, which quarantines it; none: no time at all."""
    return F.when(ts.isNull(), "none").when(F.second(ts) + F.date_format(ts, "SSS").cast("int") == 0, "on").otherwise("off")


def interval_seconds(interval: Column) -> Column:
    """1m, 5m, 1h, 1d to seconds."""
    n = F.regexp_extract(interval, r"^(\d+)([smhd])$", 1).try_cast("int")
    unit = F.regexp_extract(interval, r"^(\d+)([smhd])$", 2)
    return n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)


def sign_label(p: Column) -> Column:
    """Probability to bearish, neutral (0.45 to 0.55, both included) or bullish."""
    return F.when(p > 0.55, "bullish").when(p < 0.45, "bearish").when(p.isNotNull(), "neutral")


def direction_label(z: Column) -> Column:
    return F.when(z > 0, "above baseline").when(z < 0, "below baseline").when(z == 0, "at baseline").otherwise("no baseline")


def sigmoid(z: Column) -> Column:
    """Stable at either end."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def cents(points: Column) -> Column:
    """Exact two-decimal text to integer cents; more precision is refused with null."""
    return F.when(points.rlike(r"^-?\d+(\.\d{1,2})?$"), (points.try_cast("decimal(38,2)") * 100).cast("long"))
