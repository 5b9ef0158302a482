"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added before rounding on either side, so that a tie is no tie.
NUDGE = 1e-9

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals, as the SQL does; whole-number types to long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c + NUDGE, digits) + F.lit(0.0) if kind == "double" else c.cast("long") if kind in ("int", "smallint", "tinyint") else c).alias(name))
    return df.select(*out)


def shown(sql: str, table: str, columns: str, digits: int = 6) -> str:
    """with ... select of columns; 'x:d' is rounded, 'x:l' is a long."""
    parts = []
    for c in columns.split():
        name, _, kind = c.partition(":")
        parts.append({"d": f"round({name} + {NUDGE}, {digits}) + 0.0 as {name}", "l": f"{name}::bigint as {name}"}.get(kind, name))
    return f"with {sql} select {', '.join(parts)} from {table}"
