"""Shared-folder tables and small helpers of the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir

__all__ = ["not_null", "sha256_hex", "shared_dir", "span_text", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, path: str, **options: object) -> DataFrame:
    """Write a table to the shared folder and read it again: this cuts the lineage, and lost executors lose nothing of it."""
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def span_text(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def not_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))
