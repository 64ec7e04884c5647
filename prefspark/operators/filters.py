"""Filters F1-F5. Equality and prefix predicates are plain Column predicates, so Catalyst pushes
them to the parquet reader (``PushedFilters: [EqualTo ..]`` / ``[StringStartsWith ..]``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """F1."""
    return df.where(F.col(column) == F.lit(value))


def starts_with(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """F2."""
    return df.where(F.col(column).startswith(prefix))


def filter_max_length(df: DataFrame, n: int, chosen: str = "chosen_ids", rejected: str = "rejected_ids") -> DataFrame:
    """keep pairs whose longer side has at most ``n`` tokens (longer pairs are dropped)."""
    return df.where(F.greatest(F.size(chosen), F.size(rejected)) <= F.lit(n))
