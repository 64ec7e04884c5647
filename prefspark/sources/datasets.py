"""A dataset stored as Parquet partitioned by ``split``; a named split prunes partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All splits (with a ``split`` column), or only ``split`` (only its folder is listed/read)."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
