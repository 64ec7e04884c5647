"""The driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from prefspark.session import default_parallelism

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Tables whose rows carry whole texts (per-row regex, hashing and tokenising work is CPU-bound),
# with their unique id.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def spread(df: DataFrame, min_partitions: int | None = None, by: str | None = None) -> DataFrame:
    """Spread ``df`` over at least ``min_partitions`` (default: the cluster's parallelism) when
    its scan yields fewer splits - e.g. one large file with a single row group. Hash-partitions on
    the unique column ``by`` when given (deterministic without sorting the rows), else round-robin.
    A scan of a large dataset already has more splits than cores and is left alone (no shuffle)."""
    target = min_partitions or default_parallelism(df.sparkSession)
    try:
        splits = df.rdd.getNumPartitions()
    except Exception:  # no RDD view of this session: leave the scan as it is
        return df
    if splits >= target:
        return df
    return df.repartition(target, by) if by else df.repartition(target)


def read_table(spark: SparkSession, sf_dir: str, name: str, text: bool = True) -> DataFrame:
    """Read one table; column pruning and filters reach the parquet scan. ``text=False`` for work that
    does not touch the long texts: the scan then stays as it is, without a shuffle."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df, by=TEXT_TABLES[name]) if text and name in TEXT_TABLES else df
