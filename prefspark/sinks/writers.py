"""K1-K5: sinks. ``mode`` is 'overwrite' / 'append' / 'error'; partitioned overwrites replace
only the partitions present in the data (dynamic partition overwrite)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions.text import path_name
from prefspark.operators.preferences import strip_response_labels


def _writer(df: DataFrame, mode: str, partition_by: Sequence[str] = ()):
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    return w


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """K2: CSV with header and without index. Cells are quoted when they hold a quote, the
    separator or a line break (quotes doubled); no trimming; NULL is an empty unquoted field and
    '' a quoted empty field - an exact round trip through ``read_preferences`` without any
    sentinel text that a real cell could collide with."""
    (_writer(df, mode, partition_by)
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_preferences(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """K1: generated preference rows; the 'Response 1:' / 'Response 2:' labels are removed first."""
    write_csv(strip_response_labels(df), path, mode, partition_by)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    _writer(df, mode, partition_by).parquet(path)


def clustered(df: DataFrame, folders: Sequence[str]) -> DataFrame:
    """``df`` rebalanced by its folders before a partitioned write: small folders come together in one task and
    large ones are split by bytes (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), so that the number of files of a
    folder follows its size and not the number of tasks."""
    return df.hint("rebalance", *folders)


def write_outputs(df: DataFrame, base: str, mode: str = "overwrite") -> None:
    """K3: one folder per (model, dataset), names made path-safe ('/' -> '_'); later reads of a
    single (model, dataset) prune to that folder."""
    folders = ("model_dir", "dataset_dir")
    out = (df.withColumn("model_dir", path_name("model"))
             .withColumn("dataset_dir", path_name("dataset")))
    write_parquet(clustered(out, folders), base, mode, folders)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: named evaluation metrics as JSON lines. Metrics are made by aggregates and come in one file by
    themselves; a larger frame is written in as many files as it has tasks."""
    df.write.mode(mode).json(path)


def metrics_long(df: DataFrame) -> DataFrame:
    """One metrics row -> (metric, value) rows, for K4."""
    cols = [c for c in df.columns]
    args = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    return df.select(F.expr(f"stack({len(cols)}, {args}) AS (metric, value)"))
