"""S3: constitutions - one whole text file each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUE: file naming; accepts constitution_{i}.txt and Spark's constitution_id={i}/ folders.
CONSTITUTION_ID = r"constitution_(?:id=)?(\d+)"


def read_constitutions(spark: SparkSession, path: str, strip_final_newline: bool = False) -> DataFrame:
    """(constitution_id, text): each file is read whole (``wholetext``), id from its path."""
    df = spark.read.text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    text = F.col("value")
    if strip_final_newline:
        text = F.regexp_replace(text, r"\n$", "")
    return df.select(F.regexp_extract("_path", CONSTITUTION_ID, 1).cast("long").alias("constitution_id"),
                     text.alias("text"))
