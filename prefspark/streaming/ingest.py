"""Incremental ingestion of the preference drop directory with Structured Streaming.

Every finished generation run drops one CSV file; the stream picks up only files it has not seen
(the file source keeps the processed-file log in the checkpoint), cleans them (label strip X1,
rename P1) and appends Parquet. ``availableNow`` processes what is there and stops, so the same
job serves as a scheduled batch; a re-run adds nothing. Stateless: no watermark needed. The exact
flip (G1) needs the total row count and is not streamable; use the per-row hash flip (G2).

The stream carries the lines of new files, of which only the headers' hashes are kept; the files of a micro-batch
are then read like the batch reader reads them: columns by name, files with surplus fields rejected whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.operators.preferences import strip_response_labels, to_chosen_rejected
from prefspark.operators.ranking import flip_preferences
from prefspark.sources import csv as csv_src
from prefspark.sources.csv import PREFERENCE_SCHEMA, UNQUOTED_EMPTY


def clean_preferences(df: DataFrame, keep=("source_file",)) -> DataFrame:
    """X1 on both responses, then P1 (works on batch and streaming frames alike)."""
    return to_chosen_rejected(strip_response_labels(df), keep=keep)


def new_file_lines(spark: SparkSession, in_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the lines of files not seen before, with their ``file_path``."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return csv_src.file_lines(reader, in_dir)


def read_new_files(lines: DataFrame, schema: str = PREFERENCE_SCHEMA) -> DataFrame:
    """The rows of a micro-batch's files by column name, with ``source_file``; without files that hold a row
    with more fields than their header."""
    spark = lines.sparkSession
    found = csv_src.layouts(spark, lines)
    if not found:
        return spark.createDataFrame([], f"{schema}, source_file string")
    if found[0][1] is None:  # one layout: its files are those of the batch
        found = [(found[0][0], [r[0] for r in lines.select("file_path").distinct().collect()])]
    marked = csv_src.read_marked(spark, [], schema, UNQUOTED_EMPTY, False, False, found)
    rows = marked.withColumnRenamed("file_path", "source_file")
    bad = rows.where("_too_many").select("source_file").distinct()
    return rows.join(bad, "source_file", "left_anti").drop("_too_many")


def for_each_batch(spark: SparkSession, in_dir: str, checkpoint: str, write, max_files_per_trigger: int | None = None
                   ) -> None:
    """Call ``write(lines, number)`` for each micro-batch of new files until none is left."""
    query = (new_file_lines(spark, in_dir, max_files_per_trigger).writeStream
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()


def ingest_preferences_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                              flip_ratio: float | None = None, flip_key=("source_file", "prompt"),
                              seed: int = 42, max_files_per_trigger: int | None = None,
                              schema: str = PREFERENCE_SCHEMA, keep=("source_file",)) -> None:
    """Write the cleaned rows of all new files under ``in_dir`` to Parquet at ``out_dir``, one folder
    per micro-batch (``batch=n``; a repeated batch replaces its own folder). A file is read within
    one batch; one with a surplus field in any row is rejected whole, like the batch reader does."""
    columns = tuple(dict.fromkeys(tuple(keep) + ("source_file",)))

    def write(lines: DataFrame, number: int) -> None:
        cleaned = clean_preferences(read_new_files(lines, schema), keep=columns)
        if flip_ratio is not None:
            cleaned = flip_preferences(cleaned, flip_ratio, list(flip_key), seed=seed, exact=False)
        cleaned.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    for_each_batch(spark, in_dir, checkpoint, write, max_files_per_trigger)
