"""Answers of model calls that outlive the job: a ledger of (request, answer) rows.

A request is a model and a text (and whatever else makes two calls different ones); its key is a hash of
them. A run asks only for requests that the ledger does not hold, each distinct one once, and every
task's answers are published as soon as the task ends. A job that breaks keeps what its finished tasks
have got; the next run, of the same or another job, goes on from there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.plans.broadcast import small_side
from prefspark.session import default_parallelism, scratch_path

TASK_BATCHES = 8  # batches of calls in a task: what a broken task asks again at most


def request_key(*columns) -> Column:
    """The key of a request; NULL if any of ``columns`` is."""
    parts = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in columns]
    some_null = F.greatest(*[c.isNull() for c in parts]) if len(parts) > 1 else parts[0].isNull()
    return F.when(~some_null, F.sha2(F.to_json(F.array(*[c.cast("string") for c in parts])), 256))


def read_ledger(spark: SparkSession, path: str, answer_type: str) -> DataFrame:
    """(request, answer) of all finished tasks; an empty ledger is made if there is none."""
    schema = f"request string, answer {answer_type}"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ask_missing(requests: DataFrame, ledger: str, answer_type: str, call, batch_size: int) -> None:
    """Answer those of ``requests`` (request, model, text) that ``ledger`` lacks, equal ones once.

    ``call`` turns (request, model, text) into (request, answer). Tasks hold ``TASK_BATCHES`` batches, and each is
    committed on its own (version 2 of the file committer renames a task's files when the task ends)."""
    spark = requests.sparkSession
    known = read_ledger(spark, ledger, answer_type).select("request").distinct()
    missing = (requests.where(F.col("request").isNotNull()).distinct()
               .join(small_side(known, reuse=True), "request", "left_anti"))
    path = scratch_path(spark, "requests")
    missing.write.parquet(path)
    missing = spark.read.schema(missing.schema).parquet(path)
    n = missing.count()
    if not n:
        return
    tasks = max(min(n, default_parallelism(spark)), math.ceil(n / (batch_size * TASK_BATCHES)))
    spread = missing.repartitionByRange(tasks, "model", "request")  # a task meets one or two models
    (call(spread).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .parquet(ledger))


def with_answers(df: DataFrame, ledger: str, key: Column, out_col: str, answer_type: str) -> DataFrame:
    """Every row of ``df`` with the ledger's answer to its request (NULL where there is none)."""
    held = read_ledger(df.sparkSession, ledger, answer_type)
    keyed = df.withColumn("_request", key)
    asked = keyed.select(F.col("_request").alias("request")).where(F.col("request").isNotNull()).distinct()
    # two jobs at a time may both have asked for the same: one answer counts
    answers = (held.join(asked, "request", "left_semi").groupBy(F.col("request").alias("_request"))
               .agg(F.min("answer").alias(out_col)))
    return keyed.join(small_side(answers, reuse=True), "_request", "left").drop("_request")


def answered(df: DataFrame, text_col: str, out_col: str, answer_type: str, call, batch_size: int, ledger: str,
             model: Column, per: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out_col``: the answer of ``model`` to ``text_col``. Rows that agree in both and in the columns
    ``per`` are one request (a sampling model that is to answer the same text anew needs such columns)."""
    key = request_key(model, text_col, *per)
    requests = df.select(key.alias("request"), model.alias("model"), F.col(f"`{text_col}`").alias("text"))
    ask_missing(requests, ledger, answer_type, call, batch_size)
    return with_answers(df, ledger, key, out_col, answer_type)
