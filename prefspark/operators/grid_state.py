"""The continual grid kept up to date: only new cells are generated and scored.

The state is a folder of written tables: ``outputs`` and ``scores`` in one part a refresh, and ``stats``, partial
aggregates (minimum, maximum, sum, count) of each part's (model, dataset) groups. A matrix is made from
``stats`` alone; a row there also says that its cell is done, so it is written last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.operators.batch import Backend, generate_outputs, score_outputs
from prefspark.operators.evaluation import continual_grid, continual_matrix
from prefspark.plans.broadcast import small_side

STATS = ("model string, dataset string, part string, min_reward double, max_reward double, sum_reward double, "
         "n_scores long, n_rows long")


def read_stats(spark: SparkSession, state: str) -> DataFrame:
    spark.createDataFrame([], STATS).write.mode("ignore").parquet(f"{state}/stats")
    return spark.read.schema(STATS).parquet(f"{state}/stats")


def new_cells(grid: DataFrame, state: str) -> DataFrame:
    """Distinct (model, dataset, reward_model) of ``grid`` that the state does not hold. Bounded by the configuration."""
    done = read_stats(grid.sparkSession, state).select("model", "dataset").distinct()
    cells = grid.select("model", F.col("eval_dataset").alias("dataset"), "reward_model").distinct()
    return cells.join(F.broadcast(done), ["model", "dataset"], "left_anti")


def add_scores(scores: DataFrame, state: str, part: str) -> None:
    """Partial aggregates of ``scores``, a part of the state (new cells, or further rows of old ones)."""
    r = F.col("reward")
    (scores.groupBy("model", "dataset")
     .agg(F.min(r).alias("min_reward"), F.max(r).alias("max_reward"), F.sum(r).alias("sum_reward"),
          F.count(r).alias("n_scores"), F.count(F.lit(1)).alias("n_rows"))
     .select("model", "dataset", F.lit(part).alias("part"), "min_reward", "max_reward", "sum_reward", "n_scores", "n_rows")
     .write.mode("append").parquet(f"{state}/stats"))


def averages(spark: SparkSession, state: str) -> DataFrame:
    """A5 from the partial aggregates: (model, dataset, n_scores, avg_reward)."""
    merged = read_stats(spark, state).groupBy("model", "dataset").agg(
        F.min("min_reward").alias("low"), F.max("max_reward").alias("high"), F.sum("sum_reward").alias("total"),
        F.sum("n_scores").alias("n_scores"))
    mean = F.try_divide(F.col("total"), F.col("n_scores").cast("double"))
    return merged.select("model", "dataset", "n_scores",
                         F.try_divide(mean - F.col("low"), F.col("high") - F.col("low")).alias("avg_reward"))


def refresh(tasks: DataFrame, prompts: DataFrame, state: str, backend: str | Backend = "stub-policy",
            reward_backend: str | Backend = "stub-reward", batch_size: int = 256, ledger: str | None = None) -> DataFrame:
    """The continual matrix of ``tasks`` after its missing cells have been computed.

    ``prompts``: (dataset, row_id, prompt) of all datasets; only those of new cells are read further. A cell
    without prompts stays NULL and is looked for again. If the run breaks, cells whose aggregates were
    not written are computed again (with ``ledger``, without repeating a call)."""
    spark = tasks.sparkSession
    grid = continual_grid(tasks)
    cells = new_cells(grid, state)
    if not cells.isEmpty():
        part = uuid.uuid4().hex[:12]
        wanted = prompts.join(F.broadcast(cells.select("dataset").distinct()), "dataset", "left_semi")
        ledgers = (f"{ledger}/outputs", f"{ledger}/scores") if ledger else (None, None)
        outputs = generate_outputs(wanted, cells, backend, batch_size, path=f"{state}/outputs/part={part}",
                                   ledger=ledgers[0])
        scores = score_outputs(outputs, reward_backend, batch_size, path=f"{state}/scores/part={part}",
                               ledger=ledgers[1])
        add_scores(scores, state, part)
    return continual_matrix(grid, averages(spark, state))


def add_prompts(tasks: DataFrame, prompts: DataFrame, state: str, backend: str | Backend = "stub-policy",
                reward_backend: str | Backend = "stub-reward", batch_size: int = 256) -> None:
    """Further rows of datasets that the state holds: only they are generated and scored, and their partial
    aggregates join those of the cells' earlier parts."""
    done = read_stats(tasks.sparkSession, state).select("model", "dataset").distinct()
    cells = (continual_grid(tasks).select("model", F.col("eval_dataset").alias("dataset"), "reward_model").distinct()
             .join(small_side(done), ["model", "dataset"], "left_semi"))
    part = uuid.uuid4().hex[:12]
    outputs = generate_outputs(prompts, cells, backend, batch_size, path=f"{state}/outputs/part={part}")
    add_scores(score_outputs(outputs, reward_backend, batch_size, path=f"{state}/scores/part={part}"), state, part)
