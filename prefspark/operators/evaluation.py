"""Continual evaluation: grid of (model, earlier-or-current dataset), reward normalisation,
averages, the continual matrix and its running averages.

The grid is built from the task dimension only (bounded by the configuration); scores can be
arbitrarily large and are only aggregated (partial + final) or joined with broadcast group stats.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.arrays import pad_left
from prefspark.operators.ranking import assign_batches, with_row_index
from prefspark.plans.broadcast import small_side

DROP_SHARE = 0.4  # FIXED VALUE: the "60 % drop" point is first reward * 0.4


def continual_grid(tasks: DataFrame) -> DataFrame:
    """J2 + J3: every model of task i paired with the datasets of tasks j <= i.

    (task_idx, task, model, eval_idx, eval_task, eval_dataset, reward_model)
    """
    trained = tasks.select(F.col("idx").alias("task_idx"), F.col("name").alias("task"),
                           F.explode("models").alias("model"))
    evals = tasks.select(F.col("idx").alias("eval_idx"), F.col("name").alias("eval_task"),
                         F.col("dataset").alias("eval_dataset"), "reward_model")
    return trained.join(F.broadcast(evals), F.col("eval_idx") <= F.col("task_idx"))


def group_reward_stats(scores: DataFrame, by: Sequence[str] = ("model", "dataset"),
                       reward: str = "reward") -> DataFrame:
    """min / max / avg / count of the rewards per group: one partial + final aggregation."""
    r = F.col(reward)
    return scores.groupBy(*by).agg(F.min(r).alias("min_reward"), F.max(r).alias("max_reward"),
                                   F.avg(r).alias("mean_reward"), F.count(r).alias("n_scores"))


def normalize_rewards(scores: DataFrame, by: Sequence[str] = ("model", "dataset"),
                      reward: str = "reward", name: str = "norm_reward") -> DataFrame:
    """(reward - min) / (max - min) within each group; a constant group gives NULL. Rows with a
    NULL key form a group like any other.

    Group stats (one row per group) are joined back - broadcast when small - instead of a window,
    so a huge group is never gathered into one task.
    """
    stats = group_reward_stats(scores, by, reward).select(*by, "min_reward", "max_reward")
    spread = F.col("max_reward") - F.col("min_reward")
    keys = {c: f"_by_{c}" for c in by}
    side = small_side(stats.withColumnsRenamed(keys), reuse=True)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return (scores.join(side, same)
                  .withColumn(name, F.try_divide(F.col(reward) - F.col("min_reward"), spread))
                  .drop("min_reward", "max_reward", *keys.values()))


def avg_normalized_reward(scores: DataFrame, by: Sequence[str] = ("model", "dataset"),
                          reward: str = "reward") -> DataFrame:
    """A5: mean of the min-max normalised rewards = (avg - min) / (max - min), in one aggregation."""
    stats = group_reward_stats(scores, by, reward)
    spread = F.col("max_reward") - F.col("min_reward")
    return stats.select(*by, "n_scores",
                        F.try_divide(F.col("mean_reward") - F.col("min_reward"), spread).alias("avg_reward"))


def continual_matrix(grid: DataFrame, averages: DataFrame) -> DataFrame:
    """The grid with the average reward of each (model, eval dataset); NULL when outputs are missing."""
    avg = averages.select(F.col("model").alias("_m"), F.col("dataset").alias("_d"), "avg_reward")
    joined = grid.join(small_side(avg, reuse=True), (F.col("model") == F.col("_m")) & (F.col("eval_dataset") == F.col("_d")),
                       "left")
    return joined.select("task_idx", "task", "model", "eval_idx", "eval_task", "avg_reward")


def missing_outputs(grid: DataFrame, scores: DataFrame) -> DataFrame:
    """J4 (anti): grid cells whose (model, dataset) has no output at all."""
    have = scores.select(F.col("model").alias("_m"), F.col("dataset").alias("_d")).distinct()
    return grid.join(small_side(have, reuse=True),
                     (F.col("model") == F.col("_m")) & (F.col("eval_dataset") == F.col("_d")), "left_anti")


def results_map(matrix: DataFrame) -> DataFrame:
    """Task -> model -> {eval_task: avg_reward} as a MapType column per (task, model)."""
    entries = F.sort_array(F.collect_list(F.struct("eval_task", "avg_reward")))
    return matrix.groupBy("task_idx", "task", "model").agg(F.map_from_entries(entries).alias("rewards"))


def continual_average(results: DataFrame, model: str = "model", task: str = "task",
                      reward: str = "reward") -> DataFrame:
    """Per model in task order, cumulative count, cumulative sum and their ratio.

    Runs over result tables (one row per model and task), never over raw scores. A row with a
    missing reward counts, but has no sum and no average itself; later sums leave it out.
    """
    w = Window.partitionBy(model).orderBy(task).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (results.withColumn("cumulative_count", F.count(F.lit(1)).over(w).cast("long"))
                   .withColumn("cumulative_sum", F.when(F.col(reward).isNotNull(), F.sum(reward).over(w)))
                   .withColumn("continual_average_reward", F.col("cumulative_sum") / F.col("cumulative_count")))


def first_and_drop(results: DataFrame, prefixes: Sequence[str] = ("DPO", "PPO"), task_value: str | None = None,
                   model: str = "model", task: str = "task", reward: str = "reward") -> DataFrame:
    """F1 + F2 + W9: per model prefix, the reward of the first model in name order and the
    '60 % drop' point (first * 0.4)."""
    df = results if task_value is None else results.where(F.col(task) == task_value)
    prefix = None
    for p in prefixes:
        cond = F.col(model).startswith(p)
        prefix = F.when(cond, F.lit(p)) if prefix is None else prefix.when(cond, F.lit(p))
    tagged = df.withColumn("prefix", prefix).where(F.col("prefix").isNotNull())
    out = tagged.groupBy("prefix").agg(F.min(model).alias("first_model"),
                                        F.min_by(reward, model).alias("first_reward"))
    return out.withColumn("drop_point", F.col("first_reward") * F.lit(DROP_SHARE).cast("double"))


def zip_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str],
             index: str = "row_idx") -> DataFrame:
    """Row i of ``left`` with row i of ``right`` (each in its own key order); the inner join
    cuts to the shorter side. An existing index column on both sides is used as is."""
    li = left if index in left.columns else with_row_index(left, left_order, index)
    ri = right if index in right.columns else with_row_index(right, right_order, index)
    return li.join(ri, index)


def pad_to_longest(df: DataFrame, ids: str, order_by: Sequence[str], batch_size: int, pad_id: int = 0,
                   name: str = "padded") -> DataFrame:
    """Batches of ``batch_size`` in key order, each array left-padded to its batch's longest.

    The per-batch maximum is a window over batch_id: a group is at most ``batch_size`` rows.
    """
    batched = assign_batches(df, order_by, batch_size)
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    return (batched.withColumn("batch_len", longest.cast("int"))
                   .withColumn(name, pad_left(ids, F.col("batch_len"), pad_id)))


def padding_cost(df: DataFrame, length: str, order_by: Sequence[str], batch_size: int, window: int = 32) -> DataFrame:
    """What batches cost in padding, as they come and dealt by length.

    (way, n_batches, n_tokens, n_padding): every text of a batch is padded to its longest. ``as_they_come`` are the
    batches in key order; ``by_length`` deals the texts of every ``window`` consecutive batches by length first, as
    ``map_batches(.., window=..)`` does. Windows are ``window * batch_size`` rows; NULL lengths count as 0."""
    batched = assign_batches(df.select(*order_by, F.coalesce(F.col(length), F.lit(0)).cast("long").alias("_len")),
                             order_by, batch_size)
    group = F.floor(F.col("batch_id") / F.lit(window)).cast("long")
    place = F.row_number().over(Window.partitionBy("_window").orderBy("_len", "row_idx")) - 1
    dealt = batched.withColumn("_window", group).select(
        "_len", "batch_id", (F.col("_window") * window + F.floor(place / F.lit(batch_size))).cast("long").alias("dealt"))
    both = dealt.select("_len", F.explode(F.create_map(F.lit("as_they_come"), "batch_id", F.lit("by_length"), "dealt"))
                        .alias("way", "batch"))
    batches = both.groupBy("way", "batch").agg(F.max("_len").alias("longest"), F.sum("_len").alias("tokens"),
                                               F.count(F.lit(1)).alias("rows"))
    return batches.groupBy("way").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("tokens").alias("n_tokens"),
                                      F.sum(F.col("longest") * F.col("rows") - F.col("tokens")).alias("n_padding"))
