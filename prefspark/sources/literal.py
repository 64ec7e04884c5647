"""Literal tables - the nested task configuration and hand-copied result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TASKS_SCHEMA = ("idx int, name string, dataset string, test_split string, "
                "models array<string>, reward_model string")
RESULTS_SCHEMA = "task string, model string, reward double"


def tasks_df(spark: SparkSession, cfg: list[dict]) -> DataFrame:
    """The task list (name, dataset, split, models, reward model) as a dimension; idx = position."""
    rows = [(int(c.get("idx", i)), c["name"], c["dataset"], c.get("test_split", "test"),
             list(c["models"]), c.get("reward_model")) for i, c in enumerate(cfg)]
    return spark.createDataFrame(rows, TASKS_SCHEMA)


def results_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A long result table (Task, Model, Reward) given as literal rows."""
    return spark.createDataFrame([(r["Task"], r["Model"], float(r["Reward"])) for r in rows], RESULTS_SCHEMA)
