"""Distributed union-find: connected components by alternating large-star and small-star steps.

Every step is a few joins and partial aggregations over the edge table, written to the shared
checkpoint folder. Nothing is collected but two numbers per round. A node with very many
neighbours is never gathered: its smallest neighbour is a partial aggregation, and the join on it
can be split by the adaptive planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import remove, save
from prefspark.session import scratch_path


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def components(edges: DataFrame, name: str = "components", max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``a``, ``b``; either direction, loops and
    repeats allowed) but the roots; the root is the component's smallest node."""
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, name)
    current = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a <> b").distinct(), name, path=path)
    state = _fingerprint(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        former, path = path, scratch_path(spark, name)
        current = save(_small_star(_large_star(current)), name, path=path)
        remove(spark, former)
        state, before = _fingerprint(current), state
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
