"""Streaming ingestion equals the batch path; batch-function jobs; the pairwise reward model."""

import os

import pytest
from pyspark.sql import functions as F

from prefspark.operators import batch, reward_model
from prefspark.sinks import writers
from prefspark.sources import csv as csv_src
from prefspark.streaming.ingest import clean_preferences, ingest_preferences_stream


def _drop(spark, path, rows):
    writers.write_csv(spark.createDataFrame(rows, csv_src.PREFERENCE_SCHEMA).coalesce(1), path, mode="append")


def test_stream_equals_batch_and_rerun_adds_nothing(spark, tmp_dir):
    drop, out, ckpt = (os.path.join(tmp_dir, x) for x in ("drop", "out", "ckpt"))
    first = [(f"p{i}", f"Response 1: good {i}", f"Response 2: bad {i} ") for i in range(5)]
    second = [(f"q{i}", f"Response 1:  ok {i}", f"Response 2: no {i}") for i in range(3)]
    _drop(spark, drop, first)
    ingest_preferences_stream(spark, drop, out, ckpt)
    assert spark.read.parquet(out).count() == 5
    _drop(spark, drop, second)
    ingest_preferences_stream(spark, drop, out, ckpt)
    ingest_preferences_stream(spark, drop, out, ckpt)          # nothing new: nothing added
    streamed = spark.read.parquet(out).select("prompt", "chosen", "rejected")
    batch_df = clean_preferences(csv_src.read_preferences(spark, drop).withColumn("source_file", F.lit("")))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch_df.select("prompt", "chosen", "rejected").collect()))
    assert streamed.count() == 8
    assert ("p0", "good 0", "bad 0") in [tuple(r) for r in streamed.collect()]


def test_backend_registry():
    assert batch.resolve_backend("STUB-JUDGE") is batch.stub_judge
    with pytest.raises(ValueError, match="stub-judge"):
        batch.resolve_backend("no-such-model")


def test_backend_length_mismatch_raises(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    bad = lambda model: (lambda texts: texts[:-1])
    with pytest.raises(Exception, match="outputs for"):
        batch.map_batches(df, "t", "o", "string", bad, 8, carry=["k"]).collect()


def test_backend_sees_batches_of_given_size(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "k long, t string").coalesce(1)
    sizes = lambda model: (lambda texts: [str(len(texts))] * len(texts))
    out = batch.map_batches(df, "t", "o", "string", sizes, 8, carry=["k"]).collect()
    assert sorted(int(r["o"]) for r in out) == sorted([8] * 16 + [4] * 4)


def test_one_backend_per_model_and_partition(spark):
    df = spark.createDataFrame([(m, i, f"t{i}") for m in ("a", "b") for i in range(10)],
                               "model string, row_id long, t string").coalesce(1)
    echo = lambda model: (lambda texts: [f"{model}:{t}" for t in texts])
    out = batch.map_batches(df, "t", "o", "string", echo, 4, carry=["row_id"], model_col="model").collect()
    assert all(r["o"] == f"{r['model']}:t{r['row_id']}" for r in out) and len(out) == 20


def test_pairwise_reward_model_separable(spark):
    good = ["kind helpful honest answer", "respectful fair reply", "helpful and kind", "fair honest help"]
    bad = ["rude hateful insult", "unfair biased insult", "hateful rude reply", "biased rude answer"]
    pairs = spark.createDataFrame([(g, b) for g in good for b in bad], "chosen string, rejected string")
    model = reward_model.fit_pairwise_reward(pairs, num_features=64)
    acc = reward_model.pairwise_accuracy(model, pairs).first()
    assert acc["n_pairs"] == 16 and acc["accuracy"] > 0.5


def test_generation_partitions_balanced_with_dominant_model(spark):
    """One model owns a third of the work: range partitioning still balances rows per task."""
    prompts = spark.createDataFrame([("d1", i, f"p{i}") for i in range(3000)], "dataset string, row_id long, prompt string")
    grid = spark.createDataFrame([("big", "d1")] + [(f"m{j}", "d1") for j in range(2)], "model string, dataset string")
    out = batch.generate_outputs(prompts, grid, backend="stub-policy", num_partitions=6)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 9000 and max(sizes) < 2 * 9000 / 6
    models_per_task = out.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("model").alias("m")).collect()
    assert max(r["m"] for r in models_per_task) <= 2


def test_generate_outputs_include_prompt(spark):
    prompts = spark.createDataFrame([("d1", 1, "Hello there")], "dataset string, row_id long, prompt string")
    grid = spark.createDataFrame([("m", "d1")], "model string, dataset string")
    full = batch.generate_outputs(prompts, grid).first()["generated_text"]
    tail = batch.generate_outputs(prompts, grid, include_prompt=False).first()["generated_text"]
    assert full == "Hello there -> m answer of 2 words" and tail == " -> m answer of 2 words"


def test_stream_with_hash_flip_equals_batch(spark, tmp_dir):
    from prefspark.operators.ranking import flip_preferences
    drop, out, ckpt = (os.path.join(tmp_dir, x) for x in ("drop", "out", "ckpt"))
    rows = [(f"p{i}", f"Response 1: good {i}", f"Response 2: bad {i}") for i in range(40)]
    _drop(spark, drop, rows[:25])
    _drop(spark, drop, rows[25:])
    ingest_preferences_stream(spark, drop, out, ckpt, flip_ratio=0.6, flip_key=("prompt",), max_files_per_trigger=1)
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select("prompt", "chosen", "rejected", "flipped").collect())
    base = clean_preferences(csv_src.read_preferences(spark, drop).withColumn("source_file", F.lit("")))
    batch_rows = flip_preferences(base, 0.6, ["prompt"], exact=False).select("prompt", "chosen", "rejected", "flipped")
    assert streamed == sorted(tuple(r) for r in batch_rows.collect())
    assert 0 < sum(r[3] for r in streamed) < 40


def test_package_is_shipped_to_workers(spark):
    """Python workers import the package from the shipped archive, whatever the driver's cwd."""
    from prefspark.session import ship_package
    ship_package(spark)
    ship_package(spark)  # once per context
    files = spark.sparkContext.listFiles if hasattr(spark.sparkContext, "listFiles") else None
    if files is not None:
        assert any(f.endswith("prefspark.zip") for f in files)


def test_pairwise_reward_model_matches_newton_solution(spark):
    """With L2 regularisation the fit has one optimum: compare Spark's weights with a numpy
    Newton solve of the same objective on the same hashed difference features."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    good = ["kind helpful honest answer", "respectful fair reply", "helpful and kind", "fair honest help"]
    bad = ["rude hateful insult", "unfair biased insult", "hateful rude reply", "biased rude answer"]
    pairs = spark.createDataFrame([(g, b) for g in good for b in bad], "chosen string, rejected string")
    reg = 0.1
    model = reward_model.fit_pairwise_reward(pairs, num_features=32, reg=reg, max_iter=200)
    feats = reward_model._featurize(reward_model._featurize(pairs, "chosen", "_c", 32), "rejected", "_r", 32)
    rows = feats.select(vector_to_array("_c").alias("c"), vector_to_array("_r").alias("r")).collect()
    d = np.array([np.array(r["c"]) - np.array(r["r"]) for r in rows])
    x = np.vstack([d, -d])
    y = np.concatenate([np.ones(len(d)), -np.ones(len(d))])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton on mean log-loss + reg/2 |w|^2
        m = y * (x @ w)
        p = 1.0 / (1.0 + np.exp(m))
        grad = -(x * (y * p)[:, None]).mean(axis=0) + reg * w
        hess = (x.T * (p * (1 - p))) @ x / len(y) + reg * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    assert np.allclose(np.array(model.weights), w, atol=1e-3)
