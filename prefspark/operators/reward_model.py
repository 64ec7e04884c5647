"""M6: a pairwise (Bradley-Terry) linear reward model with Spark ML.

Both sides are hashed into term-frequency vectors; the model is fitted on difference vectors
x_chosen - x_rejected, each as (+d, 1) or (-d, 0) by a hash so that both classes exist; logistic
regression without intercept gives w, and the reward of a text is w . x. Training is distributed
(L-BFGS over partitions); only the weight vector (``num_features`` doubles) reaches the driver.

``fit_hashed_reward`` fits the same kind of model on shares of md5-hashed words, a sparse (row, feature, value) table, to its
one optimum, and ``fit_report`` checks the optimality condition by one aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions.text import hash_unit32, words
from prefspark.session import scratch_path

NUM_FEATURES = 256
ROWS_PER_TASK = 100_000  # training rows per partition (a 256-dim dense row is about 2 KB)


def _featurize(df: DataFrame, text_col: str, out: str, num_features: int) -> DataFrame:
    tok = RegexTokenizer(inputCol=text_col, outputCol=f"_{out}_tok", pattern=r"\s+")
    tf = HashingTF(inputCol=f"_{out}_tok", outputCol=out, numFeatures=num_features)
    return tf.transform(tok.transform(df)).drop(f"_{out}_tok")


@dataclass
class PairwiseRewardModel:
    weights: list[float]
    num_features: int = NUM_FEATURES

    def score(self, df: DataFrame, text_col: str, name: str = "reward") -> DataFrame:
        """Reward w . x of each text (JVM-side: the weights are a literal array)."""
        feats = _featurize(df, text_col, "_x", self.num_features)
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        x = vector_to_array("_x")
        dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return feats.withColumn(name, dot).drop("_x")


def fit_pairwise_reward(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                        num_features: int = NUM_FEATURES, max_iter: int = 50, reg: float = 0.0) -> PairwiseRewardModel:
    fc = _featurize(pairs.select(chosen, rejected), chosen, "_c", num_features)
    both = _featurize(fc, rejected, "_r", num_features)
    d = F.zip_with(vector_to_array("_c"), vector_to_array("_r"), lambda a, b: a - b)
    # (+d, 1) and (-d, 0) have the same loss: each pair is one row whose sign is a hash's, so that both
    # classes exist and half the rows of a mirrored set give the same objective
    diff = both.select(d.alias("d")).withColumn("up", F.pmod(F.xxhash64("d"), F.lit(2)) == 0)
    signed = diff.select(array_to_vector(F.when(F.col("up"), F.col("d")).otherwise(F.transform("d", lambda v: -v)))
                         .alias("features"), F.col("up").cast("double").alias("label"))
    signed = signed.persist(StorageLevel.MEMORY_AND_DISK)
    # every L-BFGS iteration is one pass over all partitions: few for few rows (a large input keeps its own)
    rows = signed.coalesce(max(1, math.ceil(signed.count() / ROWS_PER_TASK)))
    lr = LogisticRegression(fitIntercept=False, maxIter=max_iter, regParam=reg, standardization=False)
    model = lr.fit(rows)
    signed.unpersist()
    return PairwiseRewardModel([float(v) for v in model.coefficients.toArray()], num_features)


def pairwise_accuracy(model: PairwiseRewardModel, pairs: DataFrame, chosen: str = "chosen",
                      rejected: str = "rejected") -> DataFrame:
    """Share of pairs where the chosen text gets the higher reward (plus the pair count)."""
    scored = model.score(pairs, chosen, "r_chosen")
    scored = model.score(scored, rejected, "r_rejected")
    return scored.agg(F.count(F.lit(1)).alias("n_pairs"),
                      F.avg(F.when(F.col("r_chosen") > F.col("r_rejected"), 1.0).otherwise(0.0)).alias("accuracy"))


# ------------------------------------------------------------------ hashed features, and a fit that can be checked

@dataclass
class HashedRewardModel:
    """Weights over md5-hashed words; the reward of a text is the weights' mean over its words."""
    weights: list[float]
    reg: float

    @property
    def num_features(self) -> int:
        return len(self.weights)

    def margin(self, terms="terms"):
        """w . (x_chosen - x_rejected) of a row of ``difference_terms``."""
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        return F.aggregate(terms, F.lit(0.0), lambda total, t: total + F.get(w, t["feature"]) * t["value"])


def difference_terms(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                     num_features: int = NUM_FEATURES, keep=()) -> DataFrame:
    """``keep`` and ``terms``: the sparse (feature, value) entries of x_chosen - x_rejected, where x holds each
    feature's share of a text's words. A text that is NULL or has no words adds none."""
    def ids(column):
        hashed = F.transform(words(column), lambda w: F.pmod(hash_unit32(F.md5(w)), F.lit(num_features)).cast("int"))
        return F.coalesce(hashed, F.array().cast("array<int>"))

    def share(held, f):
        return F.coalesce(F.try_divide(F.size(F.filter(held, lambda x: x == f)).cast("double"), F.size(held)), F.lit(0.0))
    hashed = pairs.select(*keep, ids(chosen).alias("_up"), ids(rejected).alias("_down"))
    value = lambda f: share(F.col("_up"), f) - share(F.col("_down"), f)
    terms = F.transform(F.array_union("_up", "_down"), lambda f: F.struct(f.alias("feature"), value(f).alias("value")))
    return hashed.select(*keep, terms.alias("terms"))


def loss_and_gradient(model: HashedRewardModel, terms: DataFrame) -> tuple[int, float, list[float]]:
    """Number of pairs, mean log-loss + reg / 2 |w|^2 and its gradient at the model's weights, as one aggregation of the
    rows' sparse contributions; at most one row a feature and two more come to the driver."""
    m = model.margin()
    loss = F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
    pull = -F.lit(1.0) / (F.lit(1.0) + F.exp(m))
    entry = lambda feature, value: F.struct(F.lit(feature).alias("feature"), value.alias("value"))
    parts = terms.select("terms", loss.alias("loss"), pull.alias("pull")).select(F.explode(F.concat(
        F.transform("terms", lambda t: F.struct(t["feature"].alias("feature"), (t["value"] * F.col("pull")).alias("value"))),
        F.array(entry(-1, F.col("loss")), entry(-2, F.lit(1.0))))).alias("e"))
    sums = {f: v for f, v in parts.groupBy("e.feature").agg(F.sum("e.value").alias("v")).collect()}
    n = round(sums.pop(-2, 0))
    total = sums.pop(-1, 0.0)
    if not n:
        return 0, 0.0, [0.0] * model.num_features
    gradient = [sums.get(f, 0.0) / n + model.reg * w for f, w in enumerate(model.weights)]
    return n, total / n + model.reg / 2 * sum(w * w for w in model.weights), gradient


def _curvature(model: HashedRewardModel, terms: DataFrame, n: int):
    """The Hessian at the model's weights, by one aggregation of the rows' pairs of entries (each pair once)."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(model.margin()))
    rows = terms.select("terms", (p * (F.lit(1.0) - p)).alias("weight"))
    left = rows.select("terms", "weight", F.explode("terms").alias("a"))
    both = left.select("weight", "a", F.explode(F.filter("terms", lambda t: t["feature"] <= F.col("a.feature"))).alias("b"))
    sums = (both.groupBy(F.col("a.feature").alias("i"), F.col("b.feature").alias("j"))
            .agg(F.sum(F.col("weight") * F.col("a.value") * F.col("b.value")).alias("v")).collect())
    hessian = np.eye(model.num_features) * model.reg
    for i, j, v in sums:  # num_features ** 2 rows at most
        hessian[i, j] += v / n
        hessian[j, i] += v / n if i != j else 0.0
    return hessian


def fit_hashed_reward(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", num_features: int = 64,
                      reg: float = 0.01, tolerance: float = 1e-9, max_steps: int = 50) -> HashedRewardModel:
    """The one minimum of mean log-loss + reg / 2 |w|^2 (reg > 0), by damped Newton steps. Every step is one
    aggregation for the gradient and one for the curvature over the written sparse rows; it ends when no
    component of the gradient is above ``tolerance``."""
    if reg <= 0:
        raise ValueError("the optimum is unique with reg > 0 only")
    spark = pairs.sparkSession
    path = scratch_path(spark, "difference-terms")
    difference_terms(pairs, chosen, rejected, num_features).write.parquet(path)
    terms = spark.read.parquet(path)
    model = HashedRewardModel([0.0] * num_features, reg)
    n, loss, gradient = loss_and_gradient(model, terms)
    for _ in range(max_steps):
        if not n or max(map(abs, gradient)) <= tolerance:
            return model
        step = np.linalg.solve(_curvature(model, terms, n), np.array(gradient))
        size = 1.0
        while True:  # halved until the loss falls (Armijo), so that each step is a descent
            tried = HashedRewardModel([float(w - size * s) for w, s in zip(model.weights, step)], reg)
            found = loss_and_gradient(tried, terms)
            if found[1] <= loss - 1e-4 * size * float(step @ np.array(gradient)) or size < 1e-6:
                break
            size /= 2
        model, (n, loss, gradient) = tried, found
        if size < 1e-6:  # no descent left within the precision of doubles
            return model
    return model


def fit_report(model: HashedRewardModel, pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
               optimum: float = 1e-6) -> DataFrame:
    """One row: pairs, accuracy, loss at the weights, their norm, and whether the optimality condition holds (no
    component of the gradient above ``optimum``)."""
    terms = difference_terms(pairs, chosen, rejected, model.num_features)
    n, loss, gradient = loss_and_gradient(model, terms)
    accuracy = terms.agg(F.count(F.lit(1)).alias("n_pairs"),
                         F.avg(F.when(model.margin() > 0, 1.0).otherwise(0.0)).alias("accuracy"))
    norm = math.sqrt(sum(w * w for w in model.weights))
    return accuracy.select("n_pairs", "accuracy", F.lit(loss).alias("loss"), F.lit(norm).alias("weight_norm"),
                           F.lit(max(map(abs, gradient)) <= optimum).alias("optimal"))
