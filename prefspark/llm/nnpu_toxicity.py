"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the character 5-grams of a text's words is trained in numpy from confirmed toxic texts (P) and
texts whose label is not looked at (U, a sample of all texts). With the class prior c and a loss l, the negative part of
the risk is estimated as R_U(l-) - c R_P(l-); it cannot be negative, so a step that would push it
below zero climbs back instead of descending.

Only rows that are not held out are learned from; at most about ``MAX_POSITIVE`` toxic and
``MAX_UNLABELLED`` other texts (chosen by a hash of doc_id) are turned into 5-gram ids on the
executors and sent to the driver. The prior is the toxic share of the labelled rows there.

Null texts and texts without letters have no 5-grams and get the score of an empty text. A doc_id that is labelled
several times is toxic if one of its labels is. Without a toxic example every score is 0. Repeated rows are scored
alike; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import bounded_sample, held_out, prepare, text_or_empty

MAX_POSITIVE = 3_000
MAX_UNLABELLED = 9_000
GRAM = 5
GRAM_BITS = 21
MIN_POSITIVE, MIN_SHARE = 4, 0.005  # toxic training texts that must have a 5-gram
MIN_LIFT = 3.0  # how much commoner a 5-gram must be in toxic texts than in others
MAX_GRAMS = 2_000  # 5-grams of the model, by how much commoner they are in toxic texts
STEPS, RATE, L2 = 300, 0.1, 1e-4
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
NO_LETTER = re.compile(r"[\W\d_]+")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def gram_ids(text: str) -> np.ndarray:
    """Hashes of the distinct character 5-grams of the lower-cased words, sorted. A word is what
    stands between other characters than letters; one blank before and after it counts in."""
    plain = f" {NO_LETTER.sub(' ', text).lower()} "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    blank = codes == 32
    h, torn = np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in range(GRAM):
        h += codes[k:k + n] * _FACTORS[k]
        if 0 < k < GRAM - 1:
            torn |= blank[k:k + n]
    h ^= h >> np.uint32(15)
    h *= _FACTORS[0]
    return np.unique(h[~torn] >> np.uint32(32 - GRAM_BITS)).astype(np.int32)


class Model:
    """Weights of some 5-grams. The table by id is made where it is used."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, bias: float):
        self.grams, self.weights, self.bias = grams, weights, bias

    def __getstate__(self):
        return self.grams, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    @cached_property
    def table(self) -> np.ndarray:
        table = np.zeros(1 << GRAM_BITS, np.float32)
        table[self.grams] = self.weights
        return table

    def score(self, ids: np.ndarray) -> float:
        total = self.bias + float(self.table[ids].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


class _Rows:
    """Texts as rows of a sparse 0/1 matrix over the model's 5-grams."""

    def __init__(self, texts: list[np.ndarray], grams: np.ndarray):
        place = np.full(1 << GRAM_BITS, -1, np.int32)
        place[grams] = np.arange(len(grams))
        self.n, self.width = len(texts), len(grams)
        sizes = [len(t) for t in texts]
        flat = place[np.concatenate([np.zeros(0, np.int32), *texts])]
        row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.row, self.column = row[flat >= 0], flat[flat >= 0]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.n)

    def back(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, per_row[self.row], self.width)


def choose_grams(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """5-grams that are much commoner in toxic texts than in the others. Their share of the others
    is what U has beyond its part of toxic texts."""
    size = 1 << GRAM_BITS
    p = np.bincount(np.concatenate([np.zeros(0, np.int32), *positive]), minlength=size) / len(positive)
    u = np.bincount(np.concatenate([np.zeros(0, np.int32), *unlabelled]), minlength=size) / len(unlabelled)
    other = np.maximum((u - prior * p) / (1 - prior), 1 / len(unlabelled))
    least = max(MIN_POSITIVE / len(positive), MIN_SHARE)
    found = np.flatnonzero((p >= least) & (p >= MIN_LIFT * other))
    weight = np.sqrt(p[found]) * np.log(p[found] / other[found])
    return np.sort(found[np.argsort(-weight, kind="stable")[:MAX_GRAMS]])


def risk(theta: np.ndarray, p: _Rows, u: _Rows, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, gradient) of the risk at ``theta`` (weights, then the bias). The risk is the positive part and,
    where it is not below zero, the negative part; below zero the step climbs the negative part alone."""
    fp, fu = p.times(theta[:-1]) + theta[-1], u.times(theta[:-1]) + theta[-1]
    negative = _softplus(fu).mean() - prior * _softplus(fp).mean()
    down_p, up_p, up_u = -_sigmoid(-fp) / p.n, _sigmoid(fp) / p.n, _sigmoid(fu) / u.n
    if negative >= 0:
        on_p, on_u = prior * (down_p - up_p), up_u
    else:  # climb: the negative part alone, reversed
        on_p, on_u = prior * up_p, -up_u
    gradient = np.append(p.back(on_p) + u.back(on_u) + L2 * theta[:-1], on_p.sum() + on_u.sum())
    return prior * _softplus(-fp).mean(), negative, gradient


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Non-negative risk minimisation with Adam over all sampled rows."""
    grams = choose_grams(positive, unlabelled, prior)
    p, u = _Rows(positive, grams), _Rows(unlabelled, grams)
    theta = np.zeros(len(grams) + 1)  # weights, then the bias
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        gradient = risk(theta, p, u, prior)[2]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        theta -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
    return Model(grams, theta[:-1], float(theta[-1]))


def _gram_rows(frames):
    for pdf in frames:
        yield pd.DataFrame({"toxic": pdf["toxic"], "ids": [gram_ids(text_or_empty(t)).tobytes() for t in pdf["text"]]})


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """None if there is no toxic example."""
    prepare(docs.sparkSession)
    marked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n, toxic = marked.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).first()
    if not toxic:
        return None
    learn = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # ids are sampled first; texts are read for the sampled rows only (two small id tables)
    known = marked.where("toxic = 1").select("doc_id")
    some = bounded_sample(known, "doc_id", MAX_POSITIVE).withColumn("toxic", F.lit(True))
    # U is a sample of all texts, toxic ones included: that is what the prior corrects for
    other = bounded_sample(learn.select("doc_id").distinct(), "doc_id", MAX_UNLABELLED).withColumn(
        "toxic", F.lit(False))
    chosen = some.union(other).limit(2 * (MAX_POSITIVE + MAX_UNLABELLED))
    # one text an id, however often it occurs; a toxic text may be in both samples
    texts = learn.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = texts.select("toxic", "text").mapInPandas(
        _gram_rows, "toxic boolean, ids binary").toPandas()
    sample["ids"] = sample["ids"].map(lambda x: np.frombuffer(x, np.int32))
    positive = sample.loc[sample["toxic"], "ids"].tolist()
    unlabelled = sample.loc[~sample["toxic"], "ids"].tolist()
    if not positive or not unlabelled:
        return None
    return fit(positive, unlabelled, float(np.clip(toxic / n, 0.005, 0.5)))


def _scored(frames, model: Model | None):
    for pdf in frames:
        scores = np.array([model.score(gram_ids(text_or_empty(t))) if model else 0.0 for t in pdf["text"]], float)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"],
                            "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)})


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text); ``labels`` holds doc_id and toxic."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_GRAMS weights
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(
        lambda it: _scored(it, shared.value), SCHEMA)
