"""M6 over hashed words: the gradient, the optimum and the report against plain numpy."""

import hashlib

import numpy as np
import pytest

from prefspark.operators import reward_model as R

ROWS = [("kind helpful honest answer", "rude hateful insult"), ("respectful fair reply", "unfair biased insult"),
        ("helpful and kind", "kind of rude"), ("fair", "fair"), ("", "rude"), (None, "hateful reply"), ("honest", None),
        ("kind kind kind rude", "biased rude answer"), (None, None), ("rude insult", "kind helpful reply")]


def vectors(rows, k):
    def shares(text):
        x = np.zeros(k)
        for w in (text or "").split():
            x[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % k] += 1
        return x / x.sum() if x.sum() else x
    return np.array([shares(c) - shares(r) for c, r in rows])


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "chosen string, rejected string").repartition(3)


def test_terms_are_the_difference_vectors(spark):
    df = frame(spark).withColumn("k", R.F.monotonically_increasing_id())
    rows = R.difference_terms(df, num_features=8, keep=["chosen", "rejected"]).collect()
    for r in rows:
        x = np.zeros(8)
        for t in r["terms"]:
            x[t["feature"]] += t["value"]
        assert np.allclose(x, vectors([(r["chosen"], r["rejected"])], 8)[0])


def test_loss_and_gradient(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=8)
    d = vectors(ROWS, 8)
    n, loss, gradient = R.loss_and_gradient(R.HashedRewardModel(w.tolist(), 0.3), R.difference_terms(frame(spark), num_features=8))
    m = d @ w
    assert n == len(ROWS) and loss == pytest.approx(np.log1p(np.exp(-m)).mean() + 0.15 * (w @ w))
    assert np.allclose(gradient, -(d / (1 + np.exp(m))[:, None]).mean(0) + 0.3 * w)


@pytest.mark.parametrize("reg", [0.001, 0.1])
def test_fit_is_the_optimum(spark, reg):
    model = R.fit_hashed_reward(frame(spark), num_features=12, reg=reg)
    d, w = vectors(ROWS, 12), np.zeros(12)
    for _ in range(60):  # Newton with numpy
        p = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve((d.T * (p * (1 - p))) @ d / len(d) + reg * np.eye(12), -(d * p[:, None]).mean(0) + reg * w)
    assert np.allclose(model.weights, w, atol=1e-6)
    report = R.fit_report(model, frame(spark)).first()
    assert report["optimal"] and report["n_pairs"] == len(ROWS)
    assert report["accuracy"] == pytest.approx((d @ w > 1e-12).mean())
    off = R.fit_report(R.HashedRewardModel([x + 0.01 for x in model.weights], reg), frame(spark)).first()
    assert not off["optimal"] and off["loss"] > report["loss"]


def test_no_pairs_and_no_penalty(spark):
    model = R.fit_hashed_reward(frame(spark, []), num_features=4)
    assert model.weights == [0.0] * 4 and R.fit_report(model, frame(spark, [])).first()["n_pairs"] == 0
    with pytest.raises(ValueError, match="unique"):
        R.fit_hashed_reward(frame(spark), reg=0.0)
