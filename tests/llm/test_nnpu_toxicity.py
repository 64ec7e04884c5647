import zlib

import numpy as np
import pytest

from prefspark.llm import nnpu_toxicity as nn
from llm_fixtures import ODD_ROWS, frame

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=800):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, rng.integers(20, 80)))
        toxic = k % 8 == 0
        if toxic:
            for _ in range(4):
                text[rng.integers(0, len(text))] = str(rng.choice(["zquargh", "vwumpf", "xqizzle"]))
        rows.append((k, " ".join(text), "en", "s"))
        if k // 8 % 2 == 0:
            labels.append((k, 1, int(toxic)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    out = {r["doc_id"]: r for r in nn.score(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.3) for i, r in out.items())
    right = [out[i]["predicted"] == int(i % 8 == 0) for i in out if held(i)]
    assert np.mean(right) > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = corpus(400)
    flipped = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    a, b = ({r["doc_id"]: r["score"] for r in nn.score(frame(spark, rows), spark.createDataFrame(x, LABELS)).collect()}
            for x in (labels, flipped))
    assert a == b


def test_negative_part_never_pays(monkeypatch):
    """With a prior far too large the plain estimate would go below zero; the corrected one must not
    push unlabelled texts to the toxic side without end."""
    rng = np.random.default_rng(0)
    toxic = [np.array([1, 2, 3 + int(rng.integers(0, 5))], np.int32) for _ in range(50)]
    other = [np.array([20 + int(rng.integers(0, 30))], np.int32) for _ in range(400)]
    model = nn.fit(toxic, other + toxic, 0.4)
    assert np.isfinite(model.weights).all() and np.abs(model.weights).max() < 100


@pytest.mark.parametrize("prior,climbs", [(0.1, False), (0.95, True)])
def test_risk_and_gradient_equal_brute_force(prior, climbs):
    """The sparse closed form against a dense risk written out, and against its finite differences."""
    rng = np.random.default_rng(4)
    grams = np.array([3, 5, 8, 13, 21])
    draw = lambda n, of: [np.unique(rng.choice(of, 4)).astype(np.int32) for _ in range(n)]
    positive, unlabelled = draw(20, [3, 5, 8, 99]), draw(60, [3, 13, 21, 77, 78])
    dense = lambda texts: np.array([[float(g in t) for g in grams] for t in texts])
    theta = rng.normal(size=6) + np.array([1.0, 1, 1, -2, -2, 0])

    def parts(at):
        fp, fu = dense(positive) @ at[:-1] + at[-1], dense(unlabelled) @ at[:-1] + at[-1]
        as_positive = prior * np.mean([np.log(1 + np.exp(-f)) for f in fp])
        return as_positive, np.mean([np.log(1 + np.exp(f)) for f in fu]) - prior * np.mean([np.log(1 + np.exp(f)) for f in fp])

    p, u = nn._Rows(positive, grams), nn._Rows(unlabelled, grams)
    got_positive, got_negative, gradient = nn.risk(theta, p, u, prior)
    assert np.allclose((got_positive, got_negative), parts(theta)) and (got_negative < 0) == climbs

    def goal(at):
        a, b = parts(at)
        return (-b if climbs else a + b) + nn.L2 / 2 * (at[:-1] ** 2).sum()

    steps = np.eye(6) * 1e-6
    assert np.allclose(gradient, [(goal(theta + e) - goal(theta - e)) / 2e-6 for e in steps], atol=1e-6)


def test_odd_rows(spark):
    rows, labels = corpus(400)
    rows = [(i + 1000, t, lang, s) for i, t, lang, s in rows]
    labels = [(i + 1000, q, t) for i, q, t in labels] + [(None, 1, 1), (1001, 1, None), (4, 1, 0), (4, 1, 0), (999_999, 1, 1)]
    out = nn.score(frame(spark, [*ODD_ROWS, *rows], extra=True), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(ODD_ROWS) + len(rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    none = nn.score(frame(spark, ODD_ROWS), spark.createDataFrame([], LABELS)).collect()
    assert [r["score"] for r in none] == [0.0] * len(ODD_ROWS)
    assert nn.score(frame(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_grams_stay_inside_words():
    a, b = nn.gram_ids("abc def"), nn.gram_ids("def abc")
    assert a.tolist() == b.tolist() and nn.gram_ids("").tolist() == nn.gram_ids("12 --").tolist()
