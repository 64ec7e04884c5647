import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.llm import mcd_quality
from llm_fixtures import ODD_ROWS, frame, written


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    inside = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside),
            n < 50 or 100 * len(inside) > 50 * n)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(n))


@pytest.mark.parametrize("text", [None, "", "a", "a b", "a b c", "a b c a b c", "x\nx\n\nx", "|a| #b $ <c>", "a a a a a",
                                  "a b c d a b c e b c d", " \t\x0b\x0c\r a\x0bb"])
def test_base_columns(text):
    assert mcd_quality.statistics(text or "")[:6] == brute(text)


def corpus(n=1200):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        text = prose(rng, int(rng.integers(60, 200)))
        if k % 40 == 7:
            text = " ".join(w + "%%%" for w in text.split())
        if k % 40 == 8:
            text = text.upper()
        rows.append((k, text, "en" if k % 5 else None, "hot" if k % 3 else f"s{k % 4}"))
    return rows


def test_junk_goes_and_clean_stays(spark):
    out = {r["doc_id"]: r for r in mcd_quality.judge(frame(spark, corpus())).collect()}
    junk = {k for k in out if k % 40 in (7, 8)}
    assert {k for k, r in out.items() if not r["kept"]} == junk


def wide_as(scatter, least):
    """The smallest change of ``scatter`` by which no direction is narrower than in ``least``."""
    root = np.linalg.cholesky(least)
    values, axes = np.linalg.eigh(np.linalg.solve(root, np.linalg.solve(root, scatter).T))
    axes = root @ axes
    return axes @ np.diag(np.maximum(values, 1)) @ axes.T


def brute_mcd(x, noise):
    """(log determinant, mean, scatter) with exact medians and cuts, from both starts to the end."""
    floor = np.diag(noise.mean(0) + mcd_quality.LEAST)
    middle = np.median(x, 0)
    deviation = 1.4826 * np.median(np.abs(x - middle), 0)
    results = []
    for mean, scatter in ((middle, np.diag(deviation ** 2) + floor), (x.mean(0), wide_as(np.cov(x.T, bias=True), floor))):
        for _ in range(50):
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
            kept = np.argsort(d2)[:int(np.ceil(mcd_quality.KEEP * len(x)))]
            mean = x[kept].mean(0)
            floor = np.diag(noise[kept].mean(0) + mcd_quality.LEAST)
            scatter = wide_as(np.cov(x[kept].T, bias=True) * mcd_quality.CONSISTENCY, floor)
            results.append((np.linalg.slogdet(scatter)[1], mean, scatter))
    return min(results, key=lambda r: r[0])


def made(n=900, outliers=100):
    rng = np.random.default_rng(1)
    p = len(mcd_quality.VECTOR)
    x = np.abs(np.concatenate([rng.normal(2, 0.3, (n, p)), rng.normal(6, 0.1, (outliers, p))]))
    return x, np.full((n + outliers, p), 0.01)


def stat_rows(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, vector array<double>, noise array<double>")


def test_estimate_equals_brute_force(spark):
    """The distributed steps against numpy; one group, so that its own scatter is the pooled one."""
    x, noise = made()
    p = x.shape[1]
    stats = stat_rows(spark, [("en", "s", v.tolist(), e.tolist()) for v, e in zip(x, noise)])
    model = {r["grp"][0]: r for r in mcd_quality.fit(stats).collect()}["2"]
    logdet, mean, scatter = brute_mcd(x, noise)
    assert model["logdet"] == pytest.approx(logdet, abs=0.1)
    assert np.allclose(model["mean"], mean, atol=0.03)
    assert np.allclose(np.array(model["scatter"]).reshape(p, p), scatter, atol=0.01)
    mine = np.einsum("ij,jk,ik->i", x - model["mean"], np.array(model["precision"]).reshape(p, p), x - model["mean"])
    assert 4.3 < np.median(mine[:900]) < 6.3  # chi-square of six: 5.35; the estimate rules
    assert (mine[900:] > mcd_quality.CUTOFF).all() and (mine[:900] <= mcd_quality.CUTOFF).all()


def test_copies_are_no_bulk(spark):
    """However often one row occurs, the estimate is that of the different rows."""
    x, noise = made()
    once = [("en", "s", v.tolist(), e.tolist()) for v, e in zip(x, noise)]
    key = lambda fitted: {r["grp"]: (r["n"], np.round(r["mean"], 9).tolist()) for r in fitted.collect()}
    assert key(mcd_quality.fit(stat_rows(spark, once))) == key(mcd_quality.fit(stat_rows(spark, once + [once[-1]] * 3000)))


def test_no_group_narrower_than_its_level(spark):
    """A source of nearly equal texts has the pooled scatter's width, so its slightly different texts stay."""
    x, noise = made(900, 0)
    rng = np.random.default_rng(2)
    narrow = np.abs(rng.normal(2, 0.001, (300, x.shape[1])))
    rows = [("en", "s", v.tolist(), [1e-6] * 6) for v in x] + [("en", "narrow", v.tolist(), [1e-6] * 6) for v in narrow]
    model = {r["grp"]: np.array(r["scatter"]).reshape(6, 6) for r in mcd_quality.fit(stat_rows(spark, rows)).collect()
             if r["grp"][0] == "0"}
    assert len(model) == 2
    own = next(m for g, m in model.items() if g.endswith("narrow"))
    assert (np.diag(own) > 0.5 * 0.3 ** 2).all()


def test_a_distance_equal_to_the_cutoff_stays(spark, monkeypatch):
    eye = np.eye(6)
    model = spark.createDataFrame([("2", 0, 300, [0.0] * 6, [1.0] * 6, eye.ravel().tolist(), eye.ravel().tolist(), 0.0)],
                                  mcd_quality.MODEL)
    monkeypatch.setattr(mcd_quality, "CUTOFF", 4.0)
    stats = spark.createDataFrame([("a", False, [2.0] + [0.0] * 5, [0.0] * 6), ("b", False, [2.1] + [0.0] * 5, [0.0] * 6),
                                   ("c", False, [4.0] + [0.0] * 5, [4.0] * 6)],
                                  "d string, base_failed boolean, vector array<double>, noise array<double>")
    out = {r["d"]: (r["distance"], r["kept"]) for r in
           mcd_quality.judged(stats, model, F.lit("en"), F.lit("s")).collect()}
    assert out["a"] == (4.0, True) and not out["b"][1]
    assert out["c"] == (pytest.approx(4.0), True)  # 16 / (1 + (4 - 1) / 1): its own counting variance is above its group's


def test_odd_rows(spark, tmp_path):
    rows = [*ODD_ROWS, *[(i + 1000, t, lang, s) for i, t, lang, s in corpus(60)]]
    out = mcd_quality.judge(frame(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], r)
    for doc_id, text, _, _ in ODD_ROWS[:6]:
        r = by_id[doc_id]
        assert tuple(r[c] for c in mcd_quality.OUT) == brute(text) and not r["kept"]
    assert mcd_quality.judge(frame(spark, [])).count() == 0
    docs = written(spark, tmp_path, frame(spark, rows, extra=True))
    kept = mcd_quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out if r["kept"])


def test_chi_square_function():
    assert mcd_quality.chi2_cdf(12.5916, 6) == pytest.approx(0.95, abs=1e-4)
    assert mcd_quality.chi2_quantile(0.05, 6) == pytest.approx(12.5916, abs=1e-3)
    assert mcd_quality.chi2_tail(mcd_quality.CUTOFF, 6) == pytest.approx(mcd_quality.TAIL)
