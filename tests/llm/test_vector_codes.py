import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.llm import queries, vector_codes as V


def brute(rows, parts=4, entries=256, rounds=4):
    """(id, label, vector) rows -> [(id, code, error)], codebooks; all distances, Python integers."""
    kept = [(i, lab, [math.floor(1024 * float(c)) for c in v]) for i, lab, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    cut = V.cuts(len(kept[0][2]), parts)
    books = [[tuple(r[2][c]) for r in kept[:entries]] for c in cut]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    def assign():
        return [[nearest(books[p], r[2][c]) for p, c in enumerate(cut)] for r in kept]

    for _ in range(rounds):
        found = assign()
        for p, c in enumerate(cut):
            for k in range(len(books[p])):
                own = [r[2][c] for r, f in zip(kept, found) if f[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(col) // len(own) for col in zip(*own))
    out = [(r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(kept, assign())]
    return sorted(out, key=str), [np.array(b) for b in books]


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(partitions)


def clustered(n, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    x = (centres[rng.integers(0, 9, n)] + rng.normal(scale=0.2, size=(n, width))).astype(np.float32)
    return [(int(k) * 3, int(k) % 5 if k % 7 else None, [float(c) for c in x[k]]) for k in range(n)]


@pytest.mark.parametrize("width, entries", [(16, 20), (10, 7), (3, 256)])
def test_equals_a_full_search(spark, width, entries):
    rows = clustered(150, width)
    rows += rows[:40]  # repeated rows
    coded, books = V.learn(frame(spark, rows, 5), label_col="label", entries=entries)
    expected, expected_books = brute(rows, entries=entries)
    assert sorted(((r["id"], r["code"], r["error"]) for r in coded.collect()), key=str) == expected
    assert all((a == b).all() for a, b in zip(books, expected_books))


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(3000, 8)) * 900).astype(np.int64)
    history = [x[:128].copy()]
    groups = V.dealt(history[0].astype(float))
    state, scanned = None, []
    for number in range(7):
        coder = V.PartCoder(history, groups)
        codes, bounds, stamps, d2 = coder.first(x) if state is None else coder.again(x, *state)
        full = V.squared(x, history[-1])
        assert (codes == full.argmin(1)).all() and (d2 == full.min(1)).all()
        for g, members in enumerate(groups):  # each bound holds in the round of its stamp
            for t in np.unique(stamps[:, g]):
                r = np.flatnonzero(stamps[:, g] == t)
                others = V.squared(x[r], history[t][members]).astype(float)
                others[members[None, :] == codes[r][:, None]] = np.inf
                assert (np.sqrt(others.min(1)) >= bounds[r, g]).all()
        scanned.append(coder.scanned / full.size)
        state = codes, bounds, stamps
        history.append(np.array([x[codes == k].sum(0) // max((codes == k).sum(), 1) if (codes == k).any()
                                 else history[-1][k] for k in range(128)]))
    assert max(scanned[1:]) < 0.8 and scanned[-1] < scanned[1]


def test_net_moves_are_at_most_accumulated_drifts():
    rng = np.random.default_rng(5)
    history = [rng.integers(-900, 900, (32, 4)) for _ in range(5)]
    coder = V.PartCoder(history, V.dealt(history[0].astype(float), 32))
    steps = [np.sqrt(((b - a) ** 2).sum(1)) for a, b in zip(history, history[1:])]
    for t in range(5):
        drift = sum(steps[t:], np.zeros(32))
        own = np.array([drift[g].max() for g in coder.groups])
        assert (coder.moved[t] <= own * 1.001).all()


def test_ties_go_to_the_lower_index(spark):
    rows = [(k, 0, [1.0, 1.0, 1.0, 1.0]) for k in range(30)] + [(99, 0, [2.0, 0.0, 1.0, 1.0])]
    coded, _ = V.learn(frame(spark, rows), entries=8)
    out = sorted(((r["id"], r["code"], r["error"]) for r in coded.collect()), key=str)
    assert out == brute(rows, entries=8)[0]  # entry 0 follows its far row; 1 is the lowest of seven equal ones
    assert {c for i, c, _ in out if i < 30} == {"01010000"}


def test_odd_vectors(spark):
    rows = [*clustered(40, 8), (1, 1, None), (2, 1, []), (4, None, [float("nan")] * 8), (5, 2, [float("inf")] * 8),
            (7, 2, [None] + [1.0] * 7), (None, None, [0.5] * 8), (8, 3, [1.0] * 5), (10, 3, [1e5, -1e5] * 4),
            (10, 3, [1e5, -1e5] * 4), (11, 3, [0.0] * 8)]
    df = frame(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("id", "x", "code", "codes", "error", "of")])
    coded, _ = V.learn(df, label_col="label")
    assert sorted(((r["id"], r["code"], r["error"]) for r in coded.collect()), key=str) == brute(rows)[0]


def test_far_components_are_held(spark):
    rows = [(k, 0, [float(k)] * 8) for k in range(5)] + [(9, 0, [3e38, -3e38] * 4)]
    coded, books = V.learn(frame(spark, rows), entries=2, rounds=1)
    assert coded.count() == 6 and V.most(8) ** 2 * 4 * 8 < 1 << 63


def test_label_errors_and_empty_table(spark, tmp_path, monkeypatch):
    rows = clustered(60)
    coded, _ = V.learn(frame(spark, rows), label_col="label", entries=8)
    out = V.with_label_error(coded).collect()
    sums = {}
    for r in out:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert None in sums and all(r["label_error"] == sums[r["label"]] for r in out)
    frame(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.op11_vector_codes(spark, str(tmp_path)).count() == 0


def test_digest():
    books = [np.array([[1, -2], [3, 4]]), np.array([[5], [6]])]
    assert V.codebook_digest(books) == hashlib.sha256(b"1,-2,3,4,5,6").hexdigest()
