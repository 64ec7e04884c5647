import numpy as np
from pyspark.sql import functions as F

from prefspark.llm import srs_ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.asarray(v, float) - np.asarray(w, float)) ** 2).sum())), i)
                      for i, w in rows if i != q and len(w) == len(v))
        out[q] = near[:k]
    return out


def vectors(n=1500, dim=16):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, dim))
    x = (centres[rng.integers(0, 30, n)] + 0.2 * rng.normal(size=(n, dim))).astype(np.float32)
    return [(k, [float(c) for c in v]) for k, v in enumerate(x)]


def test_recall_and_exact_scores(spark):
    rows = vectors()
    old = srs_ann.BLOCK_ROWS
    srs_ann.BLOCK_ROWS = 200  # several blocks
    try:
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
        got = {}
        for r in srs_ann.nearest(df, F.col("vec_id") % 20 == 0, 10).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    finally:
        srs_ann.BLOCK_ROWS = old
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert got.keys() == expected.keys()
    by_id, hits = dict(rows), 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in [i for _, i, _ in found]
        assert [s for _, _, s in found] == sorted(s for _, _, s in found)
        for _, i, s in found:
            assert s == np.sqrt(((np.array(by_id[q]) - np.array(by_id[i])) ** 2).sum())
        hits += len({i for _, i, _ in found} & {i for _, i in expected[q]})
    assert hits >= 0.9 * 10 * len(got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [nan, 1.0], 0),
            (5, [inf, 1.0], 0), (6, [], 0), (None, [1.0, 1.0], 0), (7, [1.0, 2.0], 0), (8, [1.0, 2.0], 0),
            (9, [1.0, 2.5], 0), (9, [1.0, 2.5], 0), (20, [5.0], 0), (10, [3.0, 2.0], 0)]
    rows += [(k, [1.0, 2.0], 0) for k in range(100, 140)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x")).withColumn("ids", F.lit(1))
    got = {}
    for r in srs_ann.nearest(df, F.col("vec_id") % 10 == 0, 3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[0] == [(7, 0.0), (8, 0.0), (100, 0.0)]
    assert got[100] == [(0, 0.0), (7, 0.0), (8, 0.0)]
    assert 20 not in got and 2 not in got  # no other vector of its length; zero vector
    few = srs_ann.nearest(spark.createDataFrame(rows[:1] + [(1, [1.0, 3.0], 0)], SCHEMA), F.col("vec_id") == 0, 10)
    assert [(r["vec_id"], r["rank"]) for r in few.collect()] == [(1, 1)]
    assert srs_ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0, 10).count() == 0


def test_index_rows_are_copied_per_asked_chunk_only(spark, monkeypatch):
    """Many queries and blocks: a block is read once for each chunk of its own queries."""
    monkeypatch.setattr(srs_ann, "QUERY_CHUNK", 10)
    index = spark.range(1000).selectExpr("cast(id % 10 as int) as block", "id as vec_id")
    asked = {0: 95, 3: 10, 7: 1}
    queries = spark.createDataFrame([(1000 * b + i, b) for b, n in asked.items() for i in range(n)],
                                    "query_id long, block int")
    rows, dealt = srs_ann._chunked(index, queries)
    copies = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert copies == {0: 10 * 100, 3: 100, 7: 100}
    assert {r["block"]: r["n"] for r in dealt.groupBy("block").agg(F.count("*").alias("n")).collect()} == asked
    met = dealt.join(rows, ["block", "chunk"]).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("d"))
    assert {(r["n"], r["d"]) for r in met.collect()} == {(100, 100)}  # each query meets its block's rows once


def test_result_does_not_depend_on_chunks_or_clashing_columns(spark, monkeypatch):
    rows = vectors(600)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    key = lambda d: sorted(map(tuple, srs_ann.nearest(d, F.col("vec_id") % 5 == 0, 4).collect()))
    monkeypatch.setattr(srs_ann, "BLOCK_ROWS", 100)
    plain = key(df)
    monkeypatch.setattr(srs_ann, "QUERY_CHUNK", 7)
    clashing = df
    for name in ("ids", "dim", "point", "block", "chunk", "chunks", "bound", "query_id", "score", "rank", "copy", "n"):
        clashing = clashing.withColumn(name, F.lit("x"))
    assert key(clashing) == plain


def test_projection_in_batches():
    import pandas as pd

    vectors_ = [[1.0, 2.0], [3.0, 4.0, 5.0], [0.5, -1.0]]
    out = next(srs_ann._indexed([pd.DataFrame({"embedding": vectors_})]))
    assert out["dim"].tolist() == [2, 3, 2]
    for v, p in zip(vectors_, out["point"], strict=True):
        assert np.allclose(p, np.array(v) @ srs_ann.projection(len(v)))


def test_projection_ratio_follows_chi_square():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 40))
    ratio = ((x @ srs_ann.projection(40)) ** 2).sum(1) / (x ** 2).sum(1)
    for q in (5.0, 8.0, 15.0):
        assert abs((ratio <= q).mean() - srs_ann.chi2_cdf(q)) < 0.05
    assert abs(srs_ann.chi2_cdf(srs_ann.STOP_RATIO) - srs_ann.STOP) < 1e-6


def test_tree_yields_leaves_in_order():
    points = np.random.default_rng(1).normal(size=(700, srs_ann.PROJECTIONS))
    gaps, seen = zip(*srs_ann.Tree(points).leaves(points[3]), strict=True)
    assert list(gaps) == sorted(gaps)
    assert sorted(np.concatenate(seen).tolist()) == list(range(700))
