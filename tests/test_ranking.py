"""Order-dependent operators: exactness, partition invariance, skew, edges and plan shape."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.operators import ranking
from plan_utils import assert_no_raw_rows_in_one_partition, plan_text


def _pairs(spark, n, parts=4, hot_share=0.0):
    """n preference rows; with hot_share, that share of rows has the same leading key."""
    rows = []
    hot = int(n * hot_share)
    for i in range(n):
        k = 0 if i < hot else i
        rows.append((k, i, f"p{i}", f"c{i}", f"r{i}"))
    df = spark.createDataFrame(rows, "k long, i long, prompt string, chosen string, rejected string")
    return df.repartition(parts) if parts else df


@pytest.mark.parametrize("n", [0, 1, 9, 100, 257])
def test_exact_flip_count(spark, n):
    df = _pairs(spark, n)
    out = ranking.flip_preferences(df, 0.6, ["k", "i"], seed=42)
    assert out.where("flipped").count() == math.floor(0.6 * n)
    assert out.count() == n


def test_flip_is_involution_and_partition_invariant(spark):
    base = _pairs(spark, 300)
    once = ranking.flip_preferences(base, 0.6, ["k", "i"], seed=7).drop("flipped")
    twice = ranking.flip_preferences(once, 0.6, ["k", "i"], seed=7).drop("flipped")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, base.collect()))
    flags = [sorted(r["i"] for r in ranking.flip_preferences(base.repartition(p), 0.6, ["k", "i"], seed=7)
                    .where("flipped").select("i").collect()) for p in (1, 4, 13)]
    assert flags[0] == flags[1] == flags[2]


def test_flip_matches_global_hash_rank(spark):
    base = _pairs(spark, 200)
    out = ranking.flip_preferences(base, 0.3, ["k", "i"], seed=3).select("k", "i", "flipped").collect()
    import hashlib
    ranked = sorted(out, key=lambda r: (hashlib.md5(f"3:{r['k']}:{r['i']}".encode()).hexdigest(), r["k"], r["i"]))
    k = math.floor(0.3 * 200)
    assert [r["flipped"] for r in ranked] == [True] * k + [False] * (200 - k)


def test_radix_selection_descends_levels(spark):
    """With a tiny leaf size the selection has to narrow the prefix over several levels."""
    base = _pairs(spark, 500).withColumn("_h", F.concat(F.md5(F.concat_ws(":", "k", "i")), F.md5("prompt")))
    order = sorted(r["_h"] for r in base.collect())
    for k in (1, 137, 500):
        assert ranking._kth_smallest(base, k, digits=1, leaf_rows=3) == (order[k - 1], k - 1, 1)


def test_approx_flip_share(spark):
    out = ranking.flip_preferences(_pairs(spark, 2000), 0.6, ["k", "i"], exact=False)
    share = out.where("flipped").count() / 2000
    assert 0.55 < share < 0.65


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_row_index_with_hot_key(spark, parts):
    df = _pairs(spark, 600, parts=parts, hot_share=1 / 3)
    out = ranking.with_row_index(df, ["k", "i"]).select("k", "i", "row_idx").collect()
    expect = {(k, i): idx for idx, (k, i) in enumerate(sorted((r["k"], r["i"]) for r in out))}
    assert all(expect[(r["k"], r["i"])] == r["row_idx"] for r in out)


def test_row_index_requires_keys(spark):
    with pytest.raises(ValueError):
        ranking.with_row_index(_pairs(spark, 3), [])


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9])
def test_batches(spark, n):
    out = ranking.assign_batches(_pairs(spark, n), ["k", "i"], 8).collect()
    assert sorted(r["batch_id"] for r in out) == [i // 8 for i in range(n)]
    assert all(r["n_batches"] == (n + 7) // 8 for r in out)


@pytest.mark.parametrize("n,k", [(10, 4), (3, 4), (100, 7), (1, 1)])
def test_chunks_equal_array_split(spark, n, k):
    out = ranking.split_chunks(_pairs(spark, n), ["k", "i"], k).select("i", "chunk").collect()
    sizes = [sum(1 for r in out if r["chunk"] == c + 1) for c in range(k)]
    assert sizes == [len(a) for a in np.array_split(np.arange(n), k)]


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101])
def test_tail_split(spark, n):
    out = ranking.tail_split(_pairs(spark, n), ["k", "i"], 100).collect()
    evals = sorted(r["i"] for r in out if r["split"] == "eval")
    assert evals == list(range(max(0, n - 100), n))


def test_no_single_partition_exchange_on_data(spark):
    df = _pairs(spark, 50, parts=None)
    flipped = ranking.flip_preferences(df, 0.6, ["k", "i"])
    assert "Exchange" not in plan_text(flipped)  # the exact flip is a narrow projection
    for d in (ranking.with_row_index(df, ["k", "i"]), ranking.tail_split(df, ["k", "i"], 10),
              ranking.assign_batches(df, ["k", "i"], 8), ranking.split_chunks(df, ["k", "i"], 3)):
        assert_no_raw_rows_in_one_partition(d)


def test_row_index_with_copies_of_one_key(spark):
    """A third of the rows are exact copies: still a dense, complete 0..n-1 index."""
    rows = [(0, 0, "same", "c", "r")] * 200 + [(i, i, f"p{i}", "c", "r") for i in range(1, 401)]
    df = spark.createDataFrame(rows, "k long, i long, prompt string, chosen string, rejected string").repartition(7)
    out = ranking.with_row_index(df, ["k", "i"]).collect()
    assert sorted(r["row_idx"] for r in out) == list(range(600))
    assert sorted(r["row_idx"] for r in out if r["k"] == 0) == list(range(200))


def test_flip_among_copies_counts_them(spark):
    rows = [(1, 1, "p", "c", "r")] * 50
    df = spark.createDataFrame(rows, "k long, i long, prompt string, chosen string, rejected string")
    out = ranking.flip_preferences(df, 0.5, ["k", "i"]).collect()
    assert len(out) == 50 and sorted((r["chosen"], r["flipped"]) for r in out) == [("c", False)] * 25 + [("r", True)] * 25


COPIES = [(1, 1, "p", "c", "r")] * 30 + [(i, i, f"p{i}", "c", "r") for i in range(2, 10)] + [(5, 5, f"q{j}", "c", None) for j in range(20)]


@pytest.mark.parametrize("n", [1, 3, 4, 7, 24, 25, 29, 40, 57, 58, 90])
def test_tail_split_among_equal_keys_is_one_result(spark, monkeypatch, n):
    """Ties go by the row, copies by number; a bounded top-n and the way by position agree."""
    df = spark.createDataFrame(COPIES, "k long, i long, prompt string, chosen string, rejected string").repartition(5)
    results = []
    for top_rows in (10_000, 0):
        monkeypatch.setattr(ranking, "TOP_ROWS", top_rows)
        out = ranking.tail_split(df, ["k"], n).collect()
        assert sorted(map(str, (r[:5] for r in out))) == sorted(map(str, COPIES))
        results.append(sorted(str(r) for r in out))
        assert sum(r["split"] == "eval" for r in out) == min(n, len(COPIES))
    assert results[0] == results[1]


def _spread(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("maps", [False, True])
def test_row_index_of_runs(spark, monkeypatch, maps):
    """A third of the rows are copies of one row, others occur 60 times: equal to ``row_number`` on the
    distinct rows, copies in a row, and no task with more than its share."""
    monkeypatch.setattr(ranking, "RUN_ROWS", 50)
    rows = ([(7, 3, "hot", "c", "r")] * 1000 + [(k, 1, "warm", "c", "r") for k in (2, 7, 900) for _ in range(60)]
            + [(i % 40, i, f"p{i}", "c", "r") for i in range(1900)] + [(None, None, None, None, None)] * 51)
    df = spark.createDataFrame(rows, "k long, i long, prompt string, chosen string, rejected string").repartition(8)
    if maps:
        df = df.withColumn("m", F.create_map(F.lit("a"), "i"))
        spark.conf.set("spark.sql.legacy.allowHashOnMapType", "true")
    try:
        indexed, total = ranking.indexed_with_total(df, ["k", "i"])
        out = indexed.collect()
        spread = _spread(indexed.where("prompt = 'hot'"))
    finally:
        spark.conf.unset("spark.sql.legacy.allowHashOnMapType")
    assert sorted(r["row_idx"] for r in out) == list(range(len(rows))) and total.first()[0] == len(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or 0)
    assert [key(r) for r in sorted(out, key=lambda r: r["row_idx"])] == sorted(map(key, rows))
    places = sorted(r["row_idx"] for r in out if r["prompt"] == "hot")
    assert places == list(range(places[0], places[0] + 1000))
    assert spread < 0.45  # 20 stretches of 50 copies, dealt by hash over 8 tasks


def test_row_index_without_runs_has_no_further_join(spark):
    text = plan_text(ranking.with_row_index(_pairs(spark, 50), ["k", "i"]))
    assert text.count("Join") == 1 and "Generate" not in text


@pytest.mark.parametrize("n", [10, 1000, 1024])
def test_batches_chunks_and_tail_over_runs(spark, monkeypatch, n):
    monkeypatch.setattr(ranking, "RUN_ROWS", 50)
    df = spark.createDataFrame([(1, "same")] * 700 + [(k, f"p{k}") for k in range(324)], "k long, prompt string")
    batches = ranking.assign_batches(df, ["k"], 8).groupBy("batch_id").count().collect()
    assert len(batches) == 128 and {r["count"] for r in batches} == {8}
    chunks = ranking.split_chunks(df, ["k"], 3).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in chunks] == [342, 341, 341]
    assert ranking.tail_split(df, ["k"], n).where("split = 'eval'").count() == n


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_tail_and_chunks_partition_invariant(spark, parts):
    df = _pairs(spark, 120, parts=parts)
    tail = sorted(r["i"] for r in ranking.tail_split(df, ["k", "i"], 30).where("split = 'eval'").collect())
    assert tail == list(range(90, 120))
    chunks = {r["i"]: r["chunk"] for r in ranking.split_chunks(df, ["k", "i"], 7).collect()}
    sizes = [len(a) for a in np.array_split(np.arange(120), 7)]
    bounds = np.cumsum([0] + sizes)
    assert all(chunks[i] == int(np.searchsorted(bounds, i, side="right")) for i in range(120))


@pytest.mark.parametrize("exact", [True, False])
def test_scoped_flip(spark, exact):
    df = _pairs(spark, 300).withColumn("c2", F.col("i") % 3 == 0)
    out = ranking.flip_preferences(df, 0.6, ["k", "i"], exact=exact, where=F.col("c2")).collect()
    assert not any(r["flipped"] for r in out if not r["c2"])
    assert all(r["flipped"] is not None for r in out)
    if exact:
        assert sum(r["flipped"] for r in out) == math.floor(0.6 * 100)


@pytest.mark.parametrize("ratio", [0.0, 1.0])
def test_flip_ratio_edges(spark, ratio):
    out = ranking.flip_preferences(_pairs(spark, 37), ratio, ["k", "i"])
    assert out.where("flipped").count() == math.floor(ratio * 37)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_batches_and_zip_partition_invariant(spark, parts):
    from prefspark.operators.evaluation import zip_join
    df = _pairs(spark, 90, parts=parts)
    batches = {r["i"]: r["batch_id"] for r in ranking.assign_batches(df, ["k", "i"], 8).collect()}
    assert batches == {i: i // 8 for i in range(90)}
    right = spark.createDataFrame([(1000 - j, f"g{j}") for j in range(50)], "b long, g string").repartition(parts)
    pairs = sorted((r["row_idx"], r["i"], r["b"]) for r in zip_join(df, right, ["k", "i"], ["b"]).collect())
    assert pairs == [(x, x, 951 + x) for x in range(50)]


def test_tail_split_zero(spark):
    out = ranking.tail_split(_pairs(spark, 10), ["k", "i"], 0)
    assert out.where("split = 'eval'").count() == 0 and out.count() == 10
