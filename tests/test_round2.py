"""Model calls made once, hot and repeated rows, NULLs that stay, files that grow with the data."""

import os
import random
import uuid

from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from plan_utils import plan_text
from prefspark.functions.templates import DOMAINS
from prefspark.operators import batch, evaluation, metrics, preferences, ranking
from prefspark.plans import catalog, catalog_jobs
from prefspark.plans import fixtures as fx
from prefspark.plans.broadcast import small_side
from prefspark.sinks import writers
from prefspark.sources import csv as csv_src
from prefspark.streaming.ingest import ingest_preferences_stream


def sampling_backend(folder):
    """Every call leaves a mark in ``folder`` and answers at random: good, broken or incomplete JSON."""
    def factory(model):
        def fn(texts):
            out = []
            for _ in texts:
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
                out.append(random.choice(['{"row":[{"prompt":"p","response_1":"a","response_2":"b"}]}',
                                          '{"row":[{"prompt":"p"', '{"row":[{"prompt":"p"}]}', '{"row":[]}']))
            return out
        return fn
    return factory


def test_each_generator_call_is_made_once(spark, tmp_path):
    folder = str(tmp_path)
    constitutions = spark.createDataFrame([(1, "be kind"), (2, "be fair")], "constitution_id long, text string")
    rows, rejects = batch.generate_from_constitutions(constitutions, sampling_backend(folder), runs=7)
    keys = ["constitution_id", "context_id", "run_id"]
    good = {tuple(r) for r in rows.select(*keys).distinct().collect()}
    bad = {tuple(r) for r in rejects.select(*keys).collect()}
    assert len(good | bad) == 2 * len(DOMAINS) * 7 and not good & bad
    assert len(os.listdir(folder)) == 2 * len(DOMAINS) * 7


def test_each_policy_and_reward_call_is_made_once(spark, tmp_path):
    marks = {n: str(tmp_path / n) for n in ("policy", "reward")}
    for path in marks.values():
        os.mkdir(path)

    def marking(folder, answer):
        def factory(model):
            def fn(texts):
                for _ in texts:
                    with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                        f.write(str(model))
                return [answer(t) for t in texts]
            return fn
        return factory

    prompts = spark.createDataFrame([(f"d{i % 2}", i, f"prompt {i}") for i in range(60)], "dataset string, row_id long, prompt string")
    grid = spark.createDataFrame([("m1", "d0", "r0"), ("m1", "d1", "r1"), ("m2", "d1", None)],
                                 "model string, dataset string, reward_model string")
    outputs = batch.generate_outputs(prompts, grid, marking(marks["policy"], lambda t: t + " out"))
    scores = batch.score_outputs(outputs, marking(marks["reward"], lambda t: float(len(t))))
    evaluation.normalize_rewards(scores).count()
    assert outputs.count() == 90 and scores.count() == 90
    assert len(os.listdir(marks["policy"])) == 90
    asked = [open(os.path.join(marks["reward"], n)).read() for n in os.listdir(marks["reward"])]
    assert sorted(asked) == ["r0"] * 30 + ["r1"] * 30  # each dataset's own model; no call without one
    assert scores.where("reward IS NULL").select("model").distinct().collect()[0][0] == "m2"


def test_judge_keeps_rows_it_cannot_judge(spark):
    rows = [(1, 1, "p", "a", "b"), (2, 1, "p", None, "b"), (3, 99, "p", "a", "b"), (4, None, "p", "a", "b")]
    df = spark.createDataFrame(rows, "i int, constitution_id int, prompt string, response_1 string, response_2 string")
    out = batch.judge_preferences(df, spark.createDataFrame([(1, "be kind")], "constitution_id int, text string"))
    got = {r["i"]: r["generated_text"] for r in out.collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] is not None and got[2] is None and got[3] is None and got[4] is None


def test_model_work_uses_all_cores(spark):
    prompts = spark.createDataFrame([("d", i, f"p{i}") for i in range(400)], "dataset string, row_id long, prompt string")
    grid = spark.createDataFrame([("m1", "d"), ("m2", "d")], "model string, dataset string")
    out = batch.generate_outputs(prompts, grid)
    assert out.select(F.spark_partition_id()).count() == 800
    files = {r[0] for r in out.select("_metadata.file_path").distinct().collect()}
    assert len(files) >= min(4, spark.sparkContext.defaultParallelism)


def test_flip_with_repeated_keys_and_rows(spark):
    rows = [("same", "a", "b")] * 40 + [("same", "c", "d")] * 7 + [(f"k{i}", "a", "b") for i in range(13)]
    df = spark.createDataFrame(rows, "prompt string, chosen string, rejected string").repartition(3)
    for ratio in (0.0, 0.2, 0.5, 0.61, 1.0):
        out = ranking.flip_preferences(df, ratio, ["prompt"], seed=1).collect()
        assert len(out) == 60 and sum(r["flipped"] for r in out) == int(ratio * 60)
        back = sorted((r["prompt"], *((r["rejected"], r["chosen"]) if r["flipped"] else (r["chosen"], r["rejected"]))) for r in out)
        assert back == sorted(rows)


def test_flip_does_not_depend_on_leaf_size(spark):
    df = spark.createDataFrame([(i, "a", "b") for i in range(500)], "i long, chosen string, rejected string")
    hashed = df.withColumn("_h", F.concat(F.md5(F.col("i").cast("string")), F.md5(F.lit("x"))))
    order = sorted(r["_h"] for r in hashed.collect())
    for leaf in (1, 50, 1000):
        for k in (1, 250, 500):
            assert ranking._kth_smallest(hashed, k, digits=1, leaf_rows=leaf) == (order[k - 1], k - 1, 1)


def test_large_tail_equals_small_tail(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    small = {r["k"]: r["split"] for r in ranking.tail_split(df, ["k"], 300).collect()}
    monkeypatch.setattr(ranking, "TOP_ROWS", 10)
    assert {r["k"]: r["split"] for r in ranking.tail_split(df, ["k"], 300).collect()} == small


def test_null_groups_and_missing_rewards(spark):
    scores = spark.createDataFrame([(None, "d", 1, 0.0), (None, "d", 2, 2.0), ("m", None, 3, 1.0), ("m", None, 4, 3.0)],
                                   "model string, dataset string, row_id long, reward double")
    assert sorted(r["norm_reward"] for r in evaluation.normalize_rewards(scores).collect()) == [0.0, 0.0, 1.0, 1.0]
    results = spark.createDataFrame([("m", 1, 1.0), ("m", 2, None), ("m", 3, 3.0)], "model string, task int, reward double")
    got = [(r["cumulative_count"], r["cumulative_sum"], r["continual_average_reward"])
           for r in evaluation.continual_average(results).orderBy("task").collect()]
    assert got[:2] == [(1, 1.0, 1.0), (2, None, None)] and got[2][:2] == (3, 4.0)


def test_incomplete_data_points_are_rejected(spark):
    raw = ['{"row":[{"prompt":"a","response_1":"b","response_2":"c"}]}', '{"row":[{"prompt":"a"}]}',
           '{"row":[{"prompt":1,"response_1":"b","response_2":"c"}]}', '{"row":[]}', "nope", None]
    rows, rejects = preferences.explode_generated(spark.createDataFrame(list(enumerate(raw)), "i int, raw string"), keep=["i"])
    assert [r["i"] for r in rows.collect()] == [0] and sorted(r["i"] for r in rejects.collect()) == [1, 2, 3, 4, 5]


def test_stream_rejects_what_the_batch_reader_rejects(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "good.csv").write_text('prompt,response_1,response_2\n"p","a","b"\n"q",,"d"\n')
    (drop / "bad.csv").write_text('prompt,response_1,response_2\n"x","a","b"\n"y","a","b","surplus"\n')
    ingest_preferences_stream(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = {r["prompt"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    good, _ = csv_src.read_preferences_tolerant(spark, str(drop))
    assert got == {"p", "q"} == {r["prompt"] for r in good.collect()}


def test_nul_cells_survive_csv(spark, tmp_path):
    rows = [("\x00", "a", None), ("b", "", "\x00c")]
    df = spark.createDataFrame(rows, "prompt string, response_1 string, response_2 string")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert {tuple(r) for r in csv_src.read_preferences(spark, str(tmp_path / "csv")).collect()} == set(rows)


def test_files_grow_and_tolerant_scan_keeps_its_share(spark):
    files, share = [], []
    for sf in (SF_SMALL, SF_CHECK):
        pairs = fx.pairs(spark, sf)
        files.append(pairs.select(catalog_jobs._file_key()).distinct().count())
        share.append(catalog_jobs.q_csv_tolerant(spark, sf).count() / pairs.count())
    assert files[1] > files[0] and min(share) > 0.5


def test_filters_reach_the_scan_and_the_aggregate(spark):
    assert "EqualTo(lang,de)" in plan_text(catalog.q_lang_equality_scan(spark, SF_SMALL))
    small = small_side(spark.range(10).select("id", F.lit("text").alias("t")))
    assert "SinglePartition" not in plan_text(spark.range(10).join(small, "id"))


def test_cost_totals(spark):
    df = spark.createDataFrame([("one two three", "four five six")], "a string, b string")
    r = metrics.cost_report(df, ["a"], ["b"], in_price=1.0, out_price=2.0, output_factor=3, runs=5).first()
    assert (r["weighted_tokens"], r["run_tokens"], round(r["run_cost"] * 1e6, 6)) == (16.0, 40.0, 60.0)


def test_sorted_queries_come_in_order(spark):
    single = [r["model"] for r in catalog.q_sort_single(spark, SF_SMALL).collect()]
    assert single == sorted(single)
    multi = [(r["model"], r["eval_task"]) for r in catalog.q_sort_multi(spark, SF_SMALL).collect()]
    assert multi == sorted(multi)
