"""Model calls that outlive a broken job, the grid kept up to date, batches as the backend sees them, judged streams."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from prefspark.operators import batch, evaluation, grid_state, ledger
from prefspark.sinks import writers
from prefspark.sources.literal import tasks_df
from prefspark.streaming import judged as judged_module
from prefspark.streaming.judged import judge_stream, judged


def marking(folder, answer=lambda t: f"1 {len(t)}", poison=None, wait_for=0):
    """A backend that leaves a mark for every text it answers. It breaks at the text ``poison`` once ``wait_for`` marks
    are there and while ``folder``/healthy is not."""
    def factory(model):
        def fn(texts):
            if poison is not None and any(poison in t for t in texts) and not os.path.exists(os.path.join(folder, "healthy")):
                deadline = time.time() + 60
                while len(os.listdir(folder)) < wait_for and time.time() < deadline:
                    time.sleep(0.2)
                time.sleep(4)  # the other tasks end
                raise RuntimeError("the model is gone")
            for t in texts:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(f"{model}|{t}")
            return [answer(t) for t in texts]
        return fn
    return factory


def marks(folder):
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder) if n != "healthy")


def folder(tmp_path, name):
    os.makedirs(tmp_path / name, exist_ok=True)
    return str(tmp_path / name)


CONST = [(1, "be kind")]


def pairs(spark, n, copies=1):
    rows = [(i, 1, f"prompt <{i}>", "a", "b") for i in range(n) for _ in range(copies)]
    return spark.createDataFrame(rows, "i int, constitution_id int, prompt string, response_1 string, response_2 string")


def test_broken_job_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    """60 distinct prompts, three rows each; the model breaks at one prompt. Over both runs each prompt is sent once."""
    monkeypatch.setattr(ledger, "TASK_BATCHES", 1)
    calls, book = folder(tmp_path, "calls"), str(tmp_path / "ledger")
    df = pairs(spark, 60, copies=3).repartition(4)
    consts = spark.createDataFrame(CONST, "constitution_id int, text string")
    backend = marking(calls, poison="prompt <17>", wait_for=50)
    with pytest.raises(Exception, match="the model is gone"):
        batch.judge_preferences(df, consts, backend, batch_size=1, ledger=book)
    first = marks(calls)
    assert 40 <= len(first) < 60 and len(set(first)) == len(first)
    open(os.path.join(calls, "healthy"), "w").close()
    out = batch.judge_preferences(df, consts, backend, batch_size=1, ledger=book)
    assert out.count() == 180 and out.where("generated_text IS NULL").count() == 0
    assert len(marks(calls)) == 60 == len(set(marks(calls)))
    again = batch.judge_preferences(df, consts, backend, ledger=book)  # nothing is asked any more
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect())) and len(marks(calls)) == 60


def test_ledger_keeps_nulls_and_tells_models_apart(spark, tmp_path):
    calls = folder(tmp_path, "calls")
    prompts = spark.createDataFrame([("d", 1, "same"), ("d", 2, "same"), ("d", 3, None)], "dataset string, row_id long, prompt string")
    grid = spark.createDataFrame([("m1", "d"), ("m2", "d"), (None, "d")], "model string, dataset string")
    out = batch.generate_outputs(prompts, grid, marking(calls), ledger=str(tmp_path / "l")).collect()
    assert marks(calls) == ["m1|same", "m2|same"] and len(out) == 9
    assert sum(r["generated_text"] is not None for r in out) == 4


def test_sampled_generations_of_one_prompt_are_calls_of_their_own(spark, tmp_path):
    calls = folder(tmp_path, "calls")
    consts = spark.createDataFrame([(1, "be kind")], "constitution_id long, text string")
    answer = lambda t: '{"row":[{"prompt":"p","response_1":"a","response_2":"b"}]}'
    for _ in range(2):
        rows, _rejects = batch.generate_from_constitutions(consts, marking(calls, answer), runs=3, ledger=str(tmp_path / "l"))
    assert rows.count() == 30 == len(marks(calls))


def test_hot_prompt_is_one_request(spark, tmp_path):
    calls = folder(tmp_path, "calls")
    df = pairs(spark, 5).unionByName(pairs(spark, 1, copies=2000))
    out = batch.judge_preferences(df, spark.createDataFrame(CONST, "constitution_id int, text string"), marking(calls),
                                  ledger=str(tmp_path / "l"))
    assert out.count() == 2005 and len(marks(calls)) == 5


def config(n):
    return [{"idx": i, "name": f"T{i}", "dataset": f"d{i}", "test_split": "test", "models": [f"A{i}", f"B{i}"],
             "reward_model": f"r{i}"} for i in range(n)]


def prompts_of(spark, datasets, rows=range(6)):
    return spark.createDataFrame([(f"d{d}", r, f"d{d} prompt {r} " + "x" * (r * r % 7 + d)) for d in datasets for r in rows],
                                 "dataset string, row_id long, prompt string")


def full_matrix(spark, n, prompts):
    grid = evaluation.continual_grid(tasks_df(spark, config(n)))
    cells = grid.select("model", F.col("eval_dataset").alias("dataset"), "reward_model")
    scores = batch.score_outputs(batch.generate_outputs(prompts, cells))
    return evaluation.continual_matrix(grid, evaluation.avg_normalized_reward(scores))


def same_matrix(a, b):
    def rows(df):
        return sorted(((r["model"], r["eval_task"], None if r["avg_reward"] is None else round(r["avg_reward"], 9))
                       for r in df.collect()), key=str)
    assert rows(a) == rows(b)


def test_refresh_computes_new_cells_only(spark, tmp_path):
    calls, state = folder(tmp_path, "calls"), str(tmp_path / "state")
    policy = marking(calls, answer=lambda t: t + " answer")
    prompts = prompts_of(spark, range(3))
    run = lambda n, p: grid_state.refresh(tasks_df(spark, config(n)), p, state, policy)
    run(2, prompts)
    assert len(marks(calls)) == 6 * (2 + 4)  # two models on one dataset, two on two
    run(2, prompts)
    assert len(marks(calls)) == 36
    m = run(3, prompts)
    new = marks(calls)
    assert len(new) == 36 + 6 * 6 and {x.split("|")[0] for x in new if x.startswith(("A2", "B2"))} == {"A2", "B2"}
    grid = evaluation.continual_grid(tasks_df(spark, config(3)))
    cells = grid.select("model", F.col("eval_dataset").alias("dataset"), "reward_model")
    outputs = batch.generate_outputs(prompts, cells, marking(folder(tmp_path, "other"), answer=lambda t: t + " answer"))
    same_matrix(m, evaluation.continual_matrix(grid, evaluation.avg_normalized_reward(batch.score_outputs(outputs))))


def test_cells_without_prompts_stay_null_and_further_rows_join(spark, tmp_path):
    state = str(tmp_path / "state")
    some = prompts_of(spark, [0], range(4))
    m = grid_state.refresh(tasks_df(spark, config(2)), some, state)
    assert {r["eval_task"] for r in m.where("avg_reward IS NULL").collect()} == {"T1"}
    grid_state.add_prompts(tasks_df(spark, config(2)), prompts_of(spark, [0], range(4, 9)), state)
    m = grid_state.refresh(tasks_df(spark, config(2)), prompts_of(spark, [0, 1], range(9)), state)
    same_matrix(m, full_matrix(spark, 2, prompts_of(spark, [0, 1], range(9))))


@pytest.mark.parametrize("window", [1, 4])
def test_only_a_tasks_last_call_is_short(spark, tmp_path, window):
    """Arrow frames of 7 rows, batches of 5: every call of a task and model is full but its last."""
    calls = folder(tmp_path, "calls")

    def factory(model):
        def fn(texts):
            with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
                f.write(f"{os.getpid()}|{model}|{len(texts)}|{max(map(len, texts)) * len(texts) - sum(map(len, texts))}")
            return [f"{model}:{t}" for t in texts]
        return fn

    df = spark.range(0, 103, 1, 1).select("id", F.when(F.col("id") % 10 < 8, "a").otherwise("b").alias("model"),
                                          F.when(F.col("id") != 50, F.repeat(F.lit("x"), (F.col("id") * 37 % 50).cast("int"))).alias("t"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = batch.map_batches(df, "t", "o", "string", factory, 5, carry=["id", "t"], model_col="model", window=window).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["id"] for r in out) == list(range(103))
    assert all(r["o"] == (None if r["id"] == 50 else f"{r['model']}:{r['t']}") for r in out)
    sizes, padding = {"a": [], "b": []}, 0
    for name in os.listdir(calls):
        _, model, n, padded = open(os.path.join(calls, name)).read().split("|")
        sizes[model].append(int(n))
        padding += int(padded)
    assert sorted(sizes["a"]) == [1] + [5] * 16 or sorted(sizes["a"])[1:] == [5] * (len(sizes["a"]) - 1)
    assert sorted(sizes["b"])[1:] == [5] * (len(sizes["b"]) - 1)
    assert padding < (700 if window > 1 else 3000)


def test_padding_cost_counts_what_the_backend_pads(spark):
    df = spark.createDataFrame([(i, (i * 37) % 50) for i in range(100)] + [(200, None)], "id long, n long")
    got = {r["way"]: r for r in evaluation.padding_cost(df, "n", ["id"], 8, window=4).collect()}
    lengths = [(i * 37) % 50 for i in range(100)] + [0]

    def padding(order):
        return sum(max(b) * len(b) - sum(b) for b in (order[k:k + 8] for k in range(0, 101, 8)))

    dealt = [x for k in range(0, 101, 32) for x in sorted(lengths[k:k + 32])]
    assert got["as_they_come"]["n_padding"] == padding(lengths) and got["by_length"]["n_padding"] == padding(dealt)
    assert got["by_length"]["n_padding"] < got["as_they_come"]["n_padding"] and got["by_length"]["n_tokens"] == sum(lengths)


def test_judged_stream_survives_a_kill_between_batches(spark, tmp_path, monkeypatch):
    """The run dies after a batch is written and before it is committed; the restart replays it. Each row has one
    answer, each prompt was sent once, and the result is the batch job's."""
    drop, out, ckpt, book = (str(tmp_path / n) for n in ("drop", "out", "ckpt", "ledger"))
    calls = folder(tmp_path, "calls")
    consts = spark.createDataFrame([(1, "be kind"), (2, "be fair")], "constitution_id long, text string")
    rows = [(1 + i % 2, f"p{i}", f"Response 1: good {i}", f"Response 2: bad {i}") for i in range(30)] + [(9, "no constitution", "a", "b")]
    schema = judged_module.judge_stream.__defaults__[3]
    for part in (rows[:12], rows[12:20], rows[20:]):
        writers.write_csv(spark.createDataFrame(part, schema).coalesce(1), drop, mode="append")
    whole, died = judged_module.read_new_files, []
    seen = []

    def dying(lines, schema):
        seen.append(1)
        if len(seen) == 3 and not died:  # in the third batch, after two were written
            died.append(1)
            raise RuntimeError("killed")
        return whole(lines, schema)

    monkeypatch.setattr(judged_module, "read_new_files", dying)
    args = dict(backend=marking(calls), flip_ratio=0.5, max_files_per_trigger=1)
    with pytest.raises(Exception, match="killed"):
        judge_stream(spark, drop, consts, out, ckpt, book, **args)
    # forget that the second batch was committed: it is replayed as after a kill between write and commit
    os.remove(os.path.join(ckpt, "commits", "1"))
    for hidden in os.listdir(os.path.join(ckpt, "commits")):
        if hidden.startswith(".1"):
            os.remove(os.path.join(ckpt, "commits", hidden))
    judge_stream(spark, drop, consts, out, ckpt, book, **args)
    columns = ["constitution_id", "prompt", "chosen", "rejected", "flipped", "generated_text", "preference"]
    got = sorted((tuple(r) for r in spark.read.parquet(out).select(*columns).collect()), key=str)
    all_rows = spark.createDataFrame(rows, schema).withColumn("source_file", F.lit(""))
    want = judged(all_rows, consts, marking(folder(tmp_path, "batch")), "v1", 8, 0.5, ("prompt",), 42, ["constitution_id"], None)
    assert got == sorted((tuple(r) for r in want.select(*columns).collect()), key=str) and len(got) == 31
    assert len(marks(calls)) == 30 == len(set(marks(calls)))
    assert [r[5] for r in got if r[0] == 9] == [None]
