"""Evaluation chain: golden numbers from the published result table, normalisation edges."""

import pytest
from pyspark.sql import functions as F

from prefspark.operators import evaluation
from prefspark.plans import fixtures as fx
from prefspark.sources.literal import results_df, tasks_df

# Published rows (task, model, average normalised reward), as the reference tabulates them.
# The published result rows, in their order.
PUBLISHED = [
    {"Task": "Constitution 1", "Model": "DPO-1", "Reward": 0.3823},
    {"Task": "DPO-Continual", "Model": "DPO-2", "Reward": 0.3799},
    {"Task": "Constitution 2", "Model": "DPO-2", "Reward": 0.4749},
    {"Task": "Constitution 1", "Model": "PPO-1", "Reward": 0.4897},
    {"Task": "PPO-Continual", "Model": "PPO-2", "Reward": 0.4897},
    {"Task": "Constitution 2", "Model": "PPO-2", "Reward": 0.6079},
]


def test_golden_continual_averages(spark):
    out = evaluation.continual_average(results_df(spark, PUBLISHED)).orderBy("model", "task").collect()
    got = [(r["model"], r["task"], r["cumulative_count"], round(r["continual_average_reward"], 4)) for r in out]
    assert got == [
        ("DPO-1", "Constitution 1", 1, 0.3823),
        ("DPO-2", "Constitution 2", 1, 0.4749),
        ("DPO-2", "DPO-Continual", 2, 0.4274),
        ("PPO-1", "Constitution 1", 1, 0.4897),
        ("PPO-2", "Constitution 2", 1, 0.6079),
        ("PPO-2", "PPO-Continual", 2, 0.5488),
    ]


def test_golden_drop_points(spark):
    first = [{"Task": "Constitution 1", "Model": "DPO-1", "Reward": 0.3823},
             {"Task": "Constitution 1", "Model": "PPO-1", "Reward": 0.4897},
             {"Task": "Constitution 2", "Model": "DPO-2", "Reward": 0.4749},
             {"Task": "Constitution 1", "Model": "DPO-2", "Reward": 0.3799},
             {"Task": "Constitution 2", "Model": "PPO-2", "Reward": 0.6079},
             {"Task": "Constitution 1", "Model": "PPO-2", "Reward": 0.4897}]
    out = evaluation.first_and_drop(results_df(spark, first), task_value="Constitution 1").collect()
    got = {r["prefix"]: (r["first_model"], round(r["drop_point"], 5)) for r in out}
    assert got == {"DPO": ("DPO-1", 0.15292), "PPO": ("PPO-1", 0.19588)}


def _scores(spark, rows):
    return spark.createDataFrame(rows, "model string, dataset string, row_id long, reward double")


def test_normalisation_edges(spark):
    rows = [("m", "const", 1, 0.5), ("m", "const", 2, 0.5),          # constant group -> NULL
            ("m", "one", 1, 0.7),                                     # one score -> NULL
            ("m", "nul", 1, None), ("m", "nul", 2, 1.0), ("m", "nul", 3, 3.0),
            ("m", "ok", 1, 1.0), ("m", "ok", 2, 2.0), ("m", "ok", 3, 5.0)]
    norm = {(r["dataset"], r["row_id"]): r["norm_reward"]
            for r in evaluation.normalize_rewards(_scores(spark, rows)).collect()}
    assert norm[("const", 1)] is None and norm[("one", 1)] is None
    assert norm[("nul", 1)] is None and norm[("nul", 3)] == 1.0
    assert [norm[("ok", i)] for i in (1, 2, 3)] == [0.0, 0.25, 1.0]
    avg = {r["dataset"]: r["avg_reward"] for r in evaluation.avg_normalized_reward(_scores(spark, rows)).collect()}
    assert avg["const"] is None and abs(avg["ok"] - (0.0 + 0.25 + 1.0) / 3) < 1e-12
    assert abs(avg["nul"] - 0.5) < 1e-12


def test_grid_is_triangular_and_missing_outputs(spark):
    tasks = tasks_df(spark, fx.task_config(3))
    grid = evaluation.continual_grid(tasks)
    cells = sorted((r["model"], r["eval_idx"]) for r in grid.collect())
    assert cells == sorted([(m, j) for i, c in enumerate(fx.task_config(3)) for m in c["models"] for j in range(i + 1)])
    scores = _scores(spark, [("DPO-1", "constitution_1", 1, 0.1), ("DPO-1", "constitution_1", 2, 0.3)])
    missing = evaluation.missing_outputs(grid, scores).count()
    assert missing == len(cells) - 1
    matrix = evaluation.continual_matrix(grid, evaluation.avg_normalized_reward(scores))
    assert matrix.where(F.col("avg_reward").isNotNull()).count() == 1
    assert matrix.count() == len(cells)


def test_results_map(spark):
    res = spark.createDataFrame([(1, "T2", "m", "T1", 0.1), (1, "T2", "m", "T2", 0.2)],
                                "task_idx int, task string, model string, eval_task string, avg_reward double")
    row = evaluation.results_map(res).first()
    assert row["rewards"] == {"T1": 0.1, "T2": 0.2}


def test_zip_join_cuts_to_shorter(spark):
    left = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "a long, p string")
    right = spark.createDataFrame([(10 - i, f"g{i}") for i in range(3)], "b long, g string")
    out = sorted((r["row_idx"], r["a"], r["b"]) for r in evaluation.zip_join(left, right, ["a"], ["b"]).collect())
    assert out == [(0, 0, 8), (1, 1, 9), (2, 2, 10)]


@pytest.mark.parametrize("size", [2, 3])
def test_pad_to_longest(spark, size):
    df = spark.createDataFrame([(i, list(range(i + 1))) for i in range(5)], "k long, ids array<int>")
    out = {r["k"]: r["padded"] for r in evaluation.pad_to_longest(df, "ids", ["k"], size).collect()}
    for b in range(0, 5, size):
        longest = min(b + size, 5)
        for k in range(b, min(b + size, 5)):
            assert len(out[k]) == longest and out[k][-(k + 1):] == list(range(k + 1))


def test_reward_metrics_tie_conventions(spark):
    from prefspark.operators.metrics import reward_eval_metrics
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (0.5, 0.5), (2.0, 1.0)], "r_chosen double, r_rejected double")
    acc = {t: reward_eval_metrics(df, ties=t).first()["accuracy"] for t in ("wrong", "correct", "exclude")}
    assert acc == {"wrong": 0.5, "correct": 0.75, "exclude": 2 / 3}


def test_empty_inputs(spark):
    from prefspark.operators import chat, metrics
    empty_scores = _scores(spark, [])
    assert evaluation.avg_normalized_reward(empty_scores).count() == 0
    grid = evaluation.continual_grid(tasks_df(spark, fx.task_config(2)))
    matrix = evaluation.continual_matrix(grid, evaluation.avg_normalized_reward(empty_scores))
    assert matrix.count() == grid.count() and matrix.where(F.col("avg_reward").isNotNull()).count() == 0
    assert evaluation.missing_outputs(grid, empty_scores).count() == grid.count()
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render_chat(conv).count() == 0
    prof = {r["column_name"]: (r["non_null"], r["n_rows"]) for r in metrics.profile(conv).collect()}
    assert prof == {"conv_id": (0, 0), "turn": (0, 0), "role": (0, 0), "text": (0, 0)}
    m = metrics.reward_eval_metrics(spark.createDataFrame([], "r_chosen double, r_rejected double")).first()
    assert m["n_pairs"] == 0 and m["accuracy"] is None
