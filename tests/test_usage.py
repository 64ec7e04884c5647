"""The README's three workflows end to end, on files in the reference's layout, with stub backends."""

import os

from pyspark.sql import functions as F

from prefspark.operators import batch, evaluation, preferences, ranking
from prefspark.plans.fixtures import task_config
from prefspark.sinks.writers import write_csv, write_outputs
from prefspark.sources.csv import read_preferences, read_preferences_tolerant, with_lineage
from prefspark.sources.literal import tasks_df
from prefspark.sources.text import read_constitutions


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_readme_workflows(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "const", "constitution_1.txt"), "Be fair.\n")
    _write(os.path.join(tmp_dir, "const", "constitution_2.txt"), "Be kind.\n")
    header = "prompt,response_1,response_2\n"
    for ctx in (1, 2):
        for run in (0, 1):
            body = "".join(f'"q{ctx}{run}{i}","Response 1: good","Response 2: bad"\n' for i in range(5))
            _write(os.path.join(tmp_dir, "prefs", "2", f"{ctx}_{run}.csv"), header + body)
    _write(os.path.join(tmp_dir, "prefs", "2", "3_0.csv"), header + '"x","y","z","surplus"\n')

    consts = read_constitutions(spark, os.path.join(tmp_dir, "const"))
    rows, rejects = batch.generate_preferences(preferences.generation_grid(consts, runs=2))
    assert rows.count() > 0 and rejects.count() == 0

    good, bad_files = read_preferences_tolerant(spark, os.path.join(tmp_dir, "prefs", "2"), null_token=None)
    assert [os.path.basename(r["file_path"]) for r in bad_files.collect()] == ["3_0.csv"]
    pref = preferences.to_chosen_rejected(with_lineage(good), keep=["constitution_id", "context_id", "run_id"])
    pref = ranking.flip_preferences(pref, 0.6, ["context_id", "run_id", "prompt"], seed=42)
    assert pref.where("flipped").count() == 12 and pref.count() == 20
    assert {r["constitution_id"] for r in pref.collect()} == {2}
    write_csv(pref, os.path.join(tmp_dir, "cleaned"))
    assert read_preferences(spark, os.path.join(tmp_dir, "cleaned"),
                            schema="constitution_id int, context_id int, run_id int, prompt string, "
                                   "chosen string, rejected string, flipped boolean").count() == 20

    judged = batch.judge_preferences(good.withColumn("constitution_id", F.lit(1).cast("long")), consts)
    assert judged.count() == 20 and set(judged.columns) >= {"generated_text", "preference"}

    tasks = tasks_df(spark, task_config(2))
    grid = evaluation.continual_grid(tasks).select("model", F.col("eval_dataset").alias("dataset"))
    prompts = spark.createDataFrame([(f"constitution_{j}", i, f"prompt {i}") for j in (1, 2) for i in range(6)],
                                    "dataset string, row_id long, prompt string")
    outputs = batch.generate_outputs(prompts, grid)
    write_outputs(outputs, os.path.join(tmp_dir, "rewards_outputs"))
    scores = batch.score_outputs(outputs)
    matrix = evaluation.continual_matrix(evaluation.continual_grid(tasks), evaluation.avg_normalized_reward(scores))
    running = evaluation.continual_average(matrix.select("model", F.col("eval_task").alias("task"),
                                                         F.col("avg_reward").alias("reward")))
    assert matrix.count() == 6 and running.count() == 6
