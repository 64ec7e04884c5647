"""T1 + M1: preferences are judged as their files arrive.

Each micro-batch of new files is read by header name, judged with its constitution, cleaned, flipped by hash (G2) and
written to a folder of its own. A batch that is replayed after a failure replaces its folder, and finds the
answers of its finished tasks in the ledger: no row is written twice, and no answered prompt is sent again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefspark.operators.batch import Backend, judge_preferences
from prefspark.operators.ranking import flip_preferences
from prefspark.sources.csv import PREFERENCE_SCHEMA
from prefspark.streaming.ingest import clean_preferences, for_each_batch, read_new_files

JUDGED = ["generated_text", "preference"]


def judged(rows: DataFrame, constitutions: DataFrame, backend: str | Backend, template: str, batch_size: int,
           flip_ratio: float | None, flip_key, seed: int, keep, ledger: str | None) -> DataFrame:
    """Judge as written, then labels stripped (X1), renamed (P1) and flipped (G2); also what a batch job runs."""
    answers = judge_preferences(rows, constitutions, backend, template, batch_size, ledger=ledger)
    cleaned = clean_preferences(answers, keep=[*keep, *JUDGED])
    if flip_ratio is None:
        return cleaned
    return flip_preferences(cleaned, flip_ratio, list(flip_key), seed=seed, exact=False)


def judge_stream(spark: SparkSession, in_dir: str, constitutions: DataFrame, out_dir: str, checkpoint: str, ledger: str,
                 backend: str | Backend = "stub-judge", template: str = "v1", batch_size: int = 8,
                 schema: str = f"constitution_id long, {PREFERENCE_SCHEMA}", flip_ratio: float | None = None,
                 flip_key=("prompt",), seed: int = 42, keep=("constitution_id",),
                 max_files_per_trigger: int | None = None) -> None:
    """Judge the rows of all new files under ``in_dir`` into ``out_dir``, one folder a micro-batch (``batch=n``).
    The files hold ``constitution_id``; a row without one, or with a NULL text, is kept and not judged."""
    def write(lines: DataFrame, number: int) -> None:
        rows = read_new_files(lines, schema)
        out = judged(rows, constitutions, backend, template, batch_size, flip_ratio, flip_key, seed,
                     [*keep, "source_file"], ledger)
        out.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    for_each_batch(spark, in_dir, checkpoint, write, max_files_per_trigger)
