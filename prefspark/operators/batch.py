"""M1-M4: model calls as partition-wise batch functions.

A *backend* is a factory ``(model_name) -> fn`` where ``fn(list[str]) -> list`` maps a batch of
texts to one output per text. The factory is shipped to the workers and called once per
partition and model (model loading happens there, never on the driver). Rows arrive as Arrow
batches through ``mapInPandas`` and are re-sliced to ``batch_size``. Prompts are rendered and
answers parsed with Spark expressions outside Python; only the model call is Python.

Several models: rows are first range-partitioned on (model, dataset, row_id) so that a task sees
one or two models while every task gets a similar share of rows, even for a dominant model; never
``groupBy(model).applyInPandas`` (a whole model's rows in one task).

Model calls are expensive and may sample, so each is made once: a job writes the backend's
answers to the shared folder (or a caller's ``path``) and everything after reads them from there.
The number of tasks follows the number of calls, not the bytes of the rows. A NULL text is not sent
to the backend and a NULL model is not loaded: the row stays, with a NULL answer.

With ``ledger`` (a folder), a job's answers are kept there by request: equal requests are sent once, and a
job that broke goes on where it was (see ``ledger``).
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from prefspark.functions import templates as T
from prefspark.functions.text import parse_preference, reward_input
from prefspark.operators.ledger import answered
from prefspark.operators.preferences import (explode_generated, generation_keys, strip_response_labels,
                                             with_constitution, with_domain)
from prefspark.plans.broadcast import small_side
from prefspark.session import default_parallelism, scratch_path, ship_package

Backend = Callable[[str], Callable[[list[str]], list]]


# ------------------------------------------------------------------ deterministic stub backends

def stub_judge(model: str = "stub") -> Callable[[list[str]], list[str]]:
    """Answers by prompt length: '0', ' 1.' or an unusable 'Response 1 or 0'."""
    answers = ["0", " 1.", "Response 1 or 0"]
    return lambda texts: [answers[len(t) % 3] for t in texts]


def stub_generator(model: str = "stub") -> Callable[[list[str]], list[str]]:
    """Returns generator-style JSON ``{"row": [...]}`` with 1-3 rows derived from the prompt hash."""
    def fn(texts):
        out = []
        for t in texts:
            h = hashlib.md5(t.encode("utf-8")).hexdigest()
            n = 1 + len(t) % 3
            rows = [{"prompt": f"Scenario {h[:8]}-{i}",
                     "response_1": f"Response 1: fair answer {i}",
                     "response_2": f"Response 2: unfair answer {i}"} for i in range(n)]
            out.append(json.dumps({"row": rows}))
        return out
    return fn


def stub_policy(model: str = "stub") -> Callable[[list[str]], list[str]]:
    """Greedy 'generation' whose text contains the prompt, like a decoded full sequence."""
    return lambda texts: [f"{t} -> {model} answer of {len(t.split())} words" for t in texts]


def stub_reward(model: str = "stub") -> Callable[[list[str]], list[float]]:
    """A reward in [0, 1] from the text's length and the last letter of the model's name."""
    return lambda texts: [((len(t) + ord(model[-1])) % 101) / 100.0 for t in texts]


BACKENDS: dict[str, Backend] = {
    "stub-judge": stub_judge, "stub-generator": stub_generator,
    "stub-policy": stub_policy, "stub-reward": stub_reward,
}


def resolve_backend(backend: str | Backend) -> Backend:
    """A callable, or a registered name (case-insensitive); unknown names raise with the choices."""
    if callable(backend):
        return backend
    key = str(backend).lower()
    if key not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; choose one of {sorted(BACKENDS)}")
    return BACKENDS[key]


# ------------------------------------------------------------------ the partition-wise runner

def map_batches(df: DataFrame, text_col: str, out_col: str, out_type: str, backend: str | Backend,
                batch_size: int, carry: Sequence[str] = (), model_col: str | None = None,
                default_model: str = "default", window: int = 1) -> DataFrame:
    """Run ``backend`` over ``text_col`` in batches; output = ``carry`` columns + ``out_col``.

    Rows that do not fill a batch wait for the next Arrow frame, so every call of a task and model has
    ``batch_size`` texts but its last one. With ``window`` above 1, that many batches are gathered and
    dealt by text length, so that texts of a batch are padded to less."""
    factory = resolve_backend(backend)
    ship_package(df.sparkSession)
    carry = list(carry)
    if model_col and model_col not in carry:
        carry = [model_col] + carry
    in_df = df.select(*carry, *([text_col] if text_col not in carry else []))
    fields = [f for f in in_df.schema.fields if f.name in carry]
    out_schema = StructType([StructField(f.name, f.dataType, f.nullable) for f in fields]
                            + [StructField(out_col, _parse_type(out_type), True)])
    gathered = batch_size * max(window, 1)

    def run(frames):
        models: dict[str, Callable] = {}
        waiting: dict[str, pd.DataFrame] = {}  # of each model: rows that do not fill their batches yet

        def results(model, rows):
            if model not in models:
                models[model] = factory(model)
            texts = rows[text_col].tolist()
            order = sorted(range(len(texts)), key=lambda k: len(texts[k])) if window > 1 else range(len(texts))
            found: list = [None] * len(texts)
            for start in range(0, len(texts), batch_size):
                chunk = order[start:start + batch_size]
                result = list(models[model]([texts[k] for k in chunk]))
                if len(result) != len(chunk):
                    raise ValueError(f"backend returned {len(result)} outputs for {len(chunk)} inputs")
                for k, answer in zip(chunk, result):
                    found[k] = answer
            return found

        def answered(model, rows):
            out = rows[carry].copy()
            out[out_col] = pd.Series(results(model, rows), index=rows.index)
            return out

        for pdf in frames:
            pdf = pdf.reset_index(drop=True)
            groups = pdf.groupby(model_col, sort=False, dropna=False) if model_col else [(default_model, pdf)]
            for model, part in groups:
                sent = part[text_col].notna() if isinstance(model, str) else pd.Series(False, index=part.index)
                if not sent.all():
                    out = part.loc[~sent, carry].copy()
                    out[out_col] = pd.Series([None] * len(out), index=out.index, dtype=object)
                    yield out
                rows = part.loc[sent]
                if model in waiting:
                    rows = pd.concat([waiting.pop(model), rows], ignore_index=True)
                full = len(rows) - len(rows) % gathered
                if full:
                    yield answered(model, rows.iloc[:full])
                if len(rows) > full:
                    waiting[model] = rows.iloc[full:]
        for model, rows in waiting.items():
            yield answered(model, rows)

    return in_df.mapInPandas(run, out_schema)


def _parse_type(ddl: str):
    from pyspark.sql.types import _parse_datatype_string
    return _parse_datatype_string(ddl)


def call_tasks(df: DataFrame, calls_per_task: int) -> int:
    """Tasks for the calls of ``df``: all cores, and no task with many more than ``calls_per_task``."""
    return max(default_parallelism(df.sparkSession), math.ceil(df.count() / calls_per_task))


def write_once(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run ``df`` once into a table (in the shared folder, or at ``path``) and return the table."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def call_once(df: DataFrame, text_col: str, out_col: str, out_type: str, backend: str | Backend, batch_size: int,
              carry: Sequence[str], name: str, path: str | None = None, ledger: str | None = None,
              model_col: str | None = None, per: Sequence[str] = ()) -> DataFrame:
    """``carry`` and the backend's answers as a written table; through ``ledger`` if there is one, where rows that
    agree in text, model and the columns ``per`` are one request."""
    if ledger is None:
        return write_once(map_batches(df, text_col, out_col, out_type, backend, batch_size, carry, model_col), name, path)
    named = backend if isinstance(backend, str) else getattr(backend, "__qualname__", type(backend).__qualname__)
    model = F.col(f"`{model_col}`") if model_col else F.lit(named)

    def call(requests: DataFrame) -> DataFrame:
        return map_batches(requests, "text", "answer", out_type, backend, batch_size, carry=["request"],
                           model_col="model" if model_col else None).select("request", "answer")
    found = answered(df, text_col, out_col, out_type, call, batch_size, ledger, model, per)
    return write_once(found.select(*[F.col(f"`{c}`") for c in carry], out_col), name, path)


# ------------------------------------------------------------------ jobs

def judge_preferences(df: DataFrame, constitutions: DataFrame, backend: str | Backend = "stub-judge",
                      template: str = "v1", batch_size: int = 8,
                      carry: Sequence[str] = ("prompt", "response_1", "response_2"),
                      num_partitions: int | None = None, path: str | None = None,
                      ledger: str | None = None) -> DataFrame:
    """M1: X5 judge prompt (with J5) -> backend -> X4 parse -> ``preference`` (0, 1 or NULL). A row whose
    prompt is NULL (a missing response or constitution) is not judged: NULL text and preference."""
    spread = df.repartition(num_partitions or call_tasks(df, batch_size * 500))
    joined = with_constitution(spread, constitutions)
    prompts = joined.withColumn("_judge_prompt", T.judge_prompt("constitution", "prompt", "response_1",
                                                                 "response_2", template))
    keep = [c for c in df.columns if c not in carry] + list(carry)
    judged = call_once(prompts, "_judge_prompt", "generated_text", "string", backend, batch_size, keep, "judged",
                       path, ledger)
    return judged.withColumn("preference", parse_preference("generated_text"))


def generate_preferences(grid: DataFrame, backend: str | Backend = "stub-generator", n: int = 20,
                         batch_size: int = 16, keys: Sequence[str] = ("constitution_id", "context_id", "run_id"),
                         num_partitions: int | None = None, path: str | None = None,
                         ledger: str | None = None):
    """M2: one generator call per (constitution, context, run); JSON -> rows (X14/P5) -> labels
    stripped (X1). Returns ``(rows, rejects)``, both read from the one written table of answers.

    Each grid cell is one generator request; a backend receives up to ``batch_size`` requests at
    once (and may send them concurrently). ``grid`` holds the keys with ``text`` and ``domain``; the
    cells are hash-spread by their keys. In a ledger, cells of equal prompts are requests of their own.
    """
    parts = num_partitions or call_tasks(grid.select(*keys), batch_size * 250)
    prompts = (grid.repartition(parts, *keys)
                   .withColumn("_gen_prompt", T.generator_prompt("text", "domain", F.lit(n))))
    raw = call_once(prompts, "_gen_prompt", "raw", "string", backend, batch_size, list(keys), "generated", path,
                    ledger, per=keys)
    rows, rejects = explode_generated(raw, "raw", keep=list(keys))
    return strip_response_labels(rows), rejects


def generate_from_constitutions(constitutions: DataFrame, backend: str | Backend = "stub-generator", n: int = 20,
                                runs: int = 200, batch_size: int = 16, num_partitions: int | None = None,
                                path: str | None = None, ledger: str | None = None):
    """J7 + M2: the cells' keys are spread over the tasks first, and their texts attached there."""
    keys = ["constitution_id", "context_id", "run_id"]
    cells = generation_keys(constitutions, runs)
    cells = cells.repartition(num_partitions or call_tasks(cells, batch_size * 250), *keys)
    grid = with_domain(with_constitution(cells, constitutions, text_col="text"))
    prompts = grid.withColumn("_gen_prompt", T.generator_prompt("text", "domain", F.lit(n)))
    raw = call_once(prompts, "_gen_prompt", "raw", "string", backend, batch_size, keys, "generated", path, ledger,
                    per=keys)
    rows, rejects = explode_generated(raw, "raw", keep=keys)
    return strip_response_labels(rows), rejects


def generate_outputs(prompts: DataFrame, grid: DataFrame, backend: str | Backend = "stub-policy",
                     batch_size: int = 256, num_partitions: int | None = None,
                     include_prompt: bool = True, path: str | None = None,
                     ledger: str | None = None) -> DataFrame:
    """M3: outputs of every model on the prompts of each dataset it is evaluated on (J2 grid).

    ``prompts``: (dataset, row_id, prompt); ``grid``: (model, dataset) and, if there, the dataset's
    ``reward_model``, which is carried along for scoring.
    ``include_prompt=False`` removes the prompt from the front of each output.
    Work is range-partitioned on (model, row_id): partitions hold similar row counts (bounds from a
    sample), a model's rows are contiguous, so a task loads one or two models, and a model with a
    third of all rows is still spread over a third of the tasks.
    """
    extra = ["reward_model"] if "reward_model" in grid.columns else []
    work = prompts.join(small_side(grid.select("model", "dataset", *extra).distinct()), "dataset")
    parts = num_partitions or call_tasks(work.select("model"), batch_size * 40)
    out = call_once(work.repartitionByRange(parts, "model", "dataset", "row_id"), "prompt", "generated_text", "string",
                    backend, batch_size, ["model", "dataset", "row_id", "prompt", *extra], "outputs", path, ledger,
                    model_col="model")
    if include_prompt:  # like a decoded full sequence: the text starts with the prompt
        return out
    gen, prompt = F.col("generated_text"), F.col("prompt")
    return out.withColumn("generated_text", F.when(gen.startswith(prompt),
                                                   gen.substr(F.length(prompt) + 1, F.length(gen))).otherwise(gen))


def score_outputs(outputs: DataFrame, backend: str | Backend = "stub-reward", batch_size: int = 256,
                  reward_model_col: str | None = "reward_model", num_partitions: int | None = None,
                  path: str | None = None, ledger: str | None = None) -> DataFrame:
    """M4: reward of prompt + output (X8) per row, by the row's own reward model (that of its
    dataset) where ``outputs`` names one; a row without a reward model keeps a NULL reward."""
    texts = outputs.withColumn("_reward_text", reward_input("prompt", "generated_text"))
    own = reward_model_col if reward_model_col in outputs.columns else None
    order = [c for c in (own, "model", "dataset", "row_id") if c]
    parts = num_partitions or call_tasks(outputs.select("model"), batch_size * 40)
    carry = ["model", "dataset", "row_id"]
    scored = call_once(texts.repartitionByRange(parts, *order), "_reward_text", "reward", "double", backend, batch_size,
                       carry, "scores", path, ledger, model_col=own)
    # backends return NULL, never NaN (Spark orders NaN above every number)
    return scored.select(*carry, F.nanvl(F.col("reward"), F.lit(None).cast("double")).alias("reward"))
