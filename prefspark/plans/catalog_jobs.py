"""Catalog part 2: sources, sinks, batch-function jobs, the reward model and the stream.

These queries write data derived from the driver's tables to a fresh folder under the shared
checkpoint root, then read it back through the operator under test. Where the read-back equals a
SQL-expressible table (round trips, deterministic stub backends) an oracle is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions import templates as T
from prefspark.functions.text import hash_hex, hash_unit32, word_count
from prefspark.operators import batch, evaluation, grid_state, metrics, reward_model, tokenize
from prefspark.plans import fixtures as fx
from prefspark.plans.catalog import (FLIP_RATIO, JUDGE_BATCH, ORACLE, _grid_sql, _tasks, query, r6, sql_hash, sql_strip,
                                     sql_unit32, sql_wc)
from prefspark.session import scratch_path
from prefspark.sinks import writers
from prefspark.sources import csv as csv_src
from prefspark.sources.datasets import read_dataset
from prefspark.sources.tables import read_table
from prefspark.sources.text import read_constitutions
from prefspark.streaming.ingest import ingest_preferences_stream
from prefspark.streaming.judged import judge_stream

KEYED_SCHEMA = "conv_id long, turn long, prompt string, response_1 string, response_2 string"
FILE_CONVERSATIONS = 10  # conversations per drop file of a written fixture: more data, more files


def _file_key():
    return F.floor(F.col("conv_id") / FILE_CONVERSATIONS).cast("int")


FILE_KEY_SQL = f"CAST(conv_id // {FILE_CONVERSATIONS} AS INTEGER)"


def _labelled_pairs(spark, sf_dir) -> DataFrame:
    """pairs with the generator's labels in front of the responses (K1 removes them)."""
    p = fx.pairs(spark, sf_dir)
    return (p.withColumn("response_1", F.concat(F.lit("Response 1: "), "response_1"))
             .withColumn("response_2", F.concat(F.lit("Response 2: "), "response_2")))


_CLEAN_PAIRS_SQL = fx.with_sql(["pairs"], f"""
SELECT conv_id, turn, prompt, {sql_strip("response_1")} AS response_1, {sql_strip("response_2")} AS response_2 FROM pairs""")


@query("csv_roundtrip", _CLEAN_PAIRS_SQL)
def q_csv_roundtrip(spark, sf_dir):
    """K1 (label strip, quoted, escaped) -> S1 (multiLine, explicit schema): exact round trip."""
    path = scratch_path(spark, "csv-roundtrip")
    writers.write_preferences(_labelled_pairs(spark, sf_dir), path)
    back = csv_src.read_preferences(spark, path, schema=KEYED_SCHEMA)
    return back.select("conv_id", "turn", "prompt", "response_1", "response_2")


@query("csv_scan", fx.with_sql(["pairs"], "SELECT conv_id, turn, prompt, response_1, response_2 FROM pairs"))
def q_csv_scan(spark, sf_dir):
    """K2 -> S1: plain CSV sink (quoted, escaped, no trimming) read back exactly."""
    path = scratch_path(spark, "csv-scan")
    writers.write_csv(fx.pairs(spark, sf_dir), path)
    return csv_src.read_preferences(spark, path, schema=KEYED_SCHEMA).select(
        "conv_id", "turn", "prompt", "response_1", "response_2")


@query("csv_sink", fx.with_sql(["pairs"], f"""
SELECT conv_id, turn, prompt,
       CASE WHEN conv_id % 2 = 0 THEN 'v2:' ELSE '' END || {sql_strip("response_1")} AS response_1,
       {sql_strip("response_2")} AS response_2
FROM pairs"""))
def q_csv_sink(spark, sf_dir):
    """K1 + K5: all pairs written into eight folders, then half of the partitions written again
    with new values; the dynamic overwrite replaces exactly those partitions."""
    path = scratch_path(spark, "csv-sink")
    src = _labelled_pairs(spark, sf_dir).withColumn("folder", F.pmod("conv_id", F.lit(8)))
    writers.write_preferences(src, path, partition_by=["folder"])
    second = (src.where(F.col("folder") % 2 == 0)
                 .withColumn("response_1", F.concat(F.lit("Response 1: v2:"), F.expr("substring(response_1, 13)"))))
    writers.write_preferences(second, path, mode="overwrite", partition_by=["folder"])
    return csv_src.read_preferences(spark, path, schema=KEYED_SCHEMA).select(
        "conv_id", "turn", "prompt", "response_1", "response_2")


@query("csv_lineage", fx.with_sql(["pairs"], f"SELECT conv_id, turn, {FILE_KEY_SQL} AS file_key FROM pairs"))
def q_csv_lineage(spark, sf_dir):
    """Keys carried by the file path, not by the rows (partition discovery + ``_metadata``)."""
    path = scratch_path(spark, "csv-lineage")
    src = fx.pairs(spark, sf_dir).withColumn("file_key", _file_key())
    writers.write_csv(src.repartition("file_key"), path, partition_by=["file_key"])
    back = csv_src.read_preferences(spark, path, schema=KEYED_SCHEMA, path_col="file_path")
    located = csv_src.with_lineage(back, pattern=r"/(file_key)=(\d+)/()").withColumnRenamed("context_id", "path_key")
    return located.select("conv_id", "turn", F.col("path_key").alias("file_key"))


def _drop_of_three_layouts(spark, sf_dir, path: str) -> None:
    """Pairs in files of three layouts: as they are, reordered, and without a column but with another one."""
    p = _labelled_pairs(spark, sf_dir)
    for layout, columns in enumerate((["conv_id", "turn", "prompt", "response_1", "response_2"],
                                      ["response_2", "turn", "prompt", "conv_id", "response_1"],
                                      ["note", "response_1", "conv_id", "prompt", "turn"])):
        own = p.where(F.pmod("conv_id", F.lit(3)) == layout).withColumn(
            "note", F.concat(F.lit("turn, "), F.col("turn").cast("string")))
        writers.write_csv(own.select(*columns), f"{path}/layout={layout}")


@query("csv_by_name", fx.with_sql(["pairs"], """
SELECT conv_id, turn, prompt, 'Response 1: ' || response_1 AS response_1,
       CASE WHEN conv_id % 3 < 2 THEN 'Response 2: ' || response_2 END AS response_2,
       CASE WHEN conv_id % 3 = 2 THEN 'turn, ' || CAST(turn AS VARCHAR) END AS note FROM pairs"""))
def q_csv_by_name(spark, sf_dir):
    """S1 + U1: files with reordered, missing and additional columns are united by header name."""
    path = scratch_path(spark, "csv-by-name")
    _drop_of_three_layouts(spark, sf_dir, path)
    return csv_src.read_preferences(spark, path, schema=KEYED_SCHEMA, additional=True).drop("layout")


@query("stream_by_name", fx.with_sql(["pairs"], f"""
SELECT conv_id, turn, prompt, {sql_strip("response_1")} AS chosen,
       CASE WHEN conv_id % 3 < 2 THEN {sql_strip("response_2")} END AS rejected FROM pairs"""))
def q_stream_by_name(spark, sf_dir):
    """T1 + U1: the same files through the stream."""
    drop, out, ckpt = (scratch_path(spark, name) for name in ("drop-by-name", "ingested", "ingest-ckpt"))
    _drop_of_three_layouts(spark, sf_dir, drop)
    ingest_preferences_stream(spark, drop, out, ckpt, schema=KEYED_SCHEMA, keep=("conv_id", "turn"))
    return spark.read.parquet(out).select("conv_id", "turn", "prompt", "chosen", "rejected")


# one file in ten is bad, and holds a surplus field in every other row (both by hash)
_BAD = (f"{sql_unit32(sql_hash('badfile', 'file_key'))} < 429496729"
        f" AND {sql_unit32(sql_hash('extra', 'conv_id', 'turn'))} < 2147483648")


@query("csv_tolerant", fx.with_sql(["pairs"], f"""
, k AS (SELECT *, {FILE_KEY_SQL} AS file_key FROM pairs)
, f AS (SELECT *, {_BAD} AS bad FROM k)
, badfiles AS (SELECT DISTINCT file_key FROM f WHERE bad)
SELECT conv_id, turn, prompt, response_1, response_2 FROM f WHERE file_key NOT IN (SELECT file_key FROM badfiles)"""))
def q_csv_tolerant(spark, sf_dir):
    """Files written the reference's way (quotes not escaped); about one file in ten holds
    rows with one field too many, and every such file is rejected whole."""
    path = scratch_path(spark, "csv-tolerant")
    p = fx.pairs(spark, sf_dir).withColumn("file_key", _file_key())
    bad = ((hash_unit32(hash_hex("badfile", "file_key")) < F.lit(429496729))
           & (hash_unit32(hash_hex("extra", "conv_id", "turn")) < F.lit(2147483648)))
    q = F.lit('"')
    line = F.concat(q, F.col("conv_id").cast("string"), F.lit('","'), F.col("turn").cast("string"), F.lit('","'),
                    F.col("prompt"), F.lit('","'), F.col("response_1"), F.lit('","'), F.col("response_2"), q,
                    F.when(bad, F.lit(',"surplus"')).otherwise(F.lit("")))
    p.select("file_key", line.alias("value")).repartition("file_key").write.partitionBy("file_key").text(path)
    good, _bad_files = csv_src.read_preferences_tolerant(spark, path, schema=KEYED_SCHEMA, header=False)
    return good.select("conv_id", "turn", "prompt", "response_1", "response_2")


@query("constitution_scan", "SELECT item_id AS constitution_id, text FROM benchmark")
def q_constitution_scan(spark, sf_dir):
    """S3: one whole-text file per constitution, id from the path."""
    path = scratch_path(spark, "constitutions")
    fx.constitutions(spark, sf_dir).repartition("constitution_id").write.partitionBy("constitution_id").text(path)
    return read_constitutions(spark, path, strip_final_newline=True)


@query("split_scan", fx.with_sql(["split_docs"], "SELECT doc_id, text, lang, split FROM split_docs WHERE split = 'test'"))
def q_split_scan(spark, sf_dir):
    """S4 + K5: dataset partitioned by split; reading one split lists and reads only its folder."""
    path = scratch_path(spark, "split-dataset")
    writers.write_parquet(fx.split_documents(spark, sf_dir), path, partition_by=["split"])
    return read_dataset(spark, path, "test").select("doc_id", "text", "lang", "split")


@query("partitioned_sink", fx.with_sql(["scores"], "SELECT model, dataset, row_id, round(reward, 6) AS reward FROM scores WHERE model = 'DPO-1'"))
def q_partitioned_sink(spark, sf_dir):
    """K3: outputs per (model, dataset) folder; one model's read prunes to its folders."""
    path = scratch_path(spark, "outputs")
    writers.write_outputs(fx.scores(spark, sf_dir), path)
    back = spark.read.parquet(path).where(F.col("model_dir") == "DPO-1")
    return back.select("model", "dataset", "row_id", r6("reward").alias("reward"))


@query("metrics_sink", fx.with_sql(["reward_pairs"], """
, m AS (SELECT count(*) AS n_pairs, avg(CASE WHEN r_chosen - r_rejected > 0 THEN 1.0 ELSE 0.0 END) AS accuracy,
          avg(r_chosen - r_rejected) AS mean_margin,
          avg(greatest(-(r_chosen - r_rejected), 0.0) + ln(1 + exp(-abs(r_chosen - r_rejected))))
          + 0.1::DOUBLE * avg((r_chosen + r_rejected) * (r_chosen + r_rejected)) AS loss FROM reward_pairs)
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'n_pairs' AS metric, CAST(n_pairs AS DOUBLE) AS value FROM m UNION ALL SELECT 'accuracy', accuracy FROM m
  UNION ALL SELECT 'mean_margin', mean_margin FROM m UNION ALL SELECT 'loss', loss FROM m)"""))
def q_metrics_sink(spark, sf_dir):
    """K4: metric rows written as JSON and read back."""
    path = scratch_path(spark, "metrics")
    writers.write_metrics(writers.metrics_long(metrics.reward_eval_metrics(fx.reward_pairs(spark, sf_dir))), path)
    back = spark.read.schema("metric string, value double").json(path)
    return back.select("metric", r6("value").alias("value"))


# ------------------------------------------------------------------ batch-function jobs

@query("judge_job", fx.with_sql(["cpairs", "constitutions"], f"""
, j AS (SELECT p.conv_id, p.turn, p.constitution_id, p.prompt, p.response_1, p.response_2,
          {T.render_sql(T.JUDGE_TEMPLATE_V1, constitution='c.text', prompt='p.prompt', response_1='p.response_1', response_2='p.response_2')} AS jp
        FROM cpairs p JOIN constitutions c ON c.constitution_id = p.constitution_id)
, a AS (SELECT *, CASE length(jp) % 3 WHEN 0 THEN '0' WHEN 1 THEN ' 1.' ELSE 'Response 1 or 0' END AS generated_text FROM j)
SELECT conv_id, turn, constitution_id, prompt, response_1, response_2, generated_text,
       CASE WHEN regexp_replace(generated_text, '[^0-9]', '', 'g') IN ('0', '1')
            THEN CAST(regexp_replace(generated_text, '[^0-9]', '', 'g') AS INTEGER) END AS preference FROM a"""))
def q_judge_job(spark, sf_dir):
    """M1: judge prompt (X5, J5) -> backend in batches of 8 -> preference."""
    return batch.judge_preferences(fx.pairs_with_constitution(spark, sf_dir), fx.constitutions(spark, sf_dir),
                                   backend="stub-judge", template="v1", batch_size=8)


@query("judge_resume", ORACLE["judge_job"])
def q_judge_resume(spark, sf_dir):
    """M1 with a ledger: a first run judges half of the pairs, the second all, asking only for what is missing."""
    ledger = scratch_path(spark, "judge-ledger")
    pairs, consts = fx.pairs_with_constitution(spark, sf_dir), fx.constitutions(spark, sf_dir)
    batch.judge_preferences(pairs.where(F.col("conv_id") % 2 == 0), consts, ledger=ledger)
    return batch.judge_preferences(pairs, consts, ledger=ledger)


PADDING_WINDOW = 32  # batches that are dealt by length together


@query("padding_cost", f"""
WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, coalesce({sql_wc("text")}, 0) AS len FROM documents)
, w AS (SELECT idx, len, idx // {JUDGE_BATCH} AS batch, idx // {JUDGE_BATCH * PADDING_WINDOW} AS win FROM l)
, d AS (SELECT len, batch, win * {PADDING_WINDOW}
               + (row_number() OVER (PARTITION BY win ORDER BY len, idx) - 1) // {JUDGE_BATCH} AS dealt FROM w)
, b AS (SELECT 'as_they_come' AS way, batch, max(len) AS longest, sum(len) AS tokens, count(*) AS n FROM d GROUP BY batch
        UNION ALL SELECT 'by_length', dealt, max(len), sum(len), count(*) FROM d GROUP BY dealt)
SELECT way, count(*) AS n_batches, CAST(sum(tokens) AS BIGINT) AS n_tokens,
       CAST(sum(longest * n - tokens) AS BIGINT) AS n_padding FROM b GROUP BY way""")
def q_padding_cost(spark, sf_dir):
    """W7 + W10: tokens and padding of the documents' judge batches, in key order and dealt by length."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", word_count("text").alias("n_words"))
    return evaluation.padding_cost(docs, "n_words", ["doc_id"], JUDGE_BATCH, PADDING_WINDOW)


GEN_RUNS = 200  # FIXED VALUE: runs per (constitution, context), as in the generation grid


def _generation_sql() -> str:
    domains = ", ".join(f"({i + 1}, '{d}')" for i, d in enumerate(T.DOMAINS))
    prompt = T.render_sql(T.GENERATOR_TEMPLATE, constitution="c.text", domain="d.domain", n="20")
    return fx.with_sql(["constitutions"], f"""
, d AS (SELECT * FROM (VALUES {domains}) AS t(context_id, domain))
, g AS (SELECT c.constitution_id, d.context_id, CAST(r.run AS INTEGER) AS run_id, {prompt} AS gp
        FROM constitutions c CROSS JOIN d CROSS JOIN range(0, {GEN_RUNS}) AS r(run))
, x AS (SELECT constitution_id, context_id, run_id, substr(md5(gp), 1, 8) AS h, 1 + length(gp) % 3 AS n FROM g)
SELECT constitution_id, CAST(context_id AS INTEGER) AS context_id, run_id, CAST(i.i AS INTEGER) AS row_no,
       'Scenario ' || h || '-' || CAST(i.i AS VARCHAR) AS prompt,
       'fair answer ' || CAST(i.i AS VARCHAR) AS response_1, 'unfair answer ' || CAST(i.i AS VARCHAR) AS response_2
FROM x CROSS JOIN range(0, 3) AS i(i) WHERE i.i < x.n""")


@query("generation_job", _generation_sql())
def q_generation_job(spark, sf_dir):
    """M2: generation grid (J7) -> generator prompt (X6) -> backend JSON -> rows (X14, P5) -> X1."""
    rows, _rejects = batch.generate_from_constitutions(fx.constitutions(spark, sf_dir), runs=GEN_RUNS)
    return rows


def _cut_generator(model: str = "stub"):
    """The stub generator, with answers cut short where the prompt's hash starts with 0 or 1."""
    import hashlib as _h
    whole = batch.stub_generator(model)

    def fn(texts):
        return [a[:-2] if _h.md5(t.encode()).hexdigest()[0] in "01" else a for t, a in zip(texts, whole(texts))]
    return fn


@query("generation_rejects", _generation_sql().split(", x AS (SELECT")[0] + """
SELECT constitution_id, CAST(context_id AS INTEGER) AS context_id, run_id FROM g WHERE substr(md5(gp), 1, 1) IN ('0', '1')""")
def q_generation_rejects(spark, sf_dir):
    """M2's other result, from the same written answers: cells whose answer does not parse."""
    _rows, rejects = batch.generate_from_constitutions(fx.constitutions(spark, sf_dir), backend=_cut_generator,
                                                       runs=GEN_RUNS)
    return rejects.select("constitution_id", "context_id", "run_id")


def _eval_prompts(spark, sf_dir) -> DataFrame:
    """(dataset, row_id, prompt): pair prompts spread over the five datasets."""
    p = fx.pairs(spark, sf_dir)
    return p.select(F.concat(F.lit("constitution_"), (F.pmod("conv_id", F.lit(fx.N_TASKS)) + 1).cast("string")).alias("dataset"),
                    (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "prompt")


def _outputs(spark, sf_dir) -> DataFrame:
    grid = evaluation.continual_grid(_tasks(spark)).select("model", F.col("eval_dataset").alias("dataset"),
                                                           "reward_model")
    return batch.generate_outputs(_eval_prompts(spark, sf_dir), grid, backend="stub-policy", batch_size=256)


def _scores(spark, sf_dir) -> DataFrame:
    return batch.score_outputs(_outputs(spark, sf_dir), backend="stub-reward", batch_size=256)


_REWARD_MODELS = ", ".join(f"('{c['dataset']}', '{c['reward_model']}')" for c in fx.task_config())
_EVAL_PROMPTS_SQL = f"""
, ep AS (SELECT 'constitution_' || CAST(conv_id % {fx.N_TASKS} + 1 AS VARCHAR) AS dataset, conv_id * 1000 + turn AS row_id, prompt FROM pairs)
, gm AS (SELECT DISTINCT grid.model, grid.eval_dataset AS dataset, tr.reward_model FROM grid
         JOIN (SELECT * FROM (VALUES {_REWARD_MODELS}) AS r(dataset, reward_model)) tr ON tr.dataset = grid.eval_dataset)
, outs AS (SELECT gm.model, gm.reward_model, ep.dataset, ep.row_id, ep.prompt,
             ep.prompt || ' -> ' || gm.model || ' answer of ' || CAST({sql_wc('ep.prompt')} AS VARCHAR) || ' words' AS generated_text
           FROM ep JOIN gm ON gm.dataset = ep.dataset)
, sc AS (SELECT model, dataset, row_id, ((length(prompt || generated_text) + ascii(right(reward_model, 1))) % 101) / 100.0 AS reward FROM outs)
, st AS (SELECT model, dataset, count(reward) AS n_scores, min(reward) AS mn, max(reward) AS mx, avg(reward) AS av FROM sc GROUP BY ALL)
, av2 AS (SELECT model, dataset, (av - mn) / nullif(mx - mn, 0) AS avg_reward FROM st)
"""


def _jobs_sql(body: str) -> str:
    return fx.with_sql(["tasks", "pairs"], _grid_sql().split(", stats AS")[0] + _EVAL_PROMPTS_SQL + body)


@query("output_job", _jobs_sql("SELECT model, dataset, row_id, generated_text FROM outs"))
def q_output_job(spark, sf_dir):
    """M3: every model's outputs on the datasets of its grid cells (partitioned by model + salt)."""
    return _outputs(spark, sf_dir).select("model", "dataset", "row_id", "generated_text")


@query("scoring_job", _jobs_sql("SELECT model, dataset, row_id, round(reward, 6) AS reward FROM sc"))
def q_scoring_job(spark, sf_dir):
    """M4: reward of prompt + output (X8), batches of 256."""
    return _scores(spark, sf_dir).select("model", "dataset", "row_id", r6("reward").alias("reward"))


@query("eval_chain_job", _jobs_sql("""
SELECT g.task_idx, g.task, g.model, g.eval_idx, g.eval_task, round(a.avg_reward, 6) AS avg_reward
FROM grid g LEFT JOIN av2 a ON a.model = g.model AND a.dataset = g.eval_dataset"""))
def q_eval_chain_job(spark, sf_dir):
    """§3.3 as one job: generate -> score -> normalise -> average -> continual matrix."""
    grid = evaluation.continual_grid(_tasks(spark))
    m = evaluation.continual_matrix(grid, evaluation.avg_normalized_reward(_scores(spark, sf_dir)))
    return m.withColumn("avg_reward", r6("avg_reward"))


@query("grid_increment", ORACLE["eval_chain_job"])
def q_grid_increment(spark, sf_dir):
    """S7 + J4 + M3 + M4: the matrix of the first four tasks, then of all: only the fifth's cells are computed then."""
    state, tasks, prompts = scratch_path(spark, "grid"), _tasks(spark), _eval_prompts(spark, sf_dir)
    grid_state.refresh(tasks.where(F.col("idx") < fx.N_TASKS - 1), prompts, state)
    m = grid_state.refresh(tasks, prompts, state)
    return m.withColumn("avg_reward", r6("avg_reward"))


def _md5_tokenizer():
    import hashlib as _h

    def encode(texts):
        return [[int(_h.md5(w.encode("utf-8")).hexdigest()[:8], 16) % 32000 for w in t.split()] for t in texts]
    return encode


@query("tokenize_backend", ORACLE["tokenize_ws"])
def q_tokenize_backend(spark, sf_dir):
    """M5 through mapInPandas with a Python tokenizer factory (same ids as the built-in one)."""
    tok = tokenize.tokenize(read_table(spark, sf_dir, "documents"), "text", keys=["doc_id"], tokenizer=_md5_tokenizer)
    return tok.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"))


REWARD_FEATURES, REWARD_REG, SQL_STEPS = 16, 0.01, 1500


def _reward_model_sql() -> str:
    """The same optimum by plain gradient descent (the loss is smooth with a constant of at most 0.51)."""
    each = range(1, REWARD_FEATURES + 1)
    moved = ", ".join(f"any_value(w)[{f}] - 1.5 * (sum(c * d[{f}]) / count(*) + {REWARD_REG} * any_value(w)[{f}])" for f in each)
    share = lambda column: f"""
  SELECT r, feature, count(*)::DOUBLE / any_value(n) AS v FROM (
    SELECT r, {sql_unit32("md5(w)")} % {REWARD_FEATURES} AS feature, count(*) OVER (PARTITION BY r) AS n
    FROM (SELECT r, unnest(regexp_extract_all({column}, '\\S+')) AS w FROM p)) GROUP BY r, feature"""  # noqa: E731
    return fx.with_sql(["pairs"], f"""
, p AS MATERIALIZED (SELECT row_number() OVER () AS r, response_1, response_2 FROM pairs)
, c AS ({share("response_1")})
, j AS ({share("response_2")})
, x AS MATERIALIZED (
  SELECT r, list(v ORDER BY feature) AS d FROM (
    SELECT g.r, g.feature, coalesce(c.v, 0) - coalesce(j.v, 0) AS v
    FROM (SELECT r, feature FROM p, range({REWARD_FEATURES}) AS f(feature)) g
    LEFT JOIN c ON c.r = g.r AND c.feature = g.feature LEFT JOIN j ON j.r = g.r AND j.feature = g.feature) GROUP BY r)
, it AS (
  SELECT 0 AS k, list_transform(range({REWARD_FEATURES}), lambda i: 0::DOUBLE) AS w
  UNION ALL
  SELECT any_value(k) + 1, [{moved}] FROM (
    SELECT it.k, it.w, x.d, -1 / (1 + exp(list_dot_product(it.w, x.d))) AS c FROM it, x WHERE it.k < {SQL_STEPS}) GROUP BY k)
, m AS (SELECT list_dot_product(w, d) AS m, w FROM x, (SELECT w FROM it WHERE k = {SQL_STEPS}))
SELECT count(*) AS n_pairs, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS accuracy,
       round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))) + {REWARD_REG / 2} * any_value(list_dot_product(w, w)), 6) AS loss,
       round(sqrt(any_value(list_dot_product(w, w))), 4) AS weight_norm, true AS optimal FROM m""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("pairwise_reward_model", _reward_model_sql())
def q_pairwise_reward_model(spark, sf_dir):
    """M6: Bradley-Terry linear reward model over hashed words, fitted to its one optimum; pairwise accuracy, and the
    optimality condition."""
    pairs = fx.pairs(spark, sf_dir).select(F.col("response_1").alias("chosen"), F.col("response_2").alias("rejected"))
    model = reward_model.fit_hashed_reward(pairs, num_features=REWARD_FEATURES, reg=REWARD_REG)
    report = reward_model.fit_report(model, pairs)
    return report.withColumn("loss", r6("loss")).withColumn("weight_norm", F.round("weight_norm", 4))


@query("stream_ingest", fx.with_sql(["pairs"], f"""
SELECT conv_id, turn, prompt, {sql_strip("response_1")} AS chosen, {sql_strip("response_2")} AS rejected FROM pairs"""))
def q_stream_ingest(spark, sf_dir):
    """Drop files -> Structured Streaming (availableNow, checkpointed) -> cleaned Parquet."""
    drop = scratch_path(spark, "drop")
    out = scratch_path(spark, "ingested")
    ckpt = scratch_path(spark, "ingest-ckpt")
    writers.write_preferences(_labelled_pairs(spark, sf_dir), drop)
    ingest_preferences_stream(spark, drop, out, ckpt, schema=KEYED_SCHEMA, keep=("conv_id", "turn"))
    return spark.read.parquet(out).select("conv_id", "turn", "prompt", "chosen", "rejected")


@query("judged_stream", ORACLE["judge_job"].replace(
    "SELECT conv_id, turn, constitution_id, prompt, response_1, response_2, generated_text,", f"""
, h AS (SELECT *, {sql_unit32(sql_hash("42", "conv_id", "turn"))} < {FLIP_RATIO}::DOUBLE * 4294967296 AS flipped,
               {sql_strip("response_1")} AS s1, {sql_strip("response_2")} AS s2 FROM a)
SELECT conv_id, turn, constitution_id, prompt, CASE WHEN flipped THEN s2 ELSE s1 END AS chosen,
       CASE WHEN flipped THEN s1 ELSE s2 END AS rejected, flipped, generated_text,""").replace("END AS preference FROM a", "END AS preference FROM h"))
def q_judged_stream(spark, sf_dir):
    """T1 + M1 + G2: pairs dropped as files, judged as they arrive with a ledger, cleaned and flipped by hash."""
    drop, out, ckpt, ledger = (scratch_path(spark, n) for n in ("drop", "judged", "judge-ckpt", "judge-ledger"))
    writers.write_csv(fx.pairs_with_constitution(spark, sf_dir), drop)
    judge_stream(spark, drop, fx.constitutions(spark, sf_dir), out, ckpt, ledger,
                 schema="constitution_id long, " + KEYED_SCHEMA, flip_ratio=FLIP_RATIO, flip_key=("conv_id", "turn"),
                 keep=("conv_id", "turn", "constitution_id"))
    return spark.read.parquet(out).drop("batch", "source_file")
