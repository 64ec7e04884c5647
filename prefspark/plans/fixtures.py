"""Tables of the reference's shapes derived from the driver's tables (see FIXTURES.md, part B).

Every fixture has a Spark builder and the same definition as a DuckDB CTE (``SQL``), used by the
oracle queries. Builders only use equi joins, joins with bounded dimensions and narrow projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.text import hash_hex, hash_unit32, words
from prefspark.sources.tables import read_table

N_TASKS = 5
SCORE_WIDTH = 6  # embedding elements per model score
EOS_ID = 7
PAD_ID = 0


def task_config(n_tasks: int = N_TASKS) -> list[dict]:
    """Continual-learning configuration of the reference's shape: two models per task."""
    return [
        {"idx": i, "name": f"Constitution {i + 1}", "dataset": f"constitution_{i + 1}",
         "test_split": "test", "models": [f"DPO-{i + 1}", f"PPO-{i + 1}"],
         "reward_model": f"reward-{i + 1}"}
        for i in range(n_tasks)
    ]


# --------------------------------------------------------------------------------- Spark side

def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, prompt, response_1, response_2): a user turn (c, t), the assistant's answer
    (c, t+1), and the answer (c+1, t+1) to the user turn (c+1, t) of the next conversation.
    Unique key (conv_id, turn).

    Plan: one scan, one shuffle. Every turn emits the (at most two) pair cells it belongs to -
    a user turn is the prompt of (c, t) and the partner question of (c-1, t); an answer is
    response_1 of (c, t-1) and response_2 of (c-1, t-1) - and one aggregation per cell (at most
    four rows, so no key can be hot) keeps the cells that have all four parts.
    """
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    c, t, txt = F.col("conv_id"), F.col("turn"), F.col("text")
    part = lambda cid, turn, tag, text: F.struct(cid.alias("c"), turn.alias("t"), F.lit(tag).alias("tag"),
                                                 text.alias("text"))
    user = F.array(part(c, t, "prompt", txt), part(c - 1, t, "question_2", F.lit(None).cast("string")))
    answer = F.array(part(c, t - 1, "response_1", txt), part(c - 1, t - 1, "response_2", txt))
    cells = conv.select(F.explode(F.when(F.col("role") == "user", user).otherwise(answer)).alias("x")).select("x.*")
    has = lambda tag: F.max(F.col("tag") == tag)
    text_of = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("text")))
    grouped = cells.groupBy("c", "t").agg(
        has("prompt").alias("_p"), has("response_1").alias("_r1"), has("question_2").alias("_q2"),
        has("response_2").alias("_r2"), text_of("prompt").alias("prompt"),
        text_of("response_1").alias("response_1"), text_of("response_2").alias("response_2"))
    return (grouped.where(F.col("_p") & F.col("_r1") & F.col("_q2") & F.col("_r2"))
                   .select(F.col("c").alias("conv_id"), F.col("t").alias("turn"), "prompt", "response_1", "response_2"))


def constitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(constitution_id, text): every benchmark item serves as one constitution."""
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("constitution_id"), "text")


def pairs_with_constitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs + constitution_id = conv_id mod (number of constitutions)."""
    n = constitutions(spark, sf_dir).count()
    return pairs(spark, sf_dir).withColumn("constitution_id", F.pmod(F.col("conv_id"), F.lit(n)))


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, answer): judge answers made from ids (the texts hold no digits)."""
    docs = read_table(spark, sf_dir, "documents", text=False).select("doc_id")
    m = F.pmod(F.col("doc_id"), F.lit(6))
    answer = (F.when(m == 0, "0").when(m == 1, " 1.").when(m == 2, "Response 1")
               .when(m == 3, "01").when(m == 4, "none").otherwise(F.lit(None).cast("string")))
    return docs.select("doc_id", answer.alias("answer"))


def labelled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.concat(F.lit("Response 1: "), F.col("text"), F.lit(" Response 1:")).alias("answer"))


def models_df(spark: SparkSession, n_tasks: int = N_TASKS) -> DataFrame:
    """(m, model, task_idx): model m belongs to task m div 2."""
    rows = [(2 * t + j, name, t) for t, cfg in enumerate(task_config(n_tasks)) for j, name in enumerate(cfg["models"])]
    return spark.createDataFrame(rows, "m int, model string, task_idx int")


def scores(spark: SparkSession, sf_dir: str, n_tasks: int = N_TASKS) -> DataFrame:
    """(model, dataset, row_id, reward): model m scores vector v with the mean of its 6 elements from
    position 6m+1; dataset j = label mod 5; kept where j <= task of m. Model 9 / dataset 4 is left out
    on purpose (a missing output)."""
    emb = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.pmod(F.col("label"), F.lit(n_tasks)).alias("j"))
    models = models_df(spark, n_tasks)  # bounded by the configuration
    part = F.slice("embedding", F.col("m") * SCORE_WIDTH + 1, F.lit(SCORE_WIDTH))
    reward = F.aggregate(part, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")) / F.lit(float(SCORE_WIDTH))
    joined = emb.join(F.broadcast(models), F.col("j") <= F.col("task_idx"))
    return (joined.where(~((F.col("m") == 2 * n_tasks - 1) & (F.col("j") == n_tasks - 1)))
                  .select("model", F.concat(F.lit("constitution_"), (F.col("j") + 1).cast("string")).alias("dataset"),
                          F.col("vec_id").alias("row_id"), reward.alias("reward")))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, logits): the 64-vector as 8 tokens x 8 vocabulary values (double)."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)),
                       lambda t: F.transform(F.slice("embedding", t * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    return emb.select("vec_id", rows.alias("logits"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, ids): ids = lengths of the words of the whole text; EOS id 7, pad id 0."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return docs.select("doc_id", "n_chars", F.transform(words("text"), lambda w: F.length(w)).alias("ids"))


def reward_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_discount") * 10).alias("r_chosen"), (F.col("l_tax") * 10).alias("r_rejected"))


def dpo_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.select((-q / 10).alias("pi_chosen"), (-q / 8).alias("pi_rejected"),
                     (-q / 9 - F.col("l_tax")).alias("ref_chosen"),
                     (-q / 9 - F.col("l_discount")).alias("ref_rejected"))


def generated_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, run, raw): generator-style JSON ``{"row": [...]}`` with the pairs of a run
    (run = turn div 4, so at most two pairs per document); about one in ten is cut short."""
    p = pairs(spark, sf_dir).withColumn("run", F.floor(F.col("turn") / 4).cast("long"))
    docs = (p.groupBy("conv_id", "run")
             .agg(F.array_sort(F.collect_list(F.struct("turn", "prompt", "response_1", "response_2"))).alias("rs")))
    rows = F.transform("rs", lambda x: F.struct(x["prompt"].alias("prompt"), x["response_1"].alias("response_1"),
                                               x["response_2"].alias("response_2")))
    raw = F.to_json(F.struct(rows.alias("row")))
    broken = hash_unit32(hash_hex("json", "conv_id", "run")) < F.lit(429496729)
    return docs.select("conv_id", "run",
                       F.when(broken, raw.substr(F.lit(1), F.length(raw) - 2)).otherwise(raw).alias("raw"))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + split: 'test' for about one in ten documents (hash of doc_id), else 'train'."""
    docs = read_table(spark, sf_dir, "documents")
    test = hash_unit32(hash_hex("split", "doc_id")) < F.lit(429496729)
    return docs.withColumn("split", F.when(test, "test").otherwise("train"))


# --------------------------------------------------------------------------------- SQL side

def _models_values(n_tasks: int = N_TASKS) -> str:
    rows = [f"({2 * t + j}, '{name}', {t})" for t, cfg in enumerate(task_config(n_tasks))
            for j, name in enumerate(cfg["models"])]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(m, model, task_idx)"


def _tasks_values(n_tasks: int = N_TASKS) -> str:
    rows = [f"({c['idx']}, '{c['name']}', '{c['dataset']}', '{c['models'][0]}', '{c['models'][1]}')"
            for c in task_config(n_tasks)]
    return ("SELECT * FROM (VALUES " + ", ".join(rows)
            + ") AS t(idx, name, dataset, model_a, model_b)")


SQL = {
    "qa": """SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'""",
    "pairs": """SELECT x.conv_id, x.turn, x.prompt, x.answer AS response_1, y.answer AS response_2
  FROM qa x JOIN qa y ON y.conv_id = x.conv_id + 1 AND y.turn = x.turn""",
    "constitutions": "SELECT item_id AS constitution_id, text FROM benchmark",
    "cpairs": """SELECT p.*, p.conv_id % (SELECT count(*) FROM benchmark) AS constitution_id FROM pairs p""",
    "raw_answers": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '0' WHEN 1 THEN ' 1.' WHEN 2 THEN 'Response 1'
  WHEN 3 THEN '01' WHEN 4 THEN 'none' ELSE NULL END AS answer FROM documents""",
    "labelled": "SELECT doc_id, concat('Response 1: ', text, ' Response 1:') AS answer FROM documents",
    "models": _models_values(),
    "tasks": _tasks_values(),
    "scores": f"""SELECT mo.model, 'constitution_' || CAST(e.label % {N_TASKS} + 1 AS VARCHAR) AS dataset,
  e.vec_id AS row_id,
  list_sum(list_transform(e.embedding[mo.m * {SCORE_WIDTH} + 1 : mo.m * {SCORE_WIDTH} + {SCORE_WIDTH}],
                          lambda x: CAST(x AS DOUBLE))) / {SCORE_WIDTH}.0 AS reward
  FROM embeddings e JOIN models mo ON e.label % {N_TASKS} <= mo.task_idx
  WHERE NOT (mo.m = {2 * N_TASKS - 1} AND e.label % {N_TASKS} = {N_TASKS - 1})""",
    "logits": """SELECT vec_id, list_transform(range(0, 8),
    lambda t: list_transform(embedding[t * 8 + 1 : t * 8 + 8], lambda x: CAST(x AS DOUBLE))) AS logits
  FROM embeddings""",
    "token_ids": """SELECT doc_id, n_chars,
  list_transform(regexp_extract_all(text, '\\S+'), lambda w: CAST(length(w) AS INTEGER)) AS ids FROM documents""",
    "reward_pairs": "SELECT l_discount * 10 AS r_chosen, l_tax * 10 AS r_rejected FROM lineitem",
    "dpo": """SELECT -l_quantity / 10 AS pi_chosen, -l_quantity / 8 AS pi_rejected,
  -l_quantity / 9 - l_tax AS ref_chosen, -l_quantity / 9 - l_discount AS ref_rejected FROM lineitem""",
    "split_docs": """SELECT *, CASE WHEN CAST('0x' || substr(md5('split:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)
  < 429496729 THEN 'test' ELSE 'train' END AS split FROM documents""",
}

# Which CTEs each CTE needs (in order).
DEPENDS = {
    "pairs": ["qa"], "cpairs": ["qa", "pairs"], "scores": ["models"],
}


def with_sql(names: list[str], body: str) -> str:
    """``WITH`` clause holding the named fixtures (and what they depend on), then ``body``."""
    order: list[str] = []
    for n in names:
        for dep in DEPENDS.get(n, []) + [n]:
            if dep not in order:
                order.append(dep)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{SQL[n]}\n)" for n in order) + "\n" + body
