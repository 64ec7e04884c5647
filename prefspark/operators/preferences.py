"""Preference tables: projections to the training schema, unnesting generated rows, dimension
lookups (constitution, domain) and the generation grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.templates import DOMAINS, RESPONSE_LABELS
from prefspark.functions.text import strip_label
from prefspark.plans.broadcast import small_side

GENERATED_FIELDS = ("prompt", "response_1", "response_2")
GENERATED_SCHEMA = "struct<row:array<struct<prompt:string,response_1:string,response_2:string>>>"


def to_chosen_rejected(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``response_1`` -> ``chosen``, ``response_2`` -> ``rejected`` (plus ``keep`` columns)."""
    return df.select(*keep, "prompt", F.col("response_1").alias("chosen"),
                     F.col("response_2").alias("rejected"))


def drop_columns(df: DataFrame, *names: str, strict: bool = False) -> DataFrame:
    """Drop columns; ``strict`` raises when one is absent (``df.drop`` ignores absent ones)."""
    if strict:
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} not in {df.columns}")
    return df.drop(*names)


def keep_only(df: DataFrame, *names: str) -> DataFrame:
    """Keep only the named columns (drop all others)."""
    return df.select(*names)


def strip_response_labels(df: DataFrame) -> DataFrame:
    """X1 on both responses: each column loses its own label ('Response 1:' / 'Response 2:')."""
    for column, label in RESPONSE_LABELS.items():
        df = df.withColumn(column, strip_label(column, label))
    return df


def parse_generated(df: DataFrame, raw: str = "raw", name: str = "parsed") -> DataFrame:
    """Structured generator output (JSON) -> typed struct. Malformed JSON gives a struct whose
    ``row`` is NULL (not a NULL struct)."""
    return df.withColumn(name, F.from_json(F.col(raw), GENERATED_SCHEMA, {"mode": "PERMISSIVE"}))


def explode_generated(df: DataFrame, raw: str = "raw", keep: Sequence[str] = ()):
    """P5: one row per generated data point, with its position ``row_no``.

    Returns ``(rows, rejects)``; ``rejects`` keeps the raw text of outputs that did not parse or
    do not have the required structure: a list of data points with three texts each.
    """
    parsed = parse_generated(df, raw)
    valid = F.coalesce(has_required_fields("parsed", raw), F.lit(False))
    rows = (parsed.where(valid).select(*keep, F.posexplode("parsed.row").alias("row_no", "r"))
                  .select(*keep, F.col("row_no").cast("int").alias("row_no"), "r.prompt",
                          "r.response_1", "r.response_2"))
    return rows, parsed.where(~valid).select(*keep, raw)


def has_required_fields(parsed: str, raw: str) -> F.Column:
    """Whether there are data points and each has all three fields, as texts (a number or an object
    is none)."""
    kinds = F.from_json(F.col(raw), "struct<row:array<map<string,variant>>>")["row"]
    text = lambda m, f: F.schema_of_variant(m[f]) == "STRING"
    complete = F.forall(kinds, lambda m: F.coalesce(reduce(and_, [text(m, f) for f in GENERATED_FIELDS]), F.lit(False)))
    return (F.size(f"{parsed}.row") > 0) & complete


def domains_df(spark: SparkSession) -> DataFrame:
    """The ten generation contexts as a dimension (context_id from 1)."""
    return spark.createDataFrame([(i + 1, d) for i, d in enumerate(DOMAINS)],
                                 "context_id int, domain string")


def with_domain(df: DataFrame, context_col: str = "context_id") -> DataFrame:
    """Context index -> domain name; an index out of range gives NULL (left join)."""
    dom = domains_df(df.sparkSession).withColumnRenamed("context_id", "_ctx")
    return (df.join(F.broadcast(dom), F.col(context_col) == F.col("_ctx"), "left").drop("_ctx"))


def with_constitution(df: DataFrame, constitutions: DataFrame, key: str = "constitution_id",
                      text_col: str = "constitution") -> DataFrame:
    """Attach the constitution text to each row (equi join; broadcast when the dimension is small).
    A row whose constitution is absent stays, with a NULL text."""
    dim = constitutions.select(F.col(key).alias("_cid"), F.col("text").alias(text_col))
    return df.join(small_side(dim), F.col(key) == F.col("_cid"), "left").drop("_cid")


def generation_keys(constitutions: DataFrame, runs: int = 200, n_contexts: int = len(DOMAINS)) -> DataFrame:
    """The keys of J7: (constitution_id, context_id, run_id), three numbers a cell. Cells are made by
    unnesting one sequence per constitution, no text is multiplied."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(n_contexts * runs - 1))).alias("_cell")
    return (constitutions.where(F.lit(n_contexts * runs) > 0).select("constitution_id", cell)
            .select("constitution_id", (F.floor(F.col("_cell") / runs) + 1).cast("int").alias("context_id"),
                    F.pmod("_cell", F.lit(runs)).cast("int").alias("run_id")))


def generation_grid(constitutions: DataFrame, runs: int = 200, n_contexts: int = len(DOMAINS)) -> DataFrame:
    """One generation task per (constitution, context, run), with the texts of both."""
    texts = constitutions.select(F.col("constitution_id").alias("_cid"), "text")
    keys = generation_keys(constitutions, runs, n_contexts)
    return with_domain(keys.join(small_side(texts), F.col("constitution_id") == F.col("_cid")).drop("_cid"))
