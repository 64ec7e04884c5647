"""Corpus pipeline: documents in, packed token sequences out.

Each stage takes all that its predecessor kept, as a written table, and calls one operator of
``prefspark.llm``: quality rules, line dedup, SimHash near-dedup, secret scan, packing. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import golay_simhash, line_minhash, mcd_quality, mixture_pack, secret_scan
from prefspark.llm.common import read_documents, save


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text; a null text keeps what was there."""
    if "n_chars" not in docs.columns:
        return docs
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.coalesce(count, F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others stay as they are."""
    return mcd_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of like lines stays; every document stays, with what is left."""
    return _counted(line_minhash.drop_repeated_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return golay_simhash.keep_first(docs, shingle_words=3, max_bits=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return _counted(secret_scan.redact_column(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences that mirror the corpus's mixture of sources."""
    return mixture_pack.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("secrets", secrets), ("packing", packing)]

# No SQL: estimates, signatures, the automaton and the tokenizer are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, f"pipeline-{name}")
    return docs
