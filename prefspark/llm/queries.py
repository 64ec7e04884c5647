"""The operators as registered queries over whole tables, with production parameters."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import (chunked_bpe, crf_pii, golay_simhash, html_text, line_minhash, mcd_quality,
                           mixture_pack, nnpu_toxicity, secret_scan, srs_ann, target_resample, vector_codes,
                           zstd_langid)
from prefspark.llm.common import read_documents
from prefspark.llm.oracles import OP11_SQL, OP13_SQL


def op1_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_pii.scan_pii(read_documents(spark, sf_dir)).drop("masked")


def op2_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_documents(spark, sf_dir)).drop("redacted")


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return nnpu_toxicity.score(read_documents(spark, sf_dir), labels)


def op4_srs_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return srs_ann.nearest(vectors, F.col("vec_id") % 100 == 0, 10)


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encode_documents(read_documents(spark, sf_dir))


def op6_mixture_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(frames):
        for pdf in frames:
            sums = [zlib.crc32(ids) for ids in pdf.pop("ids")]
            yield pdf.assign(ids_crc32=pd.Series(sums, index=pdf.index, dtype="int64"))

    pieces = mixture_pack.pack(read_documents(spark, sf_dir))
    return pieces.mapInPandas(digest, "doc_id long, start long, length long, ids_crc32 long, "
                                      "doc_tokens long, sequence_id long, offset long, "
                                      "window long, source string")


def op7_zstd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_langid.identify(read_documents(spark, sf_dir))


def op8_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_minhash.dedup(read_documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), "text")


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_simhash.near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op10_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd_quality.judge(read_documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded, codebooks = vector_codes.learn(vectors, label_col="label")
    columns = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if coded is None:
        return spark.createDataFrame([], columns)
    return vector_codes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.lit(vector_codes.codebook_digest(codebooks)).alias("codebooks_sha256"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return target_resample.resample(read_documents(spark, sf_dir), target).drop("n_words")


QUERIES = {f.__name__: f for f in (
    op1_crf_pii, op2_secret_automaton, op3_nnpu_toxicity, op4_srs_ann, op5_chunked_bpe, op6_mixture_pack,
    op7_zstd_langid, op8_line_minhash, op9_golay_simhash, op10_mcd_quality, op11_vector_codes,
    op12_html_text, op13_target_resample)}
ORACLE: dict[str, str] = {"op11_vector_codes": OP11_SQL, "op13_target_resample": OP13_SQL}
