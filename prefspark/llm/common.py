"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.session import scratch_path, ship_package

HELD_OUT_MOD, HELD_OUT_REST = 4, 2
FILE_ROWS_BITS = 40  # of a row's number: its place in its file
PLACE_FILTER_BITS = 1 << 25  # 4 MB


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def save(df: DataFrame, name: str, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read it back: cuts the
    lineage and survives the loss of executors. ``path``: a ``scratch_path`` to use, for ``remove``."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``save`` wrote to ``path``, once nothing reads it any more."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:  # a session without a JVM of its own: the table stays in the scratch folder
        return
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def placed_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long column that tells its rows apart, and that column's name: the number of a
    row's file, by path, and its row in it. Unlike ids of partitions, these stay the same in every
    scan, however the files are split. ``docs`` must be the read of Parquet files."""
    own = "__row"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    path, place = f"{own}path", f"{own}file"
    meta = docs.metadataColumn("_metadata")
    files = sorted(r[0] for r in docs.select(meta["file_path"]).distinct().collect())
    numbers = docs.sparkSession.createDataFrame(
        [(name, k << FILE_ROWS_BITS) for k, name in enumerate(files)], f"{path} string, {place} long")
    found = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(own))
    return found.join(F.broadcast(numbers), path).select(
        *[F.col(f"`{c}`") for c in docs.columns], (F.col(place) + F.col(own)).alias(own)), own


class Tables:
    """Scratch tables of one job by name, each deleted once its last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = scratch_path(self.spark, name)
        return save(df, name, path=self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))


def split_by_filter(rows: DataFrame, own: str, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose number ``own`` may be among ``values`` (column ``own``), and those for which it
    is certainly not. The test is a bit filter of ``PLACE_FILTER_BITS`` bits, whatever the input: what is certain
    needs no exchange, and the few that are not can be joined exactly."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACE_FILTER_BITS)) + 1  # noqa: E731  (buckets count from 1)
    bucket, bits = f"{own}bucket", f"{own}bits"
    filled = save(values.select(F.bitmap_bucket_number(slot(own)).alias(bucket), F.bitmap_bit_position(slot(own)).alias("at"))
                  .groupBy(bucket).agg(F.bitmap_construct_agg("at").alias(bits)), "filter")
    at = F.bitmap_bit_position(slot(own))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    tested = rows.withColumn(bucket, F.bitmap_bucket_number(slot(own))).join(F.broadcast(filled), bucket, "left")
    maybe = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return tested.where(maybe).drop(bucket, bits), tested.where(~maybe).drop(bucket, bits)


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the Python workers."""
    ship_package(spark)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")),
                  F.lit(HELD_OUT_MOD)) == HELD_OUT_REST


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows (all, if there are fewer), chosen by a hash of ``key``: deterministic,
    one count and one filter, no sort. For fitting models only."""
    n = df.count()
    if n <= bound:
        return df
    share = int(bound / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 30)) < share)


def text_or_empty(value) -> str:
    """A cell of a text column: null (None or NaN) becomes the empty string."""
    return value if isinstance(value, str) else ""


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))
