"""Small fixtures for the training-data operators."""

from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

# Columns whose names the operators also use.
CLASHES = ("row", "line", "lid", "fp", "component_id", "key", "n", "a", "b", "kept", "distance", "vector",
           "grp", "__row", "d", "queue", "part", "window", "ids", "spans", "held_out", "root", "gone")


def frame(spark, rows, extra: bool = False, partitions: int = 3):
    """documents from (doc_id, text, lang, source); with ``extra`` also clashing columns."""
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    df = spark.createDataFrame(full, DOCS).repartition(partitions)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    return df


def written(spark, tmp_path, df, name: str = "docs"):
    path = str(tmp_path / f"{name}.parquet")
    df.write.parquet(path)
    return spark.read.parquet(path)


ODD_ROWS = [(1, None, None, None), (2, "", "en", "s"), (3, "   \n\t ", "en", None), (None, "a b c", None, "s"),
            (4, "same text here for you", "en", "s"), (4, "same text here for you", "en", "s"),
            (5, "x" * 200_000, "en", "s"), (6, "word " * 40_000, "de", "t"), (7, "日本語 テキスト", "ja", "t"),
            (8, "\x00 null byte", "en", "t")]
