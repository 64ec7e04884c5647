"""M5: pre-tokenisation. Default: a built-in whitespace tokenizer as a JVM expression
(token id = first 32 bits of md5(word) mod vocabulary size). A custom tokenizer runs
partition-wise through ``mapInPandas`` on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from prefspark.functions._util import as_col
from prefspark.functions.text import hash_unit32, words
from prefspark.session import ship_package

DEFAULT_VOCAB = 32_000


def whitespace_token_ids(text, vocab_size: int = DEFAULT_VOCAB) -> Column:
    """Token ids of the whole text: one id per white-space separated word."""
    return F.transform(words(as_col(text)),
                       lambda w: F.pmod(hash_unit32(F.md5(w)), F.lit(vocab_size)).cast("int"))


def tokenize(df: DataFrame, text_col: str, keys: Sequence[str] = (), vocab_size: int = DEFAULT_VOCAB,
             tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]] | None = None) -> DataFrame:
    """Drop all source columns except ``keys`` and add ``input_ids`` (array<int>).

    ``tokenizer`` is a *factory*: it is called once per partition inside the worker and returns a
    function from a list of texts to a list of id lists (same length). A NULL text is not sent to it and
    keeps NULL ids, as with the built-in tokenizer.
    """
    if tokenizer is None:
        return df.select(*keys, whitespace_token_ids(text_col, vocab_size).alias("input_ids"))

    ship_package(df.sparkSession)
    schema = StructType([*df.select(*keys).schema.fields, StructField("input_ids", ArrayType(IntegerType()))])

    def run(batches):
        encode = tokenizer()
        for pdf in batches:
            asked = pdf[text_col][pdf[text_col].notna()]
            ids = encode(asked.tolist()) if len(asked) else []
            if len(ids) != len(asked):
                raise ValueError("tokenizer returned a different number of rows")
            out = pdf[list(keys)].copy()
            found = pd.Series([list(map(int, x)) for x in ids], index=asked.index, dtype=object)
            out["input_ids"] = found.reindex(pdf.index).where(pdf[text_col].notna(), None)
            yield out

    return df.select(*keys, *([] if text_col in keys else [text_col])).mapInPandas(run, schema)
