"""Language identification by compression.

Each learned language has a raw-content zstandard dictionary of its training text. A text is
compressed in segments with every dictionary; the language whose dictionary gives the fewest bytes
wins. Letters are what is compared: the text is lower-cased and everything but letters, and marks that
follow them, becomes one blank. Where the best two are closer than ``MIN_MARGIN`` the prediction is rejected (``reliable``
false); the best language stays visible.

Null texts and texts without a letter: ``und``, score 0, not reliable. Equal sizes go to the
language with more training rows, then to the smaller name. Without training rows every text is
``und``. Rows are independent: repeated rows get equal results; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import held_out, prepare, text_or_empty

DOCS_PER_LANGUAGE = 400  # training ids taken per language, about, by a hash
DICT_BYTES = 48 * 1024  # dictionary size per language
EXCERPT_BYTES = DICT_BYTES // 8  # of one text, at most
SEGMENT_CHARS = 3000
LEVEL = 12
MIN_MARGIN = 0.02  # of the best size
SCHEMA = ("doc_id long, held_out boolean, lang_pred string, score double, reliable boolean")
# whatever is neither a letter nor a mark, and marks without a letter before them; numbers are no letters
NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+(?:\p{M}+[^\p{L}\p{M}]+)*\p{M}*|\A\p{M}+")


NO_ASCII_LETTER = re.compile("[^A-Za-z]+")  # the same for ASCII texts, in half the time


def letters(text: str) -> str:
    return (NO_ASCII_LETTER if text.isascii() else NO_LETTER).sub(" ", text).strip().lower()


def train(docs: DataFrame) -> dict[str, tuple[int, bytes]]:
    """language -> (training rows, dictionary content), learned from rows that are not held out and
    have a letter. Excerpts of about ``DOCS_PER_LANGUAGE`` texts of each language pass the driver; every
    language with a training row gets a dictionary."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    per_id = usable.groupBy("lang", "doc_id").agg(F.count("*").alias("n"))
    counts = {r["lang"]: (r["n"], r["ids"]) for r in
              per_id.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("ids")).collect()}
    # each language's share of hashes that gives about its number of ids: a filter, no ranking
    bounds = docs.sparkSession.createDataFrame(
        [(lang, min(1 << 30, DOCS_PER_LANGUAGE * (1 << 30) // ids)) for lang, (_, ids) in counts.items()],
        "lang string, bound long")
    chance = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1 << 30))
    # what letters() keeps, so that the start of a text without letters does not use up its excerpt
    kept = F.trim(F.regexp_replace("text", r"[^\p{L}\p{M}]+", " "))
    rows = (usable.select("lang", "doc_id", "text").join(F.broadcast(bounds), "lang").where(chance < F.col("bound"))
            .select("lang", "doc_id", F.substring(kept, 1, EXCERPT_BYTES).alias("text"))
            .groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # one text an id, however often it occurs
            .orderBy("lang", F.xxhash64("doc_id"), "text").toLocalIterator())
    content: dict[str, bytearray] = {}
    for row in rows:
        own = content.setdefault(row["lang"], bytearray())
        data = excerpt(letters(row["text"]), max(0, min(EXCERPT_BYTES, DICT_BYTES - 1 - len(own))))
        if data:
            own += data + b" "
    if missing := [lang for lang in counts if not content.get(lang)]:
        raise RuntimeError(f"no training text was sampled for {sorted(missing)[:20]}")
    return {lang: (counts[lang][0], bytes(data)) for lang, data in content.items()}


def excerpt(text: str, room: int) -> bytes:
    """The start of ``text`` in at most ``room`` bytes, without a cut character."""
    return text[:room].encode()[:room].decode(errors="ignore").encode()


@lru_cache(maxsize=2)
def _compressors(model: tuple):
    import zstandard as zstd

    out = []
    for lang, _, content in model:
        book = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=LEVEL)
        out.append((lang, zstd.ZstdCompressor(
            level=LEVEL, dict_data=book, write_checksum=False, write_content_size=False,
            write_dict_id=False).compress))
    return out


def sizes(text: str, compressors) -> list[int]:
    """Compressed bytes of ``text`` (letters only) with every language's dictionary."""
    total = [0] * len(compressors)
    for begin in range(0, len(text), SEGMENT_CHARS):
        data = text[begin:begin + SEGMENT_CHARS].encode()
        for k, (_, compress) in enumerate(compressors):
            total[k] += len(compress(data))
    return total


def classify(text: str, compressors) -> tuple[str, float, bool]:
    """(language, score, reliable)."""
    plain = letters(text)
    if not plain or not compressors:
        return "und", 0.0, False
    total = sizes(plain, compressors)
    order = sorted(range(len(total)), key=total.__getitem__)  # stable: ties keep the model's order
    best = total[order[0]]
    if len(order) == 1:
        return compressors[order[0]][0], 1.0, True
    margin = (total[order[1]] - best) / max(best, 1)
    return compressors[order[0]][0], 1.0 - 0.5 * math.exp(-10.0 * margin), margin >= MIN_MARGIN


def _rows(frames, model: tuple):
    compressors = _compressors(model)
    for pdf in frames:
        found = [classify(text_or_empty(t), compressors) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"],
                            "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
                            "reliable": [f[2] for f in found]})


def identify(docs: DataFrame, model: dict[str, tuple[int, bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, and lang for training)."""
    spark = docs.sparkSession
    prepare(spark)
    model = train(docs) if model is None else model
    ordered = tuple((lang, n, content) for lang, (n, content) in
                    sorted(model.items(), key=lambda m: (-m[1][0], m[0])))
    shared = spark.sparkContext.broadcast(ordered)  # DICT_BYTES for each language
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(
        lambda it: _rows(it, shared.value), SCHEMA)
