"""Importance resampling towards a target collection of texts.

Words are runs of ASCII letters and digits and of characters beyond ASCII, after lower-casing A-Z. Features
are all runs of 1 to ``max_run`` words; a feature falls into one of ``buckets`` by its crc32. Two
histograms of a fixed size (corpus and target) give one integer gain a bucket, an array that
every task scores its texts with: ``weight`` is the floored mean of the gains over a text's features. ``score``
adds Gumbel noise from a hash of the id, so the highest scores are a draw without replacement with
probabilities that follow the weights.

The scores are written once. The score of the last drawn row is found by bisecting the range of scores:
every step is one exact count over the written column. Ties at that score go to smaller ids, whose
limit is bisected in the same way. Only the rows up to both limits are then range-partitioned and sorted;
a row's rank is its place in its partition and the rows in those before. Nothing but counts comes to the
driver, and no group of equal scores or ids is ever in one task.

Null and empty texts, and texts without words, have no features and weight 0; they are not drawn. A null id
counts as the empty text in the hash, and comes last among ties. Rows that share an id share its noise; among rows of
equal score and id that are cut by the limit, those with fewer features come first, then those stored first.
No documents, or none long enough: nothing is drawn. An empty target is like one that holds no word.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import prepare, save, text_or_empty

# a byte of a word, lower-cased if it is one of A-Z, or a blank
WORD_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 32
                   for b in bytes(range(256)).lower())
BUCKETS, MAX_RUN = 10_000, 1
PERCENT, MIN_WORDS, SEED = 10, 20, 2024
KNOWN_FEATURES = 200_000  # buckets of features that a task remembers at a time
HALVINGS = 3  # of a range by one count job
STATS = ("n_words", "n_features", "weight", "score", "rank")
_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | place


class _Buckets(dict):
    """The bucket of each feature looked up; remembers them."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


class Features:
    """The number of words of a text and the bucket of each of its features."""

    def __init__(self, buckets: int = BUCKETS, max_run: int = MAX_RUN):
        self.buckets, self.max_run, self.known = buckets, max_run, _Buckets(buckets)

    def of(self, text: str) -> tuple[int, np.ndarray]:
        words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        features = words
        for n in range(2, self.max_run + 1):
            features = features + [b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)]
        found = np.fromiter(map(self.known.__getitem__, features), np.int64, len(features))
        if len(self.known) > KNOWN_FEATURES:
            self.known.clear()
        return len(words), found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """How many features of all ``text`` values are in each bucket."""
    def count(frames):
        features, total = Features(buckets, max_run), np.zeros(buckets, np.int64)
        for pdf in frames:
            for text in pdf["text"]:
                total += np.bincount(features.of(text_or_empty(text))[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    prepare(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    rows = (texts.select("text").mapInPandas(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most ``buckets`` rows
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier a bucket is in the target, smoothed, floored."""
    size, aim, n = float(corpus.sum() + len(corpus)), float(target.sum() + len(target)), len(corpus)
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * size / ((float(corpus[b]) + 1) * aim)))
                     for b in range(n)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise, 1000 times and floored, from a hash of the id."""
    name = "" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(batches, gain: np.ndarray, max_run: int, seed: int):
    """Columns ``id``, ``text`` and others: the others, then the id and the numbers of each row."""
    features = Features(len(gain), max_run)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        numbers = []
        for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
            words, at = features.of(text or "")
            weight = int(gain[at].sum()) // len(at) if len(at) else 0
            numbers.append((words, len(at), weight, weight + noise(doc_id, seed)))
        columns = [pa.array([r[k] for r in numbers], pa.int64()) for k in range(4)]
        names = [f.name for f in batch.schema]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), *columns],
                                         names=[*names[2:], names[0], "n_words", "n_features", "weight", "score"])


def score(docs: DataFrame, target: DataFrame, keep: Sequence[str] = (), buckets: int = BUCKETS,
          max_run: int = MAX_RUN, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: the columns ``keep`` as ``c0``, ``c1``, .., ``id`` and the numbers."""
    gain = gains(bucket_counts(docs, buckets, max_run), bucket_counts(target, buckets, max_run))
    kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col("text"), *kept)
    fields = [*[f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)],
              f"id {docs.schema[id_col].dataType.simpleString()}",
              "n_words long", "n_features long", "weight long", "score long"]
    prepare(docs.sparkSession)
    return rows.mapInArrow(lambda it: _scored(it, gain, max_run, seed), ", ".join(fields))


def _least(counts, k: int, low: int, high: int) -> int:
    """The least number in (low, high] whose count is at least ``k``, as that of ``high`` is. ``counts`` gives the
    counts of several numbers by one job: the middles of the next ``HALVINGS`` halvings."""
    while high - low > 1:
        steps = min(1 << HALVINGS, high - low)
        middles = [low + (high - low) * j // steps for j in range(1, steps)]
        held = [n >= k for n in counts(middles)]
        first = held.index(True) if True in held else len(middles)
        low, high = [low, *middles][first], [*middles, high][first]
    return high


def cutoff(rows: DataFrame, k: int) -> tuple[int, int | None]:
    """The score of the ``k``-th row by (score descending, id) and the largest id drawn at that score, by
    bisection with exact counts; no id means that rows without one are reached. ``rows`` holds ``k`` or more."""
    def counts(conditions) -> list[int]:
        return list(rows.agg(*[F.count_if(c) for c in conditions]).first())

    low, high = rows.agg(F.min("score"), F.max("score")).first()
    at = -_least(lambda tried: counts([F.col("score") >= -s for s in tried]), k, -high - 1, -low)
    left = k - counts([F.col("score") > at])[0]
    tied = F.col("score") == at
    first, last, named = rows.where(tied).agg(F.min("id"), F.max("id"), F.count("id")).first()
    if named < left:
        return at, None
    return at, _least(lambda tried: counts([tied & (F.col("id") <= d) for d in tried]), left, first - 1, last)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rank`` from 1 by (score descending, id, fewer features, stored first); beyond ``k`` it is null."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("stored")]
    sorted_rows = save(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "resample-drawn")
    part = F.shiftright("at", _LOCAL_BITS)
    held = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << _LOCAL_BITS) - 1) + 1
    return (sorted_rows.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("rank", F.when(place <= k, place)).drop("part", "before", "at"))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, .. for the drawn rows, null for the others."""
    rows = save(scored.withColumn("stored", F.monotonically_increasing_id()), "resample-scores")
    long_enough = rows.where(F.col("n_words") >= min_words)
    k = long_enough.count() * percent // 100
    undrawn = F.lit(None).cast("long")
    if not k:
        return rows.withColumn("rank", undrawn).drop("stored")
    at, last = cutoff(long_enough, k)
    tied = F.lit(True) if last is None else F.coalesce(F.col("id") <= last, F.lit(False))
    inside = (F.col("n_words") >= min_words) & ((F.col("score") > at) | ((F.col("score") == at) & tied))
    return (_ranked(rows.where(inside), k).unionByName(rows.where(~inside).withColumn("rank", undrawn))
            .drop("stored"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             keep: Sequence[str] = ("doc_id",), buckets: int = BUCKETS, max_run: int = MAX_RUN,
             seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (all of them: ``docs.columns``), with ``n_words``, ``n_features``,
    ``weight``, ``score`` and ``rank``. Kept columns of these names come back with ``_doc`` behind their name."""
    drawn = draw(score(docs, target, keep, buckets, max_run, seed, id_col), percent, min_words)
    names = []
    for c in keep:
        while c.lower() in STATS or c in names:
            c += "_doc"
        names.append(c)
    return drawn.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *STATS)
