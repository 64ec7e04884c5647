"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last filled up with zeros).
The binary Golay code splits all 23-bit words into balls of radius 3 around 4096 codewords, so a
segment decodes to one codeword index (12 bits) and an error pattern (known by its 11-bit
syndrome). Codewords within distance 4 (one to six of them) are a segment's nearby indices: two
segments that differ in one bit always share one, namely the first one's own codeword.

Pigeonhole: of at most two differing bits in three segments, some segment has none, and one can
be picked so that the segment after it (in a circle) has at most one. A key is therefore the whole
decoding of one segment with one nearby index of the next; each fingerprint has 3 to 18 keys,
and any two fingerprints that link share a key. Distances are then verified.

Only distinct fingerprints are compared. A key with many fingerprints is not compared pair by
pair: there every fingerprint is listed under itself and its 64 words one bit away; two
fingerprints differ in at most two bits exactly if they meet under some word, and all that meet
there are linked to one of them. A word has 65 fingerprints at most.

Null and empty texts and texts without words have fingerprint zero and are linked like any other.
Repeated rows are linked; a null doc_id gets a component but never names one unless its whole
component is null. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import placed_rows, prepare, save, split_by_filter, text_or_empty
from prefspark.llm.graph import components

SHINGLE_WORDS = 3
MAX_BITS = 2  # the keys' pigeonhole argument holds up to here
SEED = 42
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TO_LOWER = str.maketrans({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})
SMALL_KEY = 64  # keys with more fingerprints take the exact way of neighbouring words
HASH_BLOCK = 1 << 16

# Fixed value: generator polynomial of the (23, 12) Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    words = WORD.findall(text.translate(TO_LOWER))
    if not words:
        return 0
    n = max(len(words) - shingle_words + 1, 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for begin in range(0, n, HASH_BLOCK):
        shingles = [" ".join(words[k:k + shingle_words]) for k in range(begin, min(begin + HASH_BLOCK, n))]
        hashes = np.array([digest(s.encode("utf-8", "surrogatepass"), SEED) for s in shingles], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, keep: str = "doc_id") -> DataFrame:
    """(``keep``, fp): the fingerprint of each row's text as a signed long."""
    prepare(docs.sparkSession)
    kind = docs.schema[keep].dataType.simpleString()

    def rows(frames):
        for pdf in frames:
            fps = np.array([fingerprint(text_or_empty(t), shingle_words) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({keep: pdf[keep].astype("Int64"), "fp": fps.view(np.int64)})

    return docs.select(keep, "text").mapInPandas(rows, f"`{keep}` {kind}, fp long")


# ---- Golay code ------------------------------------------------------------------------------

def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    out = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@lru_cache(maxsize=1)
def nearby_errors() -> np.ndarray:
    """For each syndrome the error patterns of at most four bits, padded with -1: (2048, 6)."""
    patterns = [sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(23), w)]
    syndromes = syndrome(np.array(patterns))
    table, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, int)
    for pattern, s in zip(patterns, syndromes, strict=True):
        table[s, filled[s]] = pattern
        filled[s] += 1
    return table


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own codeword index, syndrome, nearby indices padded with -1) of 23-bit words."""
    s = syndrome(words)
    errors = nearby_errors()[s]
    nearby = np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)
    return nearby[:, 0], s, nearby


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) of all keys. A key holds the segment's number (2 bits), its index
    (12) and syndrome (11), and the next segment's nearby index (12)."""
    unsigned = fps.view(np.uint64)
    decoded = [decode((unsigned >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64))
               for low, width in SEGMENTS]
    positions, found = [], []
    for k in range(3):
        index, s, _ = decoded[k]
        nearby = decoded[(k + 1) % 3][2]
        whole = ((k << 12 | index) << 11 | s) << 12
        row, column = np.nonzero(nearby >= 0)
        positions.append(row)
        found.append(whole[row] | nearby[row, column])
    return np.concatenate(positions), np.concatenate(found)


def _key_rows(frames):
    for pdf in frames:
        fps = pdf["fp"].to_numpy(np.int64)
        position, key = keys(fps)
        yield pd.DataFrame({"key": key, "fp": fps[position]})


def _verified_pairs(frames, max_bits: int):
    """All pairs of each (small) key's fingerprints within ``max_bits``."""
    for pdf in frames:
        a, b = [], []
        for fps in pdf["fps"]:
            own = np.asarray(fps, np.int64)
            i, j = np.triu_indices(len(own), 1)
            near = np.bitwise_count((own[i] ^ own[j]).view(np.uint64)) <= max_bits
            a.append(own[i][near])
            b.append(own[j][near])
        yield pd.DataFrame({"a": np.concatenate([np.zeros(0, np.int64), *a]),
                            "b": np.concatenate([np.zeros(0, np.int64), *b])})


def _words_nearby(frames):
    """Each fingerprint under itself and the 64 words one bit away."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for pdf in frames:
        for begin in range(0, len(pdf), 20_000):
            fps = pdf["fp"].to_numpy(np.int64)[begin:begin + 20_000]
            words = fps.view(np.uint64)[:, None] ^ flips
            yield pd.DataFrame({"word": words.view(np.int64).ravel(), "fp": np.repeat(fps, 65)})


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that connect exactly the components of the relation "at most ``max_bits``
    differing bits" over the fingerprints ``fp`` of ``distinct`` (no repeats)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    keyed = save(distinct.mapInPandas(_key_rows, "key long, fp long"), "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = save(keyed.join(sizes, "key"), "golay-shared")
    few = (shared.where(F.col("n") <= SMALL_KEY).groupBy("key").agg(F.collect_list("fp").alias("fps"))
           .mapInPandas(lambda it: _verified_pairs(it, max_bits), "a long, b long"))
    crowded = shared.where(F.col("n") > SMALL_KEY).select("fp").distinct()
    words = crowded.mapInPandas(_words_nearby, "word long, fp long")
    if max_bits < 2:  # meeting under a word may mean two bits; one bit apart is being each other's word
        return few.union(words.where(F.lit(max_bits == 1) & (F.col("word") != F.col("fp")))
                         .join(crowded.select(F.col("fp").alias("word")), "word", "left_semi")
                         .select(F.col("word").alias("a"), F.col("fp").alias("b")))
    many = (words.groupBy("word").agg(F.collect_list("fp").alias("fps"))  # 65 at most
            .where(F.size("fps") > 1)
            .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))
    return few.union(many)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, key: str = "doc_id") -> DataFrame:
    """(``key``, fp, component_id) for each row of ``docs``; component_id is the smallest ``key``
    that can be reached over links."""
    rows = save(fingerprints(docs, shingle_words, key), "golay-fps")
    distinct = save(rows.groupBy("fp").agg(F.min(key).alias("least")), "golay-distinct")
    roots = components(links(distinct.select("fp"), max_bits), "golay-edges")
    rooted = save(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                  .select("fp", "least", F.coalesce("root", "fp").alias("root")), "golay-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return rows.join(named.select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with all columns of ``docs`` and nothing else: the one with the
    smallest doc_id (nulls last), and of equal ones the first in the table.

    ``docs`` must be the read of a written Parquet table: rows are told apart by their place in its
    files.
    """
    placed, own = placed_rows(docs)
    # rank rows by doc_id without moving their texts: one number per (doc_id, place)
    found = near_duplicates(placed, shingle_words, max_bits, own)
    ids = placed.select(own, F.col("doc_id").alias("__id"))
    best = (found.join(ids, own).groupBy("component_id")
            .agg(F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"),
                                F.col(own).alias("r")))["r"].alias("best"), F.count("*").alias("n"))
            .where("n > 1").select("component_id", "best"))
    gone = save(found.join(best, "component_id").where(F.col(own) != F.col("best")).select(own), "golay-gone")
    maybe, stays = split_by_filter(placed, own, gone)
    # always by exchange, of the rows that the filter leaves: one plan at every size
    kept = maybe.join(gone.hint("merge"), own, "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).union(stays.select(*columns))
