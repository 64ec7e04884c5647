"""Fuzzy line dedup: MinHash signatures, banding, exact verification, distributed union-find.

Lines (split at line feeds) are compared trimmed and lower-cased, by their sets of
``SHINGLE_CHARS``-character shingles. ``BANDS`` bands of ``ROWS`` minimum hashes name the candidates:
two lines of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS (98.6 % at 0.8, 99.7 % at
0.85, over 99.99 % at 0.95). Candidates whose exact Jaccard similarity is at least ``SIMILARITY`` are
linked, and of each component the first line in table order stays. Equal lines (equal
64-bit hashes) need no candidates. A line shorter than a shingle is one shingle, so it is like its
equals only and gets no signature. Blank lines hold nothing that could repeat and stay.

Only distinct lines are compared, and band values with the same lines count once. A band value with up to
``SMALL_BUCKET`` distinct lines gives all its pairs. One with up to ``MIDDLE_BUCKET`` is compared whole in one
place, by counting common shingles, and gives links only, one a line at most. In a larger one every line is compared with
``REPRESENTATIVES`` of its lines; each line that this leaves apart from most of its bucket then meets all
lines it is not connected with, in blocks that give links only. Every candidate pair is so compared or
connected, and pairs of a hot group are not listed.

Texts are never moved to find candidates, only narrow rows; the texts of candidates are fetched
in a second pass. Two filters of a fixed size (``FILTER_BITS`` bits, whatever the input)
keep band values and lines that cannot matter out of the shuffles; false positives are harmless. A third one lets
texts that lose no line pass by the exchange that takes the others to their lost lines. Scratch tables are
deleted after their last reader.

Null texts stay null and empty ones empty. Repeated rows are rows like any other: lines of the later
one go. A document all of whose lines go stays, with an empty text. Other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from prefspark.llm.common import Tables, placed_rows, prepare, save, split_by_filter
from prefspark.llm.graph import components

SHINGLE_CHARS = 8
SIMILARITY = 0.8
BANDS, ROWS = 6, 3
SMALL_BUCKET = 4
MIDDLE_BUCKET = 1000
DENSE_CELLS = 1 << 22  # shingles times lines of a bucket that are held as one matrix
REPRESENTATIVES = 2
BLOCK_LINES = 1000
PAIRS_AT_A_TIME = 200
FILTER_BITS = 1 << 25
BLOCK_CHARS = 1 << 18  # characters hashed at a time
KEYS = [f"k{b}" for b in range(BANDS)]
SIGNED = f"row long, line int, lid long, {', '.join(k + ' long' for k in KEYS)}"

_RNG = np.random.default_rng(8)
_MULTIPLIERS = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(line: str) -> str:
    return line.strip().lower()


def eligible(line: str) -> bool:
    """Whether a normalised line takes part: every line that is not blank."""
    return line != ""


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys of normalised lines: (lines, BANDS) signed 64-bit integers."""
    out = np.empty((len(lines), BANDS), np.int64)
    begin = 0
    while begin < len(lines):
        end, chars = begin, 0
        while end < len(lines) and (end == begin or chars + len(lines[end]) <= BLOCK_CHARS):
            chars += len(lines[end])
            end += 1
        out[begin:end] = _block(lines[begin:end])
        begin = end
    return out


def _block(lines: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    h, width = codes.astype(np.uint64) + np.uint64(1), 1
    while width < SHINGLE_CHARS:  # hash of 2 * width characters from two of width characters
        h = _mixed(h[:-width] * _MIX + h[width:])
        width *= 2
    x = (h >> np.uint64(32)).astype(np.uint32)
    lengths = np.array([len(line) for line in lines])
    first = np.cumsum(lengths) - lengths
    # shingles of a line, then those that cross into the next one, in turn
    bounds = np.column_stack([first, first + lengths - SHINGLE_CHARS + 1]).ravel()[:-1]
    least = np.empty((BANDS * ROWS, len(lines)), np.uint64)
    for j in range(BANDS * ROWS):
        least[j] = np.minimum.reduceat(x * _MULTIPLIERS[j] + _OFFSETS[j], bounds)[::2]
    keys = np.empty((len(lines), BANDS), np.int64)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            key = _mixed(key * _MIX + least[j])
        keys[:, b] = key.view(np.int64)
    return keys


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each line as sorted numbers, equal numbers for equal shingles. Eight
    Latin-1 characters are the eight bytes of a number; other lines' shingles are counted through."""
    try:
        packed = [line.encode("latin-1") for line in lines]
    except UnicodeEncodeError:
        number: dict[str, int] = {}
        return [np.unique(np.array([number.setdefault(line[k:k + SHINGLE_CHARS], len(number))
                                    for k in range(len(line) - SHINGLE_CHARS + 1)], np.uint64)) for line in lines]
    return [np.unique(np.ndarray((len(line) - SHINGLE_CHARS + 1,), "<u8", line, 0, (1,))) for line in packed]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


# ---- passes over the texts -------------------------------------------------------------------

def _signed_rows(frames):
    for pdf in frames:
        rows, numbers, lines = [], [], []
        for row, text in zip(pdf["row"], pdf["text"], strict=True):
            if isinstance(text, str):
                for number, line in enumerate(text.split("\n")):
                    line = normalised(line)
                    if eligible(line):
                        rows.append(row)
                        numbers.append(number)
                        lines.append(line)
            if len(lines) > 50_000:
                yield _signed_frame(rows, numbers, lines)
                rows, numbers, lines = [], [], []
        yield _signed_frame(rows, numbers, lines)


def _signed_frame(rows, numbers, lines) -> pd.DataFrame:
    whole = np.array([len(line) >= SHINGLE_CHARS for line in lines], bool)  # the others have no keys
    keys = np.zeros((len(lines), BANDS), np.int64)
    keys[whole] = signatures([line for line in lines if len(line) >= SHINGLE_CHARS])
    frame = {"row": np.array(rows, np.int64), "line": np.array(numbers, np.int32),
             "lid": np.array([line_id(line) for line in lines], np.int64)}
    return pd.DataFrame(frame | {k: pd.arrays.IntegerArray(keys[:, b].copy(), ~whole) for b, k in enumerate(KEYS)})


def _texts_of(frames, wanted: np.ndarray):
    """(lid, line) of lines with signatures that pass the filter, once per batch."""
    for pdf in frames:
        found = {}
        for text in pdf["text"]:
            if isinstance(text, str):
                for line in text.split("\n"):
                    line = normalised(line)
                    if len(line) >= SHINGLE_CHARS:
                        lid = line_id(line)
                        if wanted[lid % FILTER_BITS >> 3] >> (lid & 7) & 1:
                            found[lid] = line
        yield pd.DataFrame({"lid": pd.Series(found.keys(), dtype="int64"),
                            "line": pd.Series(found.values(), dtype=object)})


def _filter_of(values: DataFrame, column: str) -> np.ndarray:
    """A bit for each value's remainder by ``FILTER_BITS``, as bytes; a fixed size."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1  # the functions count buckets from 1
    maps = (values.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in maps:
        out[(bucket - 1) * len(bits):bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _candidate_rows(frames, shared: np.ndarray):
    """(key, lid) of the band keys that pass the filter, once per batch."""
    for pdf in frames:
        for k in KEYS:
            at = pdf[k].to_numpy() % FILTER_BITS
            own = pdf.loc[(shared[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1, [k, "lid"]]
            yield own.drop_duplicates().rename(columns={k: "key"})


def _pairs(frames):
    for pdf in frames:
        a, b = [], []
        for lids in pdf["lids"]:
            own = np.sort(np.asarray(lids, np.int64))
            i, j = np.triu_indices(len(own), 1)
            a.append(own[i])
            b.append(own[j])
        yield pd.DataFrame({"a": np.concatenate([np.zeros(0, np.int64), *a]),
                            "b": np.concatenate([np.zeros(0, np.int64), *b])}).drop_duplicates()


def _alike(frames, similarity: float):
    for pdf in frames:
        for begin in range(0, len(pdf), PAIRS_AT_A_TIME):  # a few hundred lines' shingles in memory
            part = pdf.iloc[begin:begin + PAIRS_AT_A_TIME]
            lines = dict(zip(part["a"], part["x"], strict=True)) | dict(zip(part["b"], part["y"], strict=True))
            sets = dict(zip(lines, shingle_sets(list(lines.values())), strict=True))
            near = [jaccard(sets[a], sets[b]) >= similarity for a, b in zip(part["a"], part["b"], strict=True)]
            yield part.loc[np.array(near, bool), ["a", "b"]]


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    x = texts.select(F.col("lid").alias("a"), F.col("line").alias("x"))
    y = texts.select(F.col("lid").alias("b"), F.col("line").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(
        lambda it: _alike(it, similarity), "a long, b long")


def _within(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links that connect the alike lines of each bucket of ``members`` (key, lid)."""
    held = members.join(texts, "lid").groupBy("key").agg(F.collect_list("lid").alias("lids"),
                                                          F.collect_list("line").alias("lines"))
    return held.select("lids", "lines").mapInArrow(lambda it: _bucket_links(it, similarity), "a long, b long")


def _bucket_links(batches, similarity: float):
    import pyarrow as pa

    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(batch)):
            lids = np.asarray(batch.column(0)[k].values)
            least = connected(batch.column(1)[k].as_py(), similarity)
            moved = np.flatnonzero(least != np.arange(len(least)))
            a.append(lids[moved])
            b.append(lids[least[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of every two of some lines."""
    vocabulary, of = np.unique(np.concatenate(sets), return_inverse=True)
    if len(vocabulary) * len(sets) > DENSE_CELLS:
        common = _Common(sets)
        return np.concatenate([common.counts(sets[k:k + 128]) for k in range(0, len(sets), 128)])
    holds = np.zeros((len(sets), len(vocabulary)), np.float32)
    holds[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), of] = 1
    return np.rint(holds @ holds.T).astype(np.int64)


def connected(lines: list[str], similarity: float) -> np.ndarray:
    """For each line the first one that it is connected with by alike lines."""
    sets = shingle_sets(lines)
    sizes, both = np.array([len(x) for x in sets]), common_counts(sets)
    alike = both / (sizes[:, None] + sizes - both) >= similarity
    least = np.arange(len(lines))
    while True:  # every line takes the least number among its alike lines'
        lower = np.where(alike, least, len(lines)).min(1)
        if (lower == least).all():
            return least
        least = lower


def classes(lines: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the component of each line that is like another, different one."""
    spark = docs.sparkSession
    tables = Tables(spark)
    lines = lines.where(F.col(KEYS[0]).isNotNull())
    keys = lines.select("lid", F.explode(F.array(*KEYS)).alias("key"))
    shared = keys.groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high")).where("low < high")
    passing = spark.sparkContext.broadcast(_filter_of(shared, "key"))
    member = tables.save(lines.select("lid", *KEYS).mapInPandas(
        lambda it: _candidate_rows(it, passing.value), "key long, lid long").distinct(), "line-members")
    # of buckets that hold the same lines (by number and two 64-bit sums of hashes) one is looked at
    hashed = [F.min_by("lid", F.xxhash64("lid", F.lit(j))) for j in range(REPRESENTATIVES)]
    sums = [F.bit_xor(F.xxhash64("lid", F.lit(seed))).alias(name) for name, seed in (("x", -1), ("y", -2))]
    sizes = (member.groupBy("key").agg(F.count("*").alias("n"), *sums, *[h.alias(f"r{j}") for j, h in enumerate(hashed)])
             .where("n > 1"))
    once = sizes.groupBy("n", "x", "y", *[f"r{j}" for j in range(REPRESENTATIVES)]).agg(F.min("key").alias("key"))
    member = tables.save(member.join(once.select("key", "n", F.array(*[f"r{j}" for j in range(REPRESENTATIVES)]).alias("some")),
                                     "key"), "line-buckets")
    tables.drop("line-members")
    n = F.col("n")
    few = (member.where(n <= SMALL_BUCKET).groupBy("key").agg(F.collect_list("lid").alias("lids"))
           .mapInPandas(_pairs, "a long, b long"))
    middle = member.where((n > SMALL_BUCKET) & (n <= MIDDLE_BUCKET)).select("key", "lid")
    large = member.where((n > SMALL_BUCKET) & (n > MIDDLE_BUCKET)).select("key", "lid", "some", "n")
    star = large.select("lid", F.explode("some").alias("to")).where("lid <> to").select(
        F.least("lid", "to").alias("a"), F.greatest("lid", "to").alias("b"))
    pairs = tables.save(few.union(star).distinct(), "line-pairs")
    wanted = spark.sparkContext.broadcast(_filter_of(
        pairs.select(F.explode(F.array("a", "b")).alias("lid")).union(middle.select("lid")), "lid"))
    texts = tables.save(docs.select("text").mapInPandas(lambda it: _texts_of(it, wanted.value), "lid long, line string")
                        .groupBy("lid").agg(F.first("line").alias("line")), "line-texts")
    found = tables.save(_verified(pairs, texts, similarity).union(_within(middle, texts, similarity)), "line-links")
    tables.drop("line-pairs")
    roots = components(found, "line-edges")
    tables.drop("line-links")
    if large.isEmpty():
        tables.drop("line-buckets", "line-texts")
        return roots
    # large buckets: whatever is not yet connected with most of its bucket meets all of the rest
    placed = tables.save(large.join(roots, large["lid"] == roots["node"], "left").select(
        "key", "lid", "n", F.coalesce("root", "lid").alias("root")), "line-placed")
    tables.drop("line-buckets")
    most = (placed.groupBy("key", "root").agg(F.count("*").alias("same"))
            .groupBy("key").agg(F.max_by("root", F.struct("same", "root")).alias("most"),
                                F.sum("same").alias("all"), F.max("same").alias("in_most")))
    rest = tables.save(placed.join(most, "key").where("root <> most").select(
        "key", "lid", "n", "root", F.ceil((F.col("all") - F.col("in_most")) / BLOCK_LINES).alias("chunks")),
        "line-rest")
    if not rest.isEmpty():
        more = tables.save(_between_blocks(placed, rest, texts, similarity), "line-more")
        # roots and what the new links connect: the other nodes follow their roots
        joined = components(more.select(F.col("asked_root").alias("a"), F.col("root").alias("b")), "line-edges")
        follow = joined.select(F.col("node").alias("from"), F.col("root").alias("to"))
        moved = roots.join(follow, roots["root"] == follow["from"], "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = save(moved.union(joined.select("node", "root")), "line-roots")
    tables.drop("line-placed", "line-rest", "line-texts", "line-more")
    return roots


def _between_blocks(placed: DataFrame, rest: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (asked_root, root) between the components of lines of ``rest`` and those of lines of their buckets.

    A bucket is dealt into blocks of about ``BLOCK_LINES`` lines, and so are its lines in ``rest``; every two
    blocks meet in a task of their own, which counts common shingles and gives links only.
    """
    blocks = F.ceil(F.col("n") / BLOCK_LINES).cast("int")
    chunks = rest.groupBy("key").agg(F.max("chunks").cast("int").alias("chunks"))
    dealt = lambda of, parts: F.pmod(F.xxhash64(of), parts).cast("int")
    members = (placed.join(chunks, "key").withColumn("block", dealt("lid", blocks))
               .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
               .join(texts, "lid").select("key", "block", "chunk", "lid", "root", "line"))
    asked = (rest.withColumn("chunk", dealt("lid", F.col("chunks")))
             .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .join(texts, "lid").select("key", "block", "chunk", "lid", "root", "line"))
    together = ["key", "block", "chunk"]
    asked = asked.withColumnsRenamed({c: f"asked_{c}" for c in asked.columns})  # both sides hold ``texts``
    return asked.groupBy(*[f"asked_{c}" for c in together]).cogroup(members.groupBy(*together)).applyInPandas(
        lambda x, y: _block_links(x, y, similarity), "asked_root long, root long").distinct()


class _Common:
    """Counts of the shingles that a line has in common with each of some lines. Shingles that many
    lines hold (over one in ``HEAVY``: ``HEAVY`` times a line's shingles at most) are columns of a
    matrix; the others have lists of their holders."""

    HEAVY = 8

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        owner = np.repeat(np.arange(self.n), [len(x) for x in sets])
        self.vocabulary, of, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.heavy = held * self.HEAVY > self.n
        self.column = np.cumsum(self.heavy) - 1
        self.matrix = np.zeros((int(self.heavy.sum()), self.n), np.float32)
        often = self.heavy[of]
        self.matrix[self.column[of[often]], owner[often]] = 1
        order = np.argsort(of, kind="stable")
        self.holders, self.held, self.first = owner[order], held, np.cumsum(held) - held

    def counts(self, asked: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(asked), len(self.matrix)), np.float32)
        rest = np.zeros((len(asked), self.n), np.int64)
        for k, own in enumerate(asked):
            at = np.searchsorted(self.vocabulary, own)
            at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == own]
            rows[k, self.column[at[self.heavy[at]]]] = 1
            few = at[~self.heavy[at]]
            if len(few):
                size = self.held[few]
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                rest[k] = np.bincount(self.holders[np.repeat(self.first[few], size) + inside], minlength=self.n)
        return np.rint(rows @ self.matrix).astype(np.int64) + rest


def _block_links(asked: pd.DataFrame, members: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """For each asked line, the other components among ``members`` that hold a line like it."""
    a, b = [], []
    if len(asked) and len(members):
        sets = shingle_sets([*members["line"], *asked["asked_line"]])
        own, theirs = sets[len(members):], sets[:len(members)]
        common, sizes = _Common(theirs), np.array([len(x) for x in theirs])
        roots, asked_roots = members["root"].to_numpy(np.int64), asked["asked_root"].to_numpy(np.int64)
        for begin in range(0, len(own), 128):
            counts = common.counts(own[begin:begin + 128])
            for k, both in enumerate(counts, begin):
                alike = both / (len(own[k]) + sizes - both) >= similarity
                near = np.unique(roots[alike & (roots != asked_roots[k])])
                a += [asked_roots[k]] * len(near)
                b += near.tolist()
    return pd.DataFrame({"asked_root": np.array(a, np.int64), "root": np.array(b, np.int64)})


def removed_lines(placed: DataFrame, row: str, similarity: float = SIMILARITY) -> DataFrame:
    """(row, gone): the numbers of the lines that go, for each row of ``placed`` that loses some.
    ``row`` is a long column that tells the rows apart and orders them."""
    prepare(placed.sparkSession)
    tables = Tables(placed.sparkSession)
    lines = tables.save(placed.select(F.col(row).alias("row"), "text").mapInPandas(_signed_rows, SIGNED), "line-keys")
    roots = classes(lines, placed, similarity)
    place = F.struct("row", "line")
    rooted = lines.select("row", "line", "lid").join(roots, lines["lid"] == roots["node"], "left").select(
        "row", "line", F.coalesce("root", "lid").alias("root"))
    first = (rooted.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("root", "first"))
    gone = save(rooted.join(first, "root").where(place != F.col("first"))
                .groupBy("row").agg(F.collect_list("line").alias("gone")), "line-gone")
    tables.drop("line-keys")
    return gone


def _cleaned(batches, text_at: int, gone_at: int):
    import pyarrow as pa

    for batch in batches:
        texts, removed = [], []
        for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(gone_at).to_pylist(), strict=True):
            if gone:
                out = set(gone)
                text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in out)
            texts.append(text)
            removed.append(len(gone or ()))
        columns = list(batch.columns)
        columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
        columns[gone_at] = pa.array(removed, pa.int64())
        fields = [f.name for f in batch.schema]
        yield pa.RecordBatch.from_arrays(columns, names=fields)


def dedup(docs: DataFrame, similarity: float = SIMILARITY, count: str = "n_removed") -> DataFrame:
    """``docs`` with all its columns, ``text`` without the lines that go, and how many those are in
    the column ``count``. ``docs`` must be the read of a written Parquet table: rows are known by
    their place in its files."""
    placed, own = placed_rows(docs)
    gone = removed_lines(placed, own, similarity).withColumnsRenamed({"row": own, "gone": count})
    maybe, whole = split_by_filter(placed, own, gone.select(own))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # always by exchange, of the texts that the filter leaves: one plan at every size
    joined = maybe.join(gone.hint("merge"), own, "left").select(*columns, count)
    text_at, gone_at = docs.columns.index("text"), len(docs.columns)
    schema = StructType([*docs.schema.fields, StructField(count, LongType())])
    return (joined.mapInArrow(lambda it: _cleaned(it, text_at, gone_at), schema)
            .union(whole.select(*columns, F.lit(0).cast("long").alias(count))))


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without repeated lines; no further column."""
    count = "__removed"
    while count in docs.columns:
        count += "_"
    return dedup(docs, similarity, count).drop(count)
