"""Order-dependent operators without a single-partition window over data.

* ``with_row_index`` (W5): a global 0-based index. The data is range-partitioned on the *full*
  (unique) order key, so a hot leading value is split across tasks by the later keys; each row's
  sorted partition and position are stamped and written once to a table in the shared checkpoint
  folder (lineage cut, survives lost executors); rows per partition are counted (one row per
  partition), turned into running offsets and broadcast back. Only the offset table - one row
  per partition - ever sits in one task. Copies of one row sort as one run (row, count), whose
  positions are a range that is dealt over tasks again.
* ``tail_split`` (W6) needs only the n-th largest key: a bounded top-n, no global index.
* ``flip_preferences`` (G1) needs only the k-th smallest hash: it is found by a radix selection on
  md5 prefixes (histograms with at most 16^4 buckets per level), so flipping is a narrow projection
  of the data. G2 is a per-row coin from the same hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from prefspark.functions.text import hash_hex, hash_unit32
from prefspark.plans.broadcast import small_side
from prefspark.session import default_parallelism, scratch_path

RUN_ROWS = 10_000  # from this many equal rows on, they are indexed as one run; a task expands as many at a time
HASH_DIGITS = 64  # hex digits of a row's order: md5 of its key, md5 of the row
TOP_ROWS = 10_000  # largest tail that is found by a bounded top-n
_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | record number


def _check_keys(df: DataFrame, order_by: Sequence[str]) -> list[str]:
    keys = list(order_by)
    if not keys:
        raise ValueError("an explicit, unique order key is required (row order is not defined in Spark)")
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"order keys {missing} not in {df.columns}")
    return keys


def _ties(df: DataFrame) -> list:
    """Tiebreakers after the keys: 128 bits of hash of the whole row, so that rows sharing a key value are
    split over range partitions by their content, and only copies of one row are equal."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(*columns).alias("_tie"), F.xxhash64(F.lit(1), *columns).alias("_tie2")]


def _runs(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` with its ties and a count ``_copies``, and whether any count is above 1: a row that occurs ``RUN_ROWS``
    times or more comes once with its count, every other one as often as it occurs, with 1.

    Which rows those are comes from one partial aggregation over their hashes, and they are collapsed by
    another one: a row that holds a third of the table costs each task one group."""
    tied = df.select("*", *_ties(df))
    path = scratch_path(df.sparkSession, "row-runs")
    tied.groupBy("_tie", "_tie2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= RUN_ROWS).write.parquet(path)
    many = df.sparkSession.read.parquet(path)
    if many.isEmpty():
        return tied.withColumn("_copies", F.lit(1).cast("long")), False
    side = small_side(many)
    found = tied.join(side, ["_tie", "_tie2"], "left").select(*[F.col(f"`{c}`") for c in df.columns], "_tie", "_tie2", "_n")
    grouped = found.where(F.col("_n").isNotNull()).groupBy("_tie", "_tie2")
    if any(isinstance(f.dataType, MapType) for f in df.schema.fields):  # maps cannot be grouped by
        whole = grouped.agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_row"), F.count(F.lit(1)).alias("_copies"))
        runs = whole.select("_row.*", "_tie", "_tie2", "_copies")
    else:
        runs = (found.where(F.col("_n").isNotNull())
                .groupBy(*[F.col(f"`{c}`") for c in df.columns], "_tie", "_tie2").agg(F.count(F.lit(1)).alias("_copies")))
    single = found.where(F.col("_n").isNull()).drop("_n").withColumn("_copies", F.lit(1).cast("long"))
    return single.unionByName(runs), True


def indexed_with_total(df: DataFrame, order_by: Sequence[str], name: str = "row_idx"):
    """(df + 0-based ``name``, one-row DataFrame ``_n_total``); see module doc for the plan."""
    keys = _check_keys(df, order_by)
    spark = df.sparkSession
    # Range exchange on the full key + sort, then each row's (sorted partition, position) is
    # stamped and written ONCE to a table in the shared checkpoint folder. The stamps travel with
    # the rows, so counting and indexing read the same facts however the table is split on read,
    # and a retried write task re-sorts the same shuffle block into the same stamps.
    # The order is deterministic on purpose (a random salt could move rows between partitions when a
    # lost map task is recomputed after others committed).
    rows, runs = _runs(df)
    path = scratch_path(spark, "row-index")
    (rows.orderBy(*keys, "_tie", "_tie2").withColumn("_mono", F.monotonically_increasing_id())
         .drop("_tie", "_tie2").write.parquet(path))
    pinned = spark.read.parquet(path)
    tagged = (pinned.withColumn("_part", F.shiftright("_mono", _LOCAL_BITS))
                    .withColumn("_local", F.col("_mono").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
                    .drop("_mono"))
    counts = tagged.groupBy("_part").agg(F.sum("_copies").alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("_n_total"))
    placed = tagged.join(F.broadcast(offsets), "_part")
    at = F.col("_offset") + F.col("_local")
    if not runs:
        return placed.withColumn(name, at.cast("long")).drop("_part", "_local", "_offset", "_copies"), total
    # a run before a row in its partition takes its further copies' places, too
    ahead = (tagged.where(F.col("_copies") > 1).groupBy("_part")
             .agg(F.collect_list(F.struct("_local", (F.col("_copies") - 1).alias("more"))).alias("_ahead")))
    before = F.aggregate(F.filter(F.coalesce("_ahead", F.array()), lambda r: r["_local"] < F.col("_local")),
                         F.lit(0).cast("long"), lambda total, r: total + r["more"])
    placed = (placed.join(small_side(ahead), "_part", "left").withColumn(name, (at + before).cast("long"))
              .drop("_part", "_local", "_offset", "_ahead"))
    single = placed.where(F.col("_copies") == 1).drop("_copies")
    # a run's positions are a range: dealt over the tasks in stretches, and written out there
    last = F.col("_copies") - 1
    dealt = (placed.where(F.col("_copies") > 1)
             .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(RUN_ROWS).cast("long"))))
             .repartition(default_parallelism(spark), name, "_from"))
    stretch = F.sequence(F.col("_from"), F.least(F.col("_from") + RUN_ROWS - 1, last))
    copies = (dealt.withColumn("_k", F.explode(stretch)).withColumn(name, F.col(name) + F.col("_k"))
              .drop("_copies", "_from", "_k"))
    return single.unionByName(copies), total


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Global 0-based position of every row in ``order_by`` order; rows that share a key go by a hash of the
    whole row, copies of one row take consecutive positions."""
    return indexed_with_total(df, order_by, name)[0]


def assign_batches(df: DataFrame, order_by: Sequence[str], size: int = 8,
                   name: str = "batch_id") -> DataFrame:
    """Fixed-size batches in key order: ``batch_id = row_idx div size`` (+ ``n_batches``)."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    indexed, total = indexed_with_total(df, order_by)
    return (indexed.crossJoin(F.broadcast(total))
            .withColumn(name, F.floor(F.col("row_idx") / F.lit(size)).cast("long"))
            .withColumn("n_batches", F.floor((F.col("_n_total") + F.lit(size - 1)) / F.lit(size)).cast("long"))
            .drop("_n_total"))


def split_chunks(df: DataFrame, order_by: Sequence[str], k: int, name: str = "chunk") -> DataFrame:
    """``k`` contiguous chunks, the first ``n mod k`` one row longer (1-based, = ``ntile(k)``)."""
    if k <= 0:
        raise ValueError("number of chunks must be positive")
    indexed, total = indexed_with_total(df, order_by)
    n = F.col("_n_total")
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    big = r * (q + F.lit(1))
    idx = F.col("row_idx")
    chunk = F.when(idx < big, F.floor(idx / (q + F.lit(1)))).otherwise(r + F.floor((idx - big) / q))
    return (indexed.crossJoin(F.broadcast(total))
            .withColumn(name, (chunk + F.lit(1)).cast("long"))
            .drop("_n_total"))


def tail_split(df: DataFrame, order_by: Sequence[str], n: int = 100, name: str = "split",
               tail_label: str = "eval", head_label: str = "train") -> DataFrame:
    """The last ``n`` rows in key order are ``tail_label``, the rest ``head_label``.

    Rows that share a key go by a hash of the whole row; if the cut falls among copies of one row, only
    their number counts. With fewer than ``n`` rows every row is in the tail (the reference would fail
    there). The result is the same whether the cut is found by a bounded top-n or, for more than
    ``TOP_ROWS`` rows, by position.
    """
    keys = _check_keys(df, order_by)
    if n <= 0:  # an empty tail
        return df.withColumn(name, F.lit(head_label))
    label = lambda tail: F.when(tail, F.lit(tail_label)).otherwise(F.lit(head_label))
    if n > TOP_ROWS:  # a large tail: by position, nothing but partition counts in one task
        indexed, total = indexed_with_total(df, keys, "_row_idx")
        return (indexed.crossJoin(F.broadcast(total))
                .withColumn(name, label(F.col("_row_idx") >= F.col("_n_total") - n)).drop("_row_idx", "_n_total"))
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], *_ties(df))
    # bounded top-n: per-partition top-k, then one merge of n x partitions keys; its last row is the cut
    top = df.select(key.alias("_k")).orderBy(F.col("_k").desc()).limit(n)
    cut = top.agg(F.min("_k").alias("_k"), F.count(F.lit(1)).alias("_n")).first()
    if cut["_n"] < n:  # fewer than n rows: all in the tail
        return df.withColumn(name, F.lit(tail_label))
    at = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name)
                    for v, f in zip(cut["_k"], top.schema["_k"].dataType.fields, strict=True)])
    above, held = df.agg(F.count_if(key > at), F.count_if(key == at)).first()
    if above + held == n:
        return df.withColumn(name, label(key >= at))
    copy = df.where(key == at).limit(1)
    copies = df.sparkSession.range(held).select((F.col("id") < n - above).alias("_tail"))
    return (df.where(key != at).withColumn(name, label(key > at))
            .unionByName(copies.crossJoin(F.broadcast(copy)).withColumn(name, label(F.col("_tail"))).drop("_tail")))


def _kth_smallest(hashed: DataFrame, k: int, digits: int = 4, leaf_rows: int = 100_000,
                  first_hist: DataFrame | None = None) -> tuple[str, int, int]:
    """The k-th (1-based) smallest hash ``_h``, how many rows are below it and how many hold it, by
    radix selection over hex prefixes.

    Each level counts rows per next ``digits`` hex digits inside the current prefix (a partial +
    final aggregation to at most 16^digits rows), finds the bucket holding the k-th row with a
    running sum over that small histogram, and narrows the prefix. Hashes are uniform, so a level
    shrinks the candidates ~65,536-fold; once a bucket holds at most ``leaf_rows`` rows, they are
    counted by whole hash. Only copies of one row share a whole hash, and they end in one count.
    """
    prefix, remaining = "", k
    hist = first_hist
    while True:
        width = len(prefix) + digits
        if hist is None:
            cand = hashed if not prefix else hashed.where(F.col("_h").startswith(prefix))
            hist = cand.groupBy(F.substring("_h", 1, width).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        cum = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        row = (hist.withColumn("_cum", cum)
                   .where((F.col("_cum") - F.col("_n") < remaining) & (F.col("_cum") >= remaining))
                   .select("_b", "_n", (F.col("_cum") - F.col("_n")).alias("_before"))
                   .first())
        hist = None
        prefix, remaining = row["_b"], remaining - row["_before"]
        if len(prefix) >= HASH_DIGITS:
            return prefix, k - remaining, row["_n"]
        if row["_n"] <= leaf_rows:
            digits = HASH_DIGITS - len(prefix)


def flip_preferences(df: DataFrame, ratio: float, key: Sequence[str], seed: int = 42,
                     exact: bool = True, chosen: str = "chosen", rejected: str = "rejected",
                     flag: str = "flipped", where=None) -> DataFrame:
    """Swap ``chosen``/``rejected`` on a reproducible share of the rows.

    exact=True (G1): exactly ``floor(ratio * n)`` rows - those with the smallest
    ``md5(seed:key)`` - are flipped; rows that share a key go by a hash of the whole row. exact=False (G2): each row flips when the first 32 bits of
    its hash fall below ``ratio * 2^32`` (no counting at all; streamable). With ``where`` (a
    boolean Column) only matching rows take part - ``n`` counts them - and all rows are returned.
    """
    keys = _check_keys(df, key)
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must be within [0, 1]")
    # the key's hash, then the whole row's: rows that share a key still have an order, and rows that
    # share both are copies of one row
    h = hash_hex(seed, *keys)
    if exact:
        h = F.concat(h, F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    hashed = df.withColumn("_h", h if where is None else F.when(where, h))
    if exact:
        hist = (hashed.where(F.col("_h").isNotNull()).groupBy(F.substring("_h", 1, 4).alias("_b"))
                      .agg(F.count(F.lit(1)).alias("_n")).cache())
        n = hist.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        k = math.floor(float(ratio) * float(n))  # int(ratio * n), same double arithmetic as take_count
        if k == 0:
            hist.unpersist()
            cond = F.lit(False)
        else:
            cut, below, held = _kth_smallest(hashed.where(F.col("_h").isNotNull()), k, first_hist=hist)
            hist.unpersist()
            cond = F.col("_h") <= F.lit(cut)
            if below + held > k:  # the cut falls among copies of one row: only their number counts
                copy = hashed.where(F.col("_h") == cut).limit(1)
                copies = df.sparkSession.range(held).select((F.col("id") < k - below).alias("_swap"))
                return (_swapped(hashed.where(F.col("_h").isNull() | (F.col("_h") != cut)),
                                 F.coalesce(cond, F.lit(False)), chosen, rejected, flag)
                        .unionByName(_swapped(copies.crossJoin(F.broadcast(copy)), F.col("_swap"), chosen,
                                              rejected, flag).drop("_swap")))
    else:
        cond = hash_unit32(F.col("_h")).cast("double") < F.lit(float(ratio) * 4294967296.0)
    return _swapped(hashed, F.col("_h").isNotNull() & F.coalesce(cond, F.lit(False)), chosen, rejected, flag)


def _swapped(df: DataFrame, cond, chosen: str, rejected: str, flag: str) -> DataFrame:
    """``df`` with ``flag`` and, where it holds, the two columns exchanged; without the hash."""
    c, r = F.col(chosen), F.col(rejected)
    return (df.withColumn(flag, cond)
              .withColumn("_c", F.when(F.col(flag), r).otherwise(c))
              .withColumn(rejected, F.when(F.col(flag), c).otherwise(r))
              .withColumn(chosen, F.col("_c"))
              .drop("_c", "_h"))
