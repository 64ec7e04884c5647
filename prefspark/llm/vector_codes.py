"""Vector compression: product codes by exact integer k-means with norm-of-sum bounds.

Components become integers ``floor(scale * x)``; a vector is cut into ``parts`` equal consecutive parts, and each
part is replaced by the index of its nearest codebook entry (squared Euclidean distance, ties to the lower
index). The codebooks start as the parts of the first vectors by id; each round assigns all parts, then replaces
every entry by its parts' floored mean (unused entries stay). A last assignment gives the codes.

Most distances are never computed. Entries are dealt into groups; of each part of each row the table keeps one lower
bound a group (on the distance to all entries of the group but the assigned one) with the number of the round
in which it was computed. The codebooks of all rounds are retained, so a bound of round t holds in round T
less ``max ||entry(T) - entry(t)||`` over the group: the norm of the sum of its moves, which is at most the sum of
their norms that accumulated drifts take off. The distance to the assigned entry is computed
exactly; only groups whose bound is not above it are scanned again, and their bounds are stamped anew.
Bounds are rounded downwards and distances are exact, so the codes equal those of a full search.

A round is one pass over the rows, written to the shared folder with codes, bounds and stamps, and one pass over the
rows whose codes changed, which gives changes of sums and counts by (part, entry): a fixed number of rows
for the driver. A round's table is deleted once the next one is written.

Null vectors, and those that are empty or hold null or non-finite components, are dropped; so are vectors of another
length than the first one kept (by id). If the length is no multiple of ``parts``, the first parts are one longer.
Integers beyond a bound that keeps every distance within a long (2^27 for 64 components, so x beyond 131,072) are
held at it. Null ids come last in the order, equal ids go by their components. Fewer rows than ``entries``: as many
entries as rows. Repeated rows are rows like any other. An empty table gives no rows. A sum over labels
beyond a long is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import prepare, remove, save
from prefspark.plans.broadcast import small_side
from prefspark.session import scratch_path

PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 4, 256, 4, 1024, 16
DOWN, UP = 1 - 1e-6, 1 + 1e-6  # margins of rounding for bounds and for what is compared with them
STATE = "id long, label {label}, x binary, codes binary, before binary, bounds binary, stamps binary"


def cuts(width: int, parts: int) -> list[slice]:
    ends = np.cumsum([len(a) for a in np.array_split(np.arange(width), parts)])
    return [slice(int(e - n), int(e)) for e, n in zip(ends, np.diff(ends, prepend=0), strict=True)]


def most(width: int) -> int:
    """The largest integer component for which ``width`` squared differences add up to less than 2^63."""
    return 1 << (60 - max(width - 1, 1).bit_length()) // 2


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries, as integers."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    kind = np.float64 if 4 * x.shape[1] * largest ** 2 < 1 << 53 else np.int64  # floats are exact up to there
    x, entries = x.astype(kind), entries.astype(kind)
    out = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
    return out.astype(np.int64)


def dealt(entries: np.ndarray, groups: int = GROUPS) -> list[np.ndarray]:
    """Groups of entry indexes, ascending in each: consecutive ones along the entries' main direction."""
    centred = entries - entries.mean(0)
    _, directions = np.linalg.eigh(centred.T @ centred) if centred.shape[1] else (None, np.zeros((0, 1)))
    order = np.argsort(centred @ directions[:, -1], kind="stable")
    return [np.sort(g) for g in np.array_split(order, min(groups, len(entries)))]


class PartCoder:
    """Assigns one part's rows in the newest of the rounds of ``history``; ``scanned`` counts exact distances."""

    def __init__(self, history: list[np.ndarray], groups: list[np.ndarray]):
        self.now, self.round, self.groups, self.scanned = history[-1], len(history) - 1, groups, 0
        self.group_of = np.empty(len(self.now), np.int64)
        for g, members in enumerate(groups):
            self.group_of[members] = g
        moves = [np.sqrt((((self.now - then).astype(np.float64)) ** 2).sum(1)) * UP for then in history]
        self.moved = np.array([[m[members].max() for members in groups] for m in moves])

    def _distances(self, x, members):
        self.scanned += len(x) * len(members)
        return squared(x, self.now[members])

    def first(self, x: np.ndarray):
        """Codes, bounds, stamps and squared distances by a full search."""
        d2 = self._distances(x, np.arange(len(self.now)))
        rows, codes = np.arange(len(x)), d2.argmin(1)
        nearest = d2[rows, codes].copy()
        far = d2.astype(np.float64)
        far[rows, codes] = np.inf
        bounds = np.column_stack([np.sqrt(far[:, members].min(1)) for members in self.groups]) * DOWN
        return codes, bounds.astype(np.float32), np.full(bounds.shape, self.round, np.uint8), nearest

    def again(self, x: np.ndarray, codes: np.ndarray, bounds: np.ndarray, stamps: np.ndarray):
        """The same from the codes and bounds of earlier rounds."""
        rows = np.arange(len(x))
        own = ((x - self.now[codes]) ** 2).sum(1)
        self.scanned += len(x)
        reach = np.sqrt(own.astype(np.float64))
        valid = bounds - self.moved[stamps, np.arange(len(self.groups))]
        open_ = valid <= (reach * UP)[:, None]
        best, at = own.copy(), codes.copy()
        least = np.full(bounds.shape, np.inf)  # of scanned groups: the two smallest distances, and whose the first is
        second, whose = least.copy(), np.full(bounds.shape, -1, np.int64)
        for g, members in enumerate(self.groups):
            r = np.flatnonzero(open_[:, g])
            if not len(r):
                continue
            d2 = self._distances(x[r], members)
            k, some = d2.argmin(1), np.arange(len(r))
            low = d2[some, k]
            far = d2.astype(np.float64)
            far[some, k] = np.inf
            least[r, g], second[r, g], whose[r, g] = low, far.min(1), members[k]
            better = (low < best[r]) | ((low == best[r]) & (members[k] < at[r]))
            best[r[better]], at[r[better]] = low[better], members[k][better]
        scanned = np.sqrt(np.where(whose == at[:, None], second, least)) * DOWN
        changed = np.flatnonzero(at != codes)  # an unscanned group that now holds the former entry again
        left = self.group_of[codes[changed]]
        bounds, stamps = bounds.copy(), stamps.copy()
        lowered = np.minimum(valid[changed, left], reach[changed] * DOWN)
        bounds[changed, left], stamps[changed, left] = lowered, self.round
        bounds[open_], stamps[open_] = scanned[open_], self.round
        return at, np.where(np.isinf(bounds), np.float32(3e38), bounds), stamps, best


def _numbers(column, kind, width: int) -> np.ndarray:
    """The rows of a column of binaries of one length."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


def _cells(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _assigned(batches, history: list[list[np.ndarray]], groups: list[list[np.ndarray]], last: bool):
    """The state after the assignment of the newest round; after the last one codes and errors only."""
    parts, width = len(groups), sum(c.shape[1] for c in history[-1])
    coders = [PartCoder([h[p] for h in history], groups[p]) for p in range(parts)]
    at = np.cumsum([0, *[len(g) for g in groups]])  # a part's columns among bounds and stamps
    for batch in batches:
        ids, labels, vectors, *state = batch.columns  # ids and labels pass through as they are
        if not len(vectors):
            continue
        x = _numbers(vectors.to_pylist(), "<i4", width).astype(np.int64)
        before = None
        if state:
            before = _numbers(state[0].to_pylist(), np.uint8, parts)
            bounds = _numbers(state[2].to_pylist(), "<f4", at[-1])
            stamps = _numbers(state[3].to_pylist(), np.uint8, at[-1])
        found = []
        for p, cut in enumerate(cuts(width, parts)):
            own = slice(at[p], at[p + 1])
            found.append(coders[p].first(x[:, cut]) if before is None else
                         coders[p].again(x[:, cut], before[:, p].astype(np.int64), bounds[:, own], stamps[:, own]))
        codes = np.column_stack([f[0] for f in found]).astype(np.uint8)
        if last:
            new = {"code": pa.array([row.tobytes().hex() for row in codes]),
                   "error": pa.array(sum(f[3] for f in found), pa.int64())}
        else:
            new = {"x": vectors, "codes": _cells(codes),
                   "before": state[0] if state else pa.nulls(len(x), pa.binary()),
                   "bounds": _cells(np.column_stack([f[1] for f in found]).astype("<f4")),
                   "stamps": _cells(np.column_stack([f[2] for f in found]))}
        yield pa.RecordBatch.from_arrays([ids, labels, *new.values()], names=["id", "label", *new])


def _changes(frames, sizes: list[int], width: int):
    """Changes of counts and sums by (part, entry), once a task."""
    parts = len(sizes)
    held = [np.zeros((k, 1 + c.stop - c.start), np.int64)
            for k, c in zip(sizes, cuts(width, parts), strict=True)]
    for pdf in frames:
        for column, sign in (("codes", 1), ("before", -1)):
            some = pdf[pdf[column].notna()]
            x, codes = _numbers(some["x"], "<i4", width), _numbers(some[column], np.uint8, parts)
            for p, cut in enumerate(cuts(width, parts)):
                held[p][:, 0] += sign * np.bincount(codes[:, p], minlength=sizes[p])
                for j in range(cut.start, cut.stop):  # a batch's sums are exact in doubles
                    sums = np.bincount(codes[:, p], x[:, j], minlength=sizes[p])
                    held[p][:, 1 + j - cut.start] += sign * sums.astype(np.int64)
    for p, table in enumerate(held):
        used = np.flatnonzero(table.any(1))
        yield pd.DataFrame({"part": np.full(len(used), p), "entry": used,
                            "sums": pd.Series(list(table[used]), dtype=object)})


def _update(totals: list[np.ndarray], state: DataFrame, width: int) -> None:
    """Adds to counts and sums of all (part, entry) what the newest assignment changed."""
    sizes, longest = [len(t) for t in totals], max(t.shape[1] for t in totals)
    changed = state.where(F.col("before").isNull() | (F.col("before") != F.col("codes")))
    rows = (changed.select("x", "codes", "before")
            .mapInPandas(lambda it: _changes(it, sizes, width), "part int, entry int, sums array<long>")
            .groupBy("part", "entry").agg(*[F.sum(F.get("sums", F.lit(j))) for j in range(longest)]).collect())
    for part, entry, *sums in rows:  # at most parts * entries rows
        totals[part][entry] += np.array(sums[:totals[part].shape[1]], np.int64)


def _integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, x): rows that hold finite components only, with integer components."""
    vector = F.col(f"`{vector_col}`")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    limit = 2.0 ** 40  # far beyond ``most``; a long holds it

    def integer(c):
        return F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("long")
    return (vectors.where(vector.isNotNull() & (F.size(vector) > 0) & finite)
            .select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.transform(vector, integer).alias("x")))


def _packed(batches, width: int):
    limit = most(width)
    for batch in batches:
        x = batch.column(2)
        rows = np.asarray(x.flatten()).reshape(len(x), width).clip(-limit, limit).astype("<i4")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _cells(rows)], names=["id", "label", "x"])


def learn(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None,
          parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """(``id``, ``label``, ``code``, ``error``) of each row kept, and the codebooks: one integer array a part. A
    code is the hex of one byte a part. (None, []) if no row is kept."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    prepare(spark)
    rows = _integers(vectors, scale, id_col, vector_col, label_col)
    order = [F.asc_nulls_last("id"), F.asc("x")]
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        return None, []
    width = len(head[0]["x"])
    rows = rows.where(F.size("x") == width)
    start = np.array([r["x"] for r in rows.orderBy(*order).limit(entries).select("x").collect()], np.int64)
    start = start.clip(-most(width), most(width))
    history = [[start[:, cut] for cut in cuts(width, parts)]]
    groups = [dealt(c.astype(np.float64)) for c in history[0]]
    totals = [np.zeros((len(c), 1 + c.shape[1]), np.int64) for c in history[0]]
    label = rows.schema["label"].dataType.simpleString()
    state = rows.mapInArrow(lambda it: _packed(it, width), f"id long, label {label}, x binary")
    path = None
    for number in range(rounds):
        former, path = path, scratch_path(spark, f"codes-round{number}")
        state = _round(state, history, groups, STATE.format(label=label), path)
        if former:
            remove(spark, former)
        _update(totals, state, width)
        history.append([np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), c)
                        for t, c in zip(totals, history[-1], strict=True)])
    coded = save(_step(state, history, groups, f"id long, label {label}, code string, error long", True), "codes")
    if path:
        remove(spark, path)
    return coded, history[-1]


def _step(state: DataFrame, history, groups, schema: str, last: bool) -> DataFrame:
    rounds = [list(h) for h in history]  # as of now: the caller's list grows
    return state.mapInArrow(lambda it: _assigned(it, rounds, groups, last), schema)


def _round(state: DataFrame, history, groups, schema: str, path: str) -> DataFrame:
    return save(_step(state, history, groups, schema, False), "codes", path=path)


def codebook_digest(codebooks: list[np.ndarray]) -> str:
    """sha256 of the decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the sum of ``error`` over rows of equal label, nulls together."""
    sums = (coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))
    return (coded.join(small_side(sums, reuse=True), F.col("label").eqNullSafe(F.col("of")), "left").drop("of"))
