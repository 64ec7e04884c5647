"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of documents in table order. A round (window) visits each queue once: the
queue's deficit grows by its quantum, it gives as many whole tokens as the deficit holds and keeps
the rest of the deficit for the next round. Quanta are proportional to the target token shares
and sum up to ``window_tokens``; when a queue runs dry, the quanta of the others are set anew.
The stream of all rounds is cut into sequences of ``max_tokens``.

Deficits are fixed-point numbers (``FRACTION_BITS`` after the point), so after w rounds a queue has
given ``(quantum * w) >> FRACTION_BITS`` tokens: the state at any window is known in closed form.
No state has to be handed from window to window or partition to partition, and each
document finds its own windows, offsets and cuts from its place in its queue: a prefix sum over
per-partition token counts. Only one row per (partition, source) is summed; the driver holds one
row per queue. Where there are more sources than ``QUEUES``, the largest and those with a target have
queues of their own and all others share one: its quantum is the sum of theirs, and it is served
in table order of partitions, by source in each. A caller may set ``MAX_SOURCES`` to
refuse more sources than that.

Nulls: a null text is the empty document (its end id only), a null source is a queue of its own;
repeated rows are packed as often as they occur, whatever their doc_id. An empty table gives no
rows. Only doc_id, text and source are looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import prepare, save, text_or_empty
from prefspark.llm.pieces import byte_pieces, tokenizer_path

MAX_TOKENS = 1024
WINDOW_TOKENS = 64 * MAX_TOKENS
FRACTION_BITS = 16
MAX_SOURCES: int | None = None
QUEUES = 2_000  # own queues of sources without a target, at most
SHARED = "*"  # the queue of all others; the names of own queues begin with = or -
BLOCK_CELLS = 1 << 20  # windows times queues looked at together
END_ID = 0
FRAME_BYTES = 8 << 20  # ids handed on at a time
ENCODED = "part int, queue string, doc_id long, doc_tokens long, queue_start long, ids binary"
PIECES = ("doc_id long, start long, length long, sequence_id long, offset long, doc_tokens long, "
          "window long, source string, ids binary")


class Schedule:
    """Tokens given by each queue after w windows, for any w.

    ``phases``: (first window, credit of each queue there, quantum of each queue), fixed-point.
    """

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None, window_tokens: int):
        self.names = sorted(totals)
        self.totals = np.array([totals[n] for n in self.names], np.int64)
        shares = (np.array([float(targets.get(n, 0.0)) for n in self.names])
                  if targets else self.totals.astype(float))
        full = self.totals << FRACTION_BITS
        credit, window, self.phases = np.zeros_like(full), 0, []
        while (credit < full).any():
            active = credit < full
            share = np.where(active, shares, 0.0)
            if share.sum() <= 0:  # only queues without a target are left: by what they hold
                share = np.where(active, self.totals, 0).astype(float)
            quantum = np.floor(share / share.sum() * (window_tokens << FRACTION_BITS)).astype(np.int64)
            quantum = np.where(share > 0, np.maximum(quantum, 1), 0)
            self.phases.append((window, credit, quantum))
            going = quantum > 0
            rounds = int((-((credit - full)[going] // quantum[going])).min())
            credit = np.minimum(full, credit + quantum * rounds)
            window += rounds
        self.phases.append((window, credit, np.zeros_like(full)))
        self.begin = np.array([p[0] for p in self.phases], np.int64)
        self.credit = np.stack([p[1] for p in self.phases])
        self.quantum = np.stack([p[2] for p in self.phases])

    def given(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of every queue before each window: (windows, queues), exact integers."""
        k = np.searchsorted(self.begin, windows, "right") - 1
        grown = self.credit[k] + self.quantum[k] * (windows - self.begin[k])[:, None]
        return np.minimum(grown >> FRACTION_BITS, self.totals)

    def given_by(self, queue: int, windows: np.ndarray) -> np.ndarray:
        """Tokens of one queue before each window."""
        k = np.searchsorted(self.begin, windows, "right") - 1
        grown = self.credit[k, queue] + self.quantum[k, queue] * (windows - self.begin[k])
        return np.minimum(grown >> FRACTION_BITS, self.totals[queue])

    def window_of(self, queue: int, position: int) -> int:
        """The window in which a queue gives its token ``position``."""
        need = (position + 1) << FRACTION_BITS
        k = int(np.searchsorted(self.credit[:, queue], need, "left")) - 1
        missing = need - int(self.credit[k, queue])
        return int(self.begin[k]) + -(-missing // int(self.quantum[k, queue])) - 1

    def place(self, queue: int, start: int, count: int, max_tokens: int):
        """Where tokens start .. start + count of a queue go: (from, length, sequence, offset,
        window) for each cut piece; ``from`` counts from 0 within these tokens."""
        first, last = self.window_of(queue, start), self.window_of(queue, start + count - 1)
        for begin in range(first, last + 1, BLOCK_CELLS):
            windows = np.arange(begin, min(begin + BLOCK_CELLS, last + 1) + 1)
            own = self.given_by(queue, windows)
            giving = np.flatnonzero(own[1:] > own[:-1])  # a small queue gives nothing in most windows
            step = max(BLOCK_CELLS // len(self.names), 1)
            for at in range(0, len(giving), step):
                part = giving[at:at + step]
                yield from self._cut(queue, start, count, max_tokens, windows[part], own[part], own[part + 1])

    def _cut(self, queue: int, start: int, count: int, max_tokens: int, windows, given, after):
        # tokens of all queues before the window, and of the queues before this one in it
        before = self.given(windows)[:, queue:].sum(axis=1) + self.given(windows + 1)[:, :queue].sum(axis=1)
        for k, window in enumerate(windows.tolist()):
            low = max(start, int(given[k]))
            high = min(start + count, int(after[k]))
            at = int(before[k]) + low - int(given[k])
            while low < high:
                n = min(high - low, max_tokens - at % max_tokens)
                yield low - start, n, at // max_tokens, at % max_tokens, window
                low, at = low + n, at + n


def _encode(frames, json_path: str, ranks_path: str):
    from pyspark import TaskContext

    encoder = byte_pieces(json_path, ranks_path)
    end = np.array([END_ID], "<u4").tobytes()
    part, given = TaskContext.get().partitionId(), {}
    names = [c.split()[0] for c in ENCODED.split(", ")]
    for pdf in frames:
        rows, held = [], 0
        for doc_id, text, source in zip(pdf["doc_id"], pdf["text"], pdf["source"], strict=True):
            ids = encoder.encode(text_or_empty(text)) + end
            # the queue's name: null and the empty string stay apart
            queue = "=" + source if isinstance(source, str) else "-"
            n, start = len(ids) // 4, given.get(queue, 0)
            given[queue] = start + n
            rows.append((part, queue, doc_id, n, start, ids))
            held += len(ids)
            if held > FRAME_BYTES:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def _cut(frames, schedule: Schedule, max_tokens: int):
    index = {name: k for k, name in enumerate(schedule.names)}
    names = [c.split()[0] for c in PIECES.split(", ")]
    for pdf in frames:
        rows = []
        for queue, served, doc_id, n, start, ids in zip(pdf["queue"], pdf["served"], pdf["doc_id"],
                                                        pdf["doc_tokens"], pdf["start"], pdf["ids"], strict=True):
            source = queue[1:] if queue[0] == "=" else None
            for low, length, sequence, offset, window in schedule.place(
                    index[served], int(start), int(n), max_tokens):
                rows.append((doc_id, low, length, sequence, offset, n, window, source,
                             ids[4 * low:4 * (low + length)]))
            if len(rows) > 2_000:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                rows = []
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, targets: dict[str, float] | None = None, max_tokens: int = MAX_TOKENS,
         window_tokens: int = WINDOW_TOKENS, json_path: str | None = None,
         ranks_path: str | None = None) -> DataFrame:
    """One row per piece with its ids. ``targets``: token share of each source (sources missing
    there come last); default: the sources' shares of the corpus, so that every window mirrors
    it and all queues end together."""
    spark = docs.sparkSession
    prepare(spark)
    json_path = json_path or tokenizer_path("byte_bpe_50k.json")
    ranks_path = ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = save(docs.select("doc_id", "text", "source").mapInPandas(
        lambda it: _encode(it, json_path, ranks_path), ENCODED), "pack-ids", "zstd")
    sums = save(encoded.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("tokens")), "pack-sums")
    sources = save(sums.groupBy("queue").agg(F.sum("tokens").alias("tokens")), "pack-sources")
    n_sources, n_tokens = sources.agg(F.count("*"), F.sum("tokens")).first()
    if MAX_SOURCES is not None and n_sources > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
    named = {"=" + k: v for k, v in targets.items()} if targets else None
    top = sources.orderBy(F.desc("tokens"), "queue").limit(QUEUES)
    if named and n_sources > QUEUES:
        wanted = spark.createDataFrame([(k,) for k in named], "queue string")
        top = top.union(sources.join(F.broadcast(wanted), "queue", "left_semi").select(*sources.columns))
    totals = {r["queue"]: r["tokens"] for r in top.collect()}
    served = F.col("queue")
    if n_sources > len(totals):
        own = spark.createDataFrame([(k, k) for k in totals], "queue string, served string")
        sums = sums.join(F.broadcast(own), "queue", "left")
        served = F.coalesce("served", F.lit(SHARED))
        totals[SHARED] = n_tokens - sum(totals.values())
    schedule = spark.sparkContext.broadcast(Schedule(totals, named, window_tokens))
    # a queue's tokens before each partition, and in it before each of its sources
    each = sums.select("queue", "part", "tokens", served.alias("served"))
    parts = each.groupBy("served", "part").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("served").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("served", "part").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("served", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("earlier"))
    each = each.select("queue", "part", "served", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("inside"))
    # written, so that the planner knows its size and sends it to every executor only if it is small
    bases = save(each.join(parts, ["served", "part"]).select(
        "queue", "part", "served", (F.col("earlier") + F.col("inside")).alias("base")), "pack-bases")
    places = encoded.join(bases, ["queue", "part"]).select(
        "queue", "served", "doc_id", "doc_tokens", (F.col("base") + F.col("queue_start")).alias("start"), "ids")
    return places.mapInPandas(lambda it: _cut(it, schedule.value, max_tokens), PIECES)


def padded_length(tokens: int, max_tokens: int = MAX_TOKENS) -> int:
    """A sequence's stored length: a power of two stays, everything else is padded."""
    return tokens if tokens & (tokens - 1) == 0 else max_tokens


def crc32_of(ids) -> int:
    return zlib.crc32(ids)
