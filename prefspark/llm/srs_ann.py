"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Every vector is projected to ``PROJECTIONS`` dimensions by a Gaussian matrix (a 2-stable
distribution): the squared ratio of projected to original distance of a pair follows the chi-square
distribution with that many degrees of freedom. A query takes projected neighbours in increasing
distance and verifies their original distances, until a vector nearer than its k-th best would
show up at the next projected distance or beyond with probability under 1 - ``STOP`` only.

The index is a kd-tree over the projections. Its upper levels, fitted on a bounded sample
(``SAMPLE_ROWS`` rows), cut all rows into blocks; the lower levels are built within a block. A query
searches its own block first and then, with the k-th distance found, only the blocks that the
stopping test does not rule out. Blocks and chunks of queries meet in tasks of bounded size; a block is
copied once for each ``QUERY_CHUNK`` queries that ask for it, and not at all if none does.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id,
take no part. Vectors of different lengths are never compared. If an id has several vectors the
smallest one counts. Equal vectors are indexed once, with their k + 1 smallest ids (no more
can be among the nearest, ties going to smaller ids). Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import bounded_sample, prepare, save

PROJECTIONS = 8  # even: see ``chi2_cdf``
STOP = 0.97
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 20_000
QUERY_CHUNK = 4_000
LEAF_ROWS = 64
SEED = 4
FOUND = "query_id long, vec_id long, score double"


def chi2_cdf(x: float) -> float:
    """Chi-square distribution function with ``PROJECTIONS`` (even) degrees of freedom."""
    half, term, total = x / 2.0, 1.0, 0.0
    for i in range(PROJECTIONS // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total if half < 700 else 1.0


def _stop_ratio() -> float:
    """The projected to k-th distance ratio, squared, from which on the test stops."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if chi2_cdf(middle) >= STOP else (middle, high)
    return high


STOP_RATIO = _stop_ratio()


@lru_cache(maxsize=16)
def projection(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one per id."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd
                   & F.exists("embedding", lambda x: x != 0))
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


# ---- upper tree: blocks ----------------------------------------------------------------------

class Blocks:
    """Upper levels of the kd-tree for each vector length: nested (axis, cut, low side, high side),
    with block numbers as leaves."""

    def __init__(self, sample: dict[int, np.ndarray], rows: dict[int, int]):
        self.trees, self.count = {}, 0
        for dim in sorted(rows):
            depth = math.ceil(math.log2(max(1.0, rows[dim] / BLOCK_ROWS)))
            self.trees[dim] = self._cut(sample.get(dim, np.zeros((0, PROJECTIONS))), depth)

    def _cut(self, points: np.ndarray, depth: int):
        if depth == 0 or len(points) < 2:
            self.count += 1
            return self.count - 1
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        cut = float(np.median(points[:, axis]))
        low = points[:, axis] < cut
        if low.all() or not low.any():
            self.count += 1
            return self.count - 1
        return axis, cut, self._cut(points[low], depth - 1), self._cut(points[~low], depth - 1)

    def home(self, point: np.ndarray, dim: int) -> int:
        node = self.trees[dim]
        while isinstance(node, tuple):
            axis, cut, low, high = node
            node = low if point[axis] < cut else high
        return node

    def within(self, point: np.ndarray, dim: int, radius2: float) -> list[int]:
        """Blocks whose cell is nearer to ``point`` than the square root of ``radius2``."""
        found, todo = [], [(self.trees[dim], np.zeros(PROJECTIONS))]
        while todo:
            node, gap = todo.pop()
            if not isinstance(node, tuple):
                found.append(node)
                continue
            axis, cut, low, high = node
            near, far = (low, high) if point[axis] < cut else (high, low)
            todo.append((near, gap))
            beyond = gap.copy()
            beyond[axis] = max(gap[axis], abs(point[axis] - cut))
            if float(beyond @ beyond) < radius2:
                todo.append((far, beyond))
        return found


def _indexed(frames):
    """Vectors with their projections and lengths; those of one length are projected together."""
    for pdf in frames:
        dims = pdf["embedding"].map(len).to_numpy(dtype="int32")
        points = np.zeros((len(pdf), PROJECTIONS))
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            points[own] = np.stack([np.asarray(pdf["embedding"].iat[i], float) for i in own]) @ projection(int(dim))
        yield pdf.assign(dim=dims, point=points.tolist())


def fit_blocks(index: DataFrame) -> Blocks:
    rows = {r["dim"]: r["n"] for r in index.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sample = bounded_sample(index.select("dim", "point", F.col("ids")[0].alias("id")), "id", SAMPLE_ROWS).toPandas()
    points = {int(d): np.stack(list(g)) for d, g in sample.groupby("dim")["point"]}
    return Blocks(points, rows)


# ---- search within a block -------------------------------------------------------------------

class Tree:
    """kd-tree over the projections of a block; leaves are slices of the permuted rows."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple] = []  # (begin, end, low corner, high corner, children or None)
        self._build(0, len(points))

    def _build(self, begin: int, end: int) -> int:
        own = self.points[self.order[begin:end]]
        low, high = own.min(axis=0), own.max(axis=0)
        number = len(self.nodes)
        self.nodes.append((begin, end, low, high, None))
        axis = int(np.argmax(high - low))
        if end - begin > LEAF_ROWS and high[axis] > low[axis]:
            half = (end - begin) // 2
            part = np.argpartition(own[:, axis], half)
            self.order[begin:end] = self.order[begin:end][part]
            children = self._build(begin, begin + half), self._build(begin + half, end)
            self.nodes[number] = (begin, end, low, high, children)
        return number

    def _gap2(self, number: int, point: np.ndarray) -> float:
        _, _, low, high, _ = self.nodes[number]
        gap = np.maximum(0.0, np.maximum(low - point, point - high))
        return float(gap @ gap)

    def leaves(self, point: np.ndarray):
        """(squared projected distance, rows) of leaves, nearest first."""
        heap = [(self._gap2(0, point), 0)]
        while heap:
            gap2, number = heapq.heappop(heap)
            begin, end, _, _, children = self.nodes[number]
            if children is None:
                yield gap2, self.order[begin:end]
            else:
                for child in children:
                    heapq.heappush(heap, (max(gap2, self._gap2(child, point)), child))


def search(tree: Tree, vectors: np.ndarray, ids: list, query: np.ndarray, point: np.ndarray,
           query_id: int, k: int, bound: float) -> list[tuple[float, int]]:
    """The nearest found in a block, (distance, id), at most k and none beyond ``bound``."""
    best: list[tuple[float, int]] = []
    for gap2, rows in tree.leaves(point):
        if gap2 >= STOP_RATIO * bound * bound and bound < math.inf:
            break
        distances = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
        near = np.flatnonzero(distances <= bound)
        if len(near):
            best += [(float(distances[r]), int(i)) for r in near for i in ids[rows[r]] if i != query_id]
            best.sort()
            del best[k:]
            if len(best) == k:
                bound = min(bound, best[-1][0])
    return best


def _search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(rows) and len(queries):
        vectors = np.stack([np.asarray(e, float) for e in rows["embedding"]])
        tree = Tree(np.stack([np.asarray(p, float) for p in rows["point"]]))
        ids = [list(i) for i in rows["ids"]]
        for query_id, e, p, bound in zip(queries["query_id"], queries["embedding"], queries["point"],
                                         queries["bound"], strict=True):
            out += [(query_id, i, d) for d, i in search(tree, vectors, ids, np.asarray(e, float),
                                                        np.asarray(p, float), query_id, k, bound)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _chunked(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the blocks asked for, once for each ``QUERY_CHUNK`` queries of their block, and the queries
    dealt to these chunks. A block that no query asks for is not moved."""
    chunks = F.ceil(F.count("*") / QUERY_CHUNK).cast("int")
    asked = save(queries.groupBy("block").agg(chunks.alias("chunks")), "ann-asked")
    rows = index.join(asked, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = queries.join(asked, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    return rows.drop("chunks"), dealt.drop("chunks")


def _searched(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Results of all (block, query) pairs of ``queries``."""
    rows, dealt = _chunked(index, queries)
    keys = ["block", "chunk"]
    return rows.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
        lambda r, q: _search_block(r, q, k), FOUND)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for every row of ``vectors`` (vec_id,
    embedding) that ``is_query`` (a condition on vec_id) holds for."""
    prepare(vectors.sparkSession)
    rows = save(usable(vectors), "ann-rows")
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = (rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
                .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    base = "ids array<bigint>, embedding array<double>, dim int, point array<double>"
    projected = save(distinct.select("ids", "embedding").mapInPandas(_indexed, base), "ann-points")
    blocks = fit_blocks(projected)

    def placed(frames):
        for pdf in frames:
            yield pdf.assign(block=pd.Series([blocks.home(np.asarray(p), d) for p, d in
                                              zip(pdf["point"], pdf["dim"], strict=True)],
                                             index=pdf.index, dtype="int32"))

    index = save(projected.mapInPandas(placed, base + ", block int"), "ann-index").select(
        "block", "ids", "embedding", "point")
    query_base = "query_id long, embedding array<double>, dim int, point array<double>"
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    queries = save(asked.mapInPandas(_indexed, query_base), "ann-queries")

    def at_home(frames):
        for pdf in frames:
            own = [blocks.home(np.asarray(p), d) for p, d in zip(pdf["point"], pdf["dim"], strict=True)]
            yield pdf.assign(bound=math.inf, block=pd.Series(own, index=pdf.index, dtype="int32"))

    def elsewhere(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                point = np.asarray(row.point)
                home = blocks.home(point, row.dim)
                reach = STOP_RATIO * row.bound * row.bound
                out += [(row.query_id, row.embedding, row.dim, row.point, row.bound, b)
                        for b in blocks.within(point, row.dim, reach) if b != home]
            yield pd.DataFrame(out, columns=["query_id", "embedding", "dim", "point", "bound", "block"]).astype(
                {"query_id": "int64", "dim": "int32", "bound": "float64", "block": "int32"})

    with_block = query_base + ", bound double, block int"
    first = save(_searched(index, save(queries.mapInPandas(at_home, with_block), "ann-home"), k), "ann-first")
    # distance of the k-th nearest so far; without k of them there is no bound yet
    bounds = first.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    open_queries = queries.join(bounds, "query_id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf"))))
    second = _searched(index, save(open_queries.mapInPandas(elsewhere, with_block), "ann-open"), k)
    return _nearest(first.union(second), k).select("query_id", "rank", "vec_id", "score")
