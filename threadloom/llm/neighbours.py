"""Approximate nearest neighbours: Gaussian (2-stable) projections in a kd-tree, verified until a chi-square test stops the search.

Unit vectors are projected to PROJECTED dimensions by standard normal draws. For two vectors at distance d, the squared distance of
their projections over d^2 follows the chi-square distribution with PROJECTED degrees of freedom. So a query takes vectors in
the order of their projected distance, computes the real cosine of each, and stops once a vector as near as its k-th best would have come
by now with PROBABILITY. Each true neighbour is found with at least that chance, whatever the data.

The index is a kd-tree in two levels. Its top, at most 2^MOST_DEPTH cells, is fitted on about SAMPLE vectors and splits all of
them; a cell's vectors are dealt by hash into chunks of about CHUNK vectors, and each chunk is a stored row with a kd-tree of its own
over its leaves. A heap of copies is one cell with many chunks, never one row or task. Queries travel in blocks of
about QUERIES: first to the chunks of their own cell, which bounds their k-th distance, then to the cells that the bound reaches. A block
and a chunk meet in one row of a join, so tasks hold one of each. A query is sent to 2^MOST_DEPTH cells at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.centroids import finite
from threadloom.llm.common import draw_limit, numbered, staged

PROJECTED, PROBABILITY, SEED = 12, 0.97, 20
SAMPLE, MOST_DEPTH, CHUNK, LEAF, QUERIES = 20_000, 7, 4096, 64, 128
#: Far over the rounding of projections and cosines, far under any distance that matters.
_ROUNDING = 1e-9
#: Leaves whose vectors are projected together before the search looks at the test again: the first few, then more.
_FIRST_LEAVES = 2
#: Stands for the cosine of the k-th best while there are fewer than k.
_NO_BOUND = -2.0


def chi_square_quantile(probability: float, freedom: int) -> float:
    """Where the chi-square distribution with an even number of degrees of freedom reaches a probability."""

    def reached(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))

    low, high = 0.0, 1.0
    while reached(high) < probability:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < probability else (low, middle)
    return high


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish. Equal rows give equal results."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of one vector with each row, in double precision. Equal rows give equal results, wherever they stand."""
    q, v = query / np.abs(query).max(), vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (v * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(axis=1)))


def projected(vectors: np.ndarray) -> np.ndarray:
    size = vectors.shape[1]
    return unit(vectors) @ np.random.default_rng([SEED, size]).standard_normal((size, PROJECTED))


def reach(cosine: float, times: float) -> float:
    """Squared projected distance beyond which the test stops a search whose k-th best has this cosine."""
    return times * max(0.0, 2 - 2 * cosine) + _ROUNDING if cosine > _NO_BOUND else np.inf


class Cells:
    """The top of the kd-tree: at node i, rows over threshold[i] on axis[i] go right. Holds for all rows, not only for the sample."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.axis, self.threshold = depth, np.zeros(2**depth - 1, np.int32), np.zeros(2**depth - 1)
        self.low, self.high = np.full((2**depth, PROJECTED), -np.inf), np.full((2**depth, PROJECTED), np.inf)
        self._split(sample, 0, self.low[0].copy(), self.high[0].copy())

    def _split(self, rows: np.ndarray, node: int, low: np.ndarray, high: np.ndarray) -> None:
        if node >= len(self.axis):
            cell = node - len(self.axis)
            self.low[cell], self.high[cell] = low, high
            return
        axis = int(np.ptp(rows, axis=0).argmax()) if len(rows) else node % PROJECTED
        at = float(np.median(rows[:, axis])) if len(rows) else float(np.clip(0.0, low[axis], high[axis]))
        self.axis[node], self.threshold[node] = axis, at
        right = rows[:, axis] > at
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = at
        self._split(rows[~right], 2 * node + 1, low, below)
        self._split(rows[right], 2 * node + 2, above, high)

    def of(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (rows[np.arange(len(rows)), self.axis[node]] > self.threshold[node])
        return (node - len(self.axis)).astype(np.int32)

    def within(self, row: np.ndarray, radius2: float) -> np.ndarray:
        """The cells whose region lies within the radius."""
        return np.flatnonzero(box_distance(row, self.low, self.high) <= radius2).astype(np.int32)


def box_distance(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    return (np.maximum(0.0, np.maximum(low - row, row - high)) ** 2).sum(axis=1)


def leaves(rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order of the rows, and where each leaf of at most LEAF rows starts in it: median splits along the widest axis."""
    order, starts = np.arange(len(rows)), []
    parts = [(0, len(rows))]
    while parts:
        start, end = parts.pop()
        if end - start <= LEAF:
            starts.append(start)
            continue
        part, middle = order[start:end], (end - start) // 2
        axis = np.ptp(rows[part], axis=0).argmax()
        order[start:end] = part[np.argpartition(rows[part, axis], middle)]
        parts += [(start + middle, end), (start, start + middle)]
    return order, starts


class Chunk:
    """Vectors of a cell with the kd-tree of their projections."""

    def __init__(self, uids: np.ndarray, vectors: np.ndarray, starts: np.ndarray):
        self.uids, self.vectors, self.rows = uids, vectors, projected(vectors)
        self.starts, self.ends = starts, np.append(starts[1:], len(uids))
        self.low, self.high = np.minimum.reduceat(self.rows, starts), np.maximum.reduceat(self.rows, starts)

    def nearest(self, query: np.ndarray, uid: int, row: np.ndarray, k: int, bound: float, times: float) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k best with a cosine of at least bound, ties at the k-th place included."""
        edge = box_distance(row, self.low, self.high)
        order = np.argsort(edge, kind="stable")
        waiting, waiting_d = np.empty(0, np.int64), np.empty(0)
        best, best_c, k_th = np.empty(0, np.int64), np.empty(0), bound
        at, step = 0, _FIRST_LEAVES
        while at < len(order) or len(waiting):
            radius2 = reach(k_th, times)
            if at < len(order) and edge[order[at]] <= radius2:
                rows = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in order[at : at + step]])
                at, step = at + step, 2 * step
                waiting, waiting_d = np.append(waiting, rows), np.append(waiting_d, ((self.rows[rows] - row) ** 2).sum(axis=1))
                near = edge[order[at]] if at < len(order) else np.inf  # nothing still to come is nearer than that
            else:
                near = np.inf
                at = len(order)
            now = waiting_d <= min(near, radius2)
            rows = waiting[now]
            waiting, waiting_d = waiting[~now], waiting_d[~now]
            if near == np.inf:
                waiting = waiting[:0]  # beyond the radius: the test has stopped the search
                waiting_d = waiting_d[:0]
            rows = rows[self.uids[rows] != uid]
            if len(rows):
                c = cosines(query, self.vectors[rows])
                best, best_c = np.append(best, rows), np.append(best_c, c)
                if len(best) > k:
                    k_th = max(k_th, np.partition(best_c, len(best_c) - k)[len(best_c) - k])
                elif len(best) == k:
                    k_th = max(k_th, best_c.min())
                kept = best_c >= k_th
                best, best_c = best[kept], best_c[kept]
        return best, best_c


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.asarray(batch.column("vector").flatten(), np.float64).reshape(-1, size)


class Index:
    """The stored index over all vectors that take part, and the search in it."""

    def __init__(self, vectors: DataFrame, key: str, vector: str, query: Column):
        """query tells of each row whether it will be looked up."""
        item = "float" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "double"
        taken = finite(F.col(vector)) & F.exists(vector, lambda x: x != 0)
        rows = vectors.where(taken).select(F.col(key).alias("key"), F.col(vector).cast(f"array<{item}>").alias("vector"), F.coalesce(query, F.lit(False)).alias("asks"))
        rows = staged(numbered(rows, "uid"), "neighbour-rows")
        self.count = rows.count()
        drawn = rows.where((F.xxhash64("uid").bitwiseAND(2**63 - 1)) <= draw_limit(SAMPLE, self.count)).select("vector")
        sample = [np.asarray(r["vector"], np.float64)[None] for r in drawn.toLocalIterator()]
        depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, self.count) / CHUNK))))
        self.cells = cells = Cells(np.concatenate([projected(x) for x in sample]) if sample else np.zeros((0, PROJECTED)), depth)

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.asarray(pa.compute.list_value_length(batch.column("vector")))
                for size in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == size))
                    where = cells.of(projected(_matrix(part, int(size))))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(where), size, np.int32)), pa.array(where)], [*part.schema.names, "size", "cell"])

        self.rows = staged(rows.mapInArrow(routed, T.StructType([*rows.schema, T.StructField("size", T.IntegerType()), T.StructField("cell", T.IntegerType())])), "neighbour-routed")
        self.item = np.dtype("<f4" if item == "float" else "<f8")
        self.chunks = staged(self._packed(self.rows, CHUNK, tree=True), "neighbour-index")

    def _packed(self, rows: DataFrame, most: int, tree: bool) -> DataFrame:
        """About `most` rows of a (size, cell) to a row. The number of rows to expect comes from a count, so that none holds a hot cell."""
        parts = rows.groupBy("size", "cell").agg(F.ceil(F.count("*") / most).alias("parts"))
        dealt = rows.join(parts, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("uid", F.lit(SEED)), "parts").cast("int"))
        item, key = self.item, rows.schema["key"].dataType
        kind = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("keys", T.ArrayType(key)), T.StructField("uids", T.BinaryType()), T.StructField("vectors", T.BinaryType()), T.StructField("more", T.BinaryType())])

        def pack(group: pa.Table) -> pa.Table:
            size = group.column("size")[0].as_py()
            vectors = np.asarray(group.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, size)
            if tree:
                order, starts = leaves(projected(vectors))
                more = np.array(starts, np.int64)
            else:
                order, more = np.arange(len(vectors)), np.asarray(group.column("bound"), np.float64)
            keys = group.column("key").combine_chunks().take(pa.array(order))
            row = [pa.array([size], pa.int32()), pa.array([group.column("cell")[0].as_py()], pa.int32()), pa.array([group.column("part")[0].as_py()], pa.int32()), pa.ListArray.from_arrays([0, len(order)], keys)]
            return pa.Table.from_arrays([*row, *(pa.array([x.tobytes()], pa.binary()) for x in (np.asarray(group.column("uid"), np.int64)[order], vectors[order].astype(item), more))], kind.names)

        return dealt.groupBy("size", "cell", "part").applyInArrow(pack, kind)

    def _met(self, asked: DataFrame, k: int) -> DataFrame:
        """(asker, asker_key, key, uid, score): what the chunks of its cells have for each (uid, key, vector, bound, size, cell) that asks."""
        blocks = self._packed(asked, QUERIES, tree=False).select("size", "cell", F.col("keys").alias("q_keys"), F.col("uids").alias("q_uids"), F.col("vectors").alias("q_vectors"), F.col("more").alias("bounds"))
        key, item, times = asked.schema["key"].dataType, self.item, chi_square_quantile(PROBABILITY, PROJECTED)
        kind = T.StructType([T.StructField("asker", T.LongType()), T.StructField("asker_key", key), T.StructField("key", key), T.StructField("uid", T.LongType()), T.StructField("score", T.DoubleType())])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    size = batch.column("size")[i].as_py()
                    raw = {n: batch.column(n)[i].as_buffer() for n in ("uids", "vectors", "more", "q_uids", "q_vectors", "bounds")}
                    chunk = Chunk(np.frombuffer(raw["uids"], np.int64), np.frombuffer(raw["vectors"], item).reshape(-1, size).astype(np.float64), np.frombuffer(raw["more"], np.int64))
                    queries, asking, bounds = np.frombuffer(raw["q_vectors"], item).reshape(-1, size).astype(np.float64), np.frombuffer(raw["q_uids"], np.int64), np.frombuffer(raw["bounds"], np.float64)
                    at, found, scores = [], [], []
                    for n, row in enumerate(projected(queries)):
                        best, c = chunk.nearest(queries[n], asking[n], row, k, bounds[n], times)
                        at, found, scores = [*at, np.full(len(best), n)], [*found, best], [*scores, c]
                    at, found = np.concatenate(at), np.concatenate(found)
                    keys, q_keys = batch.column("keys")[i].values, batch.column("q_keys")[i].values
                    yield pa.RecordBatch.from_arrays([pa.array(asking[at]), q_keys.take(pa.array(at)), keys.take(pa.array(found)), pa.array(chunk.uids[found]), pa.array(np.concatenate(scores))], kind.names)

        return blocks.join(self.chunks, ["size", "cell"]).mapInArrow(search, kind)

    def searched(self, k: int = 5) -> DataFrame:
        """(query_id, rank, vec_id, score) of every row that asks."""
        first = staged(_best(self._met(self.rows.where("asks").withColumn("bound", F.lit(_NO_BOUND)).drop("asks"), k), k).drop("rank"), "neighbour-first")
        bounds = first.groupBy("asker").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(_NO_BOUND).alias("bound"))
        asking = self.rows.where("asks").drop("asks").join(bounds, F.col("uid") == F.col("asker"), "left").drop("asker").withColumn("bound", F.coalesce("bound", F.lit(_NO_BOUND)))
        cells, times = self.cells, chi_square_quantile(PROBABILITY, PROJECTED)

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list[int]] = [[] for _ in range(batch.num_rows)]
                sizes, home, bound = (np.asarray(batch.column(n)) for n in ("size", "cell", "bound"))
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    for i, row in zip(at, projected(_matrix(batch.take(pa.array(at)), int(size))), strict=True):
                        near = cells.within(row, reach(bound[i], times))
                        out[i] = near[near != home[i]].tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "others"])

        sent = asking.mapInArrow(reached, T.StructType([*asking.schema, T.StructField("others", T.ArrayType(T.IntegerType()))]))
        sent = staged(sent.withColumn("cell", F.explode("others")).drop("others"), "neighbour-sent")
        found = _best(first.unionByName(self._met(sent, k)), k)
        return found.select(F.col("asker_key").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each asker; ties to the smaller key, null keys last. The limit stands before the shuffle too."""
    order = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last("key"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine of each row whose key is divisible by `every`, of all other rows: query_id, rank, vec_id, score.

    Vectors that are null, empty, all zeros, or hold null or non-finite components take no part, neither as query nor as candidate. Only vectors
    of one length are compared. Ties go to the smaller key, null keys last. Rows that repeat a key are rows of their own: each may find
    the other, and each has its own k results. With fewer candidates than k all are returned; an empty table gives an empty result. Other
    columns are not read.
    """
    return Index(vectors, key, vector, F.col(key) % every == 0).searched(k)
