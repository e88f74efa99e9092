"""Centroid clustering on integers: distances by the GEMM expansion |x|^2 - 2 x.c + |c|^2, sums by treeAggregate.

A component x becomes the integer floor(1024 * x). Vectors are packed into blocks of some thousand rows, and a block's distances
to all centroids are one float64 matrix product. That is exact as long as every term stays under 2^53 (`_fits`); rows
that could pass it are computed in 64-bit integers, and beyond 2^63 in Python's own. Each round reads the packed blocks,
and only one row of sums and counts a centroid leaves a task; treeAggregate adds them on the way, so that the driver
holds centroids and sums, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import staged

#: Vectors in a packed block: 2 MiB at 64 components.
BLOCK = 4096
_EXACT_FLOAT, _EXACT_LONG = 2**53, 2**63
_ROWS_IN_INTEGERS = 256


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): float64 where that is exact (each float64 of 2^53 or more is an integer), else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * 1024)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[int(v // 1) * 1024 if abs(v) > 2.0**60 else int(np.floor(v * 1024)) for v in row] for row in x], dtype=object).reshape(x.shape)


def _fits(most_x, most_c, size: int, limit: int) -> bool:
    """No term, and no partial sum of terms, of a squared distance reaches the limit."""
    return size * (int(most_x) + int(most_c)) ** 2 < limit


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of each row to each centroid, exact: int64, or Python integers where a row needs them."""
    n, size = x.shape
    most_c = max(abs(v) for c in centroids for v in c)
    if not n:
        return np.zeros((0, len(centroids)), np.int64)
    most_x = np.abs(x).max(axis=1)
    if x.dtype != object and _fits(most_x.max(), most_c, size, _EXACT_FLOAT):
        c = np.array(centroids, np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)
    small = np.array([_fits(m, most_c, size, _EXACT_FLOAT) for m in most_x])
    out = np.empty((n, len(centroids)), object)
    if small.any():
        out[small] = distances(x[small].astype(np.float64), centroids)
    rest = np.flatnonzero(~small)
    for at in range(0, len(rest), _ROWS_IN_INTEGERS):
        rows = rest[at : at + _ROWS_IN_INTEGERS]
        kind = np.int64 if _fits(most_x[rows].max(), most_c, size, _EXACT_LONG) else object
        whole = np.array([[int(v) for v in row] for row in x[rows]], dtype=kind)
        for j, c in enumerate(centroids):
            out[rows, j] = ((whole - np.array(c, dtype=kind)) ** 2).sum(axis=1)
    return out


def _column_sums(x: np.ndarray) -> list[int]:
    if x.dtype != object and len(x) * int(np.abs(x).max(initial=0)) < _EXACT_FLOAT:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(int(v) for v in column) for column in x.T]


@dataclass(frozen=True)
class Sums:
    """For each centroid: vectors, componentwise sum, sum of squared distances."""

    count: tuple[int, ...]
    total: tuple[tuple[int, ...], ...]
    inertia: tuple[int, ...]

    @staticmethod
    def none(k: int, size: int) -> Sums:
        return Sums((0,) * k, ((0,) * size,) * k, (0,) * k)

    def plus(self, other: Sums) -> Sums:
        return Sums(
            tuple(a + b for a, b in zip(self.count, other.count, strict=True)),
            tuple(tuple(a + b for a, b in zip(x, y, strict=True)) for x, y in zip(self.total, other.total, strict=True)),
            tuple(a + b for a, b in zip(self.inertia, other.inertia, strict=True)),
        )


def _block_sums(block: bytes, size: int, centroids: list[list[int]]) -> Sums:
    x = integers(np.frombuffer(block, np.float64).reshape(-1, size))
    d = distances(x, centroids)
    nearest = d.argmin(axis=1)
    members = [nearest == j for j in range(len(centroids))]
    return Sums(tuple(int(m.sum()) for m in members), tuple(tuple(_column_sums(x[m])) for m in members), tuple(sum(int(v) for v in d[m, j]) for j, m in enumerate(members)))


def packed(vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(ids, block): the finite vectors of so many components, as rows of float64, some thousand to a row."""
    kept = vectors.where((F.size(vector) == size) & finite(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    kind = T.StructType([T.StructField("ids", T.ArrayType(kept.schema["id"].dataType)), T.StructField("block", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float64).reshape(-1, size)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                ids = batch.column("id").slice(at, len(part))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(part)], ids), pa.array([part.tobytes()], pa.binary())], ["ids", "block"])

    return kept.mapInArrow(pack, kind)


def first_centroids(vectors: DataFrame, key: str, vector: str, size: int, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:key`, in that order; a null key comes last, equal keys by their components."""
    kept = vectors.where((F.size(vector) == size) & finite(F.col(vector))).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("h"), F.col(vector).cast("array<double>").alias("x"))
    return [[int(v) for v in integers(np.array([r["x"]]))[0]] for r in kept.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """One row for each vector that takes part: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another number of components, or hold null or non-finite ones, have no row. Ties go to the
    smaller cluster. A cluster without vectors keeps its centroid. With fewer vectors than k there are as many clusters as vectors;
    an empty table gives an empty result. Rows that repeat a key are vectors of their own. A number that does not fit
    into a long is null in the result; the assignment is exact even then. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    more = ("cluster_inertia", "inertia", "centroid_sha256")
    centroids = first_centroids(vectors, key, vector, size, k, seed)
    if not centroids:
        return spark.createDataFrame([], T.StructType([*kind, T.StructField(more[0], T.LongType()), T.StructField(more[1], T.LongType()), T.StructField(more[2], T.StringType())]))
    blocks = staged(packed(vectors, key, vector, size), "centroid-blocks")
    rows = blocks.select("block").rdd

    def summed(now: list[list[int]]) -> Sums:
        return rows.treeAggregate(Sums.none(len(now), size), lambda acc, row: acc.plus(_block_sums(row["block"], size, now)), Sums.plus)

    for _ in range(rounds):
        found = summed(centroids)
        moved = [[s // n for s in total] if n else c for c, n, total in zip(centroids, found.count, found.total, strict=True)]
        if moved == centroids:  # every further round would find the same
            break
        centroids = moved
    inertia = summed(centroids).inertia

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in zip(batch.column("ids"), batch.column("block"), strict=True):
                d = distances(integers(np.frombuffer(block.as_py(), np.float64).reshape(-1, size)), centroids)
                nearest = d.argmin(axis=1)
                least = d[np.arange(len(d)), nearest]
                least = pa.array([_long(v) for v in least], pa.int64()) if least.dtype == object else pa.array(least)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(nearest.astype(np.int32)), least], [key, "cluster", "distance"])

    def of_cluster(values: list, type_: str) -> Column:
        return F.get(F.array(*(F.lit(v).cast(type_) for v in values)), F.col("cluster"))

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = blocks.mapInArrow(assign, kind)
    return out.select(key, "cluster", "distance", of_cluster([_long(v) for v in inertia], "long").alias(more[0]), F.lit(_long(sum(inertia))).cast("long").alias(more[1]), of_cluster(digests, "string").alias(more[2]))


def _long(v: int) -> int | None:
    return int(v) if v < _EXACT_LONG else None


def oracle_sql(size: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The same by joins on (vector, component) and (centroid, component) in 128-bit integers, a few common tables for each round."""
    steps = [
        f"kept as materialized (select vec_id, embedding from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"v as materialized (select vec_id, generate_subscripts(embedding, 1) as i, cast(floor(1024 * cast(unnest(embedding) as double)) as hugeint) as x from kept)",
        f"first as (select vec_id, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as j from kept qualify j < {k})",
        "c0 as materialized (select j, i, x as c from v join first using (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select vec_id, min_by(j, (d, j)) as j, min(d) as d from (select vec_id, j, sum((x - c) * (x - c)) as d from v join c{r} using (i) group by vec_id, j) group by vec_id)")
        if r < rounds:
            steps.append(f"m{r} as materialized (select j, i, sum(x) as s, count(*) as n from v join a{r} using (vec_id) group by j, i)")
            steps.append(f"c{r + 1} as materialized (select j, i, coalesce((s - ((s % n) + n) % n) // n, c) as c from c{r} left join m{r} using (j, i))")
    steps.append(f"digest as (select j, sha256(string_agg(cast(c as varchar), ',' order by i)) as centroid_sha256 from c{rounds} group by j)")
    return f"""with {', '.join(steps)}
select vec_id, cast(j as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by j) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, centroid_sha256
from a{rounds} join digest using (j)"""
