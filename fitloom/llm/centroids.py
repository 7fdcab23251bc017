"""Centroid clustering of integer vectors with exact distances, spared by a table of pivots.

A few starting centroids are pivots. Each vector's distances to them are worked out once and stored beside it. In a round, the
distances of the k centroids to the pivots are known too, and |d(vector, pivot) - d(centroid, pivot)| is never more than
d(vector, centroid): centroids are tried from the smallest such bound on, and as soon as the bound is above the best distance
found, none is left to try. Bounds are floating point with room for rounding; distances that decide are integers.

A round reads the stored table, and each task sends at most k rows of sums and counts, which Spark adds up; the driver holds k
centroids and nothing of the vectors, so no lineage grows and a lost executor costs one task's reading. One cluster, or one vector
repeated, may hold any share of the rows: nothing is grouped by task.

Kept are vectors with exactly ``dims`` components, none null or not finite; others are no rows of the result. A component whose
integer is beyond 2^27 is an error, as distances must fit in a long. A null id is an id (hashed as an empty one); rows that repeat an id are each a
vector; equal hashes are started from in the order of their components. With fewer than k vectors, each is a centroid; an empty table gives
no rows. Other columns aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.rows import lean
from fitloom.plans.scratch import Scratch

PIVOTS = 8
LIMIT = 1 << 27
#: Relative and absolute room for rounding in bounds.
ROOM, LEAST = 1e-12, 1e-9


def quantised(vectors: DataFrame, id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """id and v, the components as integers floor(scale * x), of the vectors that are kept."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("x")).filter((F.size("x") == dims) & F.forall("x", finite))
    v = F.transform("x", lambda x: F.floor(x * scale))
    fits = F.forall(v, lambda x: x.between(-LIMIT, LIMIT))
    return kept.select("id", F.when(fits, v).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT}"))).cast("array<int>").alias("v"))


def matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims).astype(kind, copy=False)


def to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``v`` to each pivot."""
    return np.sqrt(np.stack([((v - p) ** 2).sum(1) for p in pivots], axis=1).astype(np.float64))


def nearest(v: np.ndarray, known: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (of equals the smaller number), squared distance, and how many distances were worked out.

    known: the rows' distances to the pivots."""
    of_centroids = to_pivots(centroids, pivots)
    bound = np.zeros((len(v), len(centroids)))
    for p in range(len(pivots)):
        gap = np.abs(known[:, p, None] - of_centroids[None, :, p])
        np.maximum(bound, gap - ROOM * (known[:, p, None] + of_centroids[None, :, p]) - LEAST, out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1) ** 2 * (1 - ROOM)
    best, at, tried = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64), 0
    rows = np.arange(len(v))
    for i in range(len(centroids)):
        rows = rows[bound[rows, i] <= best[rows]]
        if not len(rows):
            break
        tried += len(rows)
        k = order[rows, i]
        d = ((v[rows] - centroids[k]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
        best[rows[better]], at[rows[better]] = d[better], k[better]
    return at, best, tried


def _first(table: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes, in their order: k rows come to the driver."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = table.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _spread_out(starts: np.ndarray, n: int) -> np.ndarray:
    """n of the starts, each the farthest from those before it."""
    chosen = [0]
    away = ((starts - starts[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(starts)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((starts - starts[chosen[-1]]) ** 2).sum(1))
    return starts[chosen]


def _sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list:
    """cluster, n and the sums of the components of every cluster that has a vector."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), dims, np.int64)
            at, _, _ = nearest(v, matrix(batch.column("known"), len(pivots), np.float64), centroids, pivots)
            order = np.argsort(at, kind="stable")
            there, starts = np.unique(at[order], return_index=True)
            if len(there):
                total[there] += np.add.reduceat(v[order], starts, axis=0)
                count += np.bincount(at, minlength=k)
        there = np.flatnonzero(count)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[there].ravel()), dims).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), sums], ["cluster", "n", "sums"])

    parts = table.select("v", "known").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    return parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect()


def clusters(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int, id: str = "vec_id", embedding: str = "embedding", n_pivots: int = PIVOTS) -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), cluster_inertia and inertia (sums of distances), centroid (its final components).

    Centroids start as the k vectors of the smallest sha256 of ``seed:id``. A round assigns all vectors and moves each centroid to the floor of
    its vectors' mean; after the last one vectors are assigned once more."""
    spark = vectors.sparkSession
    lean(spark)
    scratch = Scratch(spark, "centroids")
    centroids = _first(quantised(vectors, id, embedding, dims, scale), k, seed)
    out = f"id {vectors.schema[id].dataType.simpleString()}, "
    if not len(centroids):
        return spark.createDataFrame([], out.replace("id ", f"{id} ", 1) + "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    pivots = _spread_out(centroids, n_pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pa.FixedSizeListArray.from_arrays(pa.array(to_pivots(matrix(batch.column("v"), dims, np.int64), pivots).ravel()), len(pivots))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), known.cast(pa.list_(pa.float64()))], ["id", "v", "known"])

    table = scratch.keep(quantised(vectors, id, embedding, dims, scale).mapInArrow(measure, out + "v array<int>, known array<double>"), "table")
    for _ in range(rounds):
        moved = centroids.copy()
        for row in _sums(table, centroids, pivots):
            moved[row.cluster] = [int(s) // int(row.n) for s in row.sums]
        if (moved == centroids).all():  # then no round changes anything
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d, _ = nearest(matrix(batch.column("v"), dims, np.int64), matrix(batch.column("known"), len(pivots), np.float64), centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int32()), pa.array(d)], ["id", "cluster", "distance"])

    found = scratch.only(table.mapInArrow(assign, out + "cluster int, distance bigint"), "found")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    per_cluster = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return found.select(
        F.col("id").alias(id), "cluster", "distance",
        per_cluster([inertia.get(c, 0) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        per_cluster([c.tolist() for c in centroids], "array<bigint>").alias("centroid"),
    )


def digest(components) -> F.Column:
    """sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(components, lambda x: x.cast("string")), ","), 256)


