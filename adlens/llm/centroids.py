"""Centroid clustering of whole-number vectors with a table of pivot distances (LAESA).

The distance of every vector to a few fixed pivots is computed once and stored with it. In a round
only the distances between centroids and pivots are new. By the triangle inequality the difference
of two distances to one pivot bounds the distance from below, so a centroid whose bound is above the
best exact distance so far cannot win and is never compared; the others get exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.session import durable

#: Components of a vector, centroids, rounds, parts of one, pivots per centroid, vectors that pivots are chosen from.
SIZE, CLUSTERS, ROUNDS, SCALE, PIVOTS, SAMPLE = 64, 8, 10, 1024, 2, 4096
#: Largest component: with it squared distances of 64 components still fit in 64 bits.
LARGEST = 1 << 27
#: Relative room for the rounding of square roots in a bound.
ROOM = 1e-9


# ---- vectors and pivots


def _usable(vector: Column, size: int) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & sound, F.lit(False))


def _whole(vector: Column, scale: int) -> Column:
    def part(x: Column) -> Column:
        y = F.floor(x * F.lit(float(scale)))
        wrong = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}: squared distances need more than 64 bits"))
        return F.when(F.abs(x) * scale > LARGEST, wrong.cast("bigint")).otherwise(y)

    return F.transform(vector.cast("array<double>"), part)


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE,
                  scale: int = SCALE) -> DataFrame:
    """(key, v): vectors of exactly ``size`` components, none null or non-finite, as floor(scale * x)."""
    given = F.col(f"`{vector}`").cast("array<double>")
    return rows.where(_usable(given, size)).select(F.col(f"`{key}`").alias("key"), _whole(given, scale).alias("v"))


def _first_by_hash(vectors: DataFrame, prefix: str, n: int) -> np.ndarray:
    """The ``n`` vectors with the smallest SHA-256 of prefix and key; null keys come last, ties go by value."""
    digest = F.sha2(F.concat(F.lit(prefix), F.col("key").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").limit(n).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def choose_pivots(sample: np.ndarray, centroids: np.ndarray, rounds: int, sets: int) -> np.ndarray:
    """Points near which the centroids will be: where they stand on the sample after some of the rounds.

    A bound is tight where a pivot is near the centroid, d(x, c) >= d(x, p) - d(c, p).
    """
    if not len(sample):
        return centroids
    kept, at = {}, centroids
    for r in range(1, rounds + 1):
        distance = _roots(sample, at)
        number, at = distance.argmin(axis=1), at.copy()
        for j in range(len(at)):
            if (number == j).any():
                at[j] = sample[number == j].sum(axis=0) // (number == j).sum()
        kept[r] = at
    taken = sorted({rounds * (i + 1) // sets for i in range(sets)} - {0})
    return np.concatenate([kept[r] for r in taken] or [centroids])


def _roots(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all vectors to all points, as doubles."""
    out = np.empty((len(vectors), len(points)))
    for j, point in enumerate(points):
        out[:, j] = np.sqrt(((vectors - point) ** 2).sum(axis=1).astype(float))
    return out


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(key, v, d): ``vectors`` with their distances to the pivots, stored once for all rounds."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _roots(_matrix(batch.column("v"), np.int64), pivots)
                ends = np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]
                far = pa.ListArray.from_arrays(pa.array(ends), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), far], ["key", "v", "d"])

    kind = vectors.schema["key"].dataType.simpleString()
    return durable(vectors.mapInArrow(measure, f"key {kind}, v array<bigint>, d array<double>"))


# ---- one round


def nearest(vectors: np.ndarray, far: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray):
    """(number, squared distance, exact distances made) of the nearest centroid of each vector.

    ``far`` and ``of_centroids`` are the pivot distances of vectors and centroids. Equal distances
    go to the smaller number: a centroid is skipped only if its bound is above the best distance.
    """
    n, k = len(vectors), len(centroids)
    bound = np.zeros((n, k))
    for j in range(k):
        for p in range(far.shape[1]):
            gap = np.abs(far[:, p] - of_centroids[j, p]) - ROOM * (far[:, p] + of_centroids[j, p])
            np.maximum(bound[:, j], gap, out=bound[:, j])
    bound = bound * bound * (1 - ROOM)
    first = bound.argmin(axis=1)
    best = ((vectors - centroids[first]) ** 2).sum(axis=1)
    number, made = first.copy(), np.ones(n, np.int32)
    for j in range(k):
        at = np.flatnonzero((bound[:, j] <= best) & (first != j))
        made[at] += 1
        exact = ((vectors[at] - centroids[j]) ** 2).sum(axis=1)
        wins = (exact < best[at]) | ((exact == best[at]) & (j < number[at]))
        best[at[wins]], number[at[wins]] = exact[wins], j
    return number, best, made


def _per_batch(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray):
    of_centroids = _roots(centroids, pivots)
    for batch in batches:
        if batch.num_rows:
            vectors = _matrix(batch.column("v"), np.int64)
            yield batch, vectors, nearest(vectors, _matrix(batch.column("d"), float), centroids, of_centroids)


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floor of the mean of their vectors, empty ones stay.

    A task sends one row per centroid and component; the driver gets their sums, k * size rows.
    """
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, vectors, (number, _, _) in _per_batch(batches, centroids, pivots):
            for j in range(k):
                total[j] += vectors[number == j].sum(axis=0)
            count += np.bincount(number, minlength=k)
        at, part = np.divmod(np.arange(k * size), size)
        columns = [pa.array(x) for x in (at, part, total.ravel(), np.repeat(count, size))]
        yield pa.RecordBatch.from_arrays(columns, ["at", "part", "total", "n"])

    sums = table.select("v", "d").mapInArrow(add, "at bigint, part bigint, total bigint, n bigint").groupBy("at", "part")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    new = centroids.copy()
    for row in sums.agg(*wide).collect():
        if row.n:
            new[row.at, row.part] = int(row.total) // int(row.n)
    return new


# ---- the operator


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, pivots: int = PIVOTS,
            sample: int = SAMPLE) -> DataFrame:
    """One row per usable vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact.

    Vectors of another length, null ones and those with null or non-finite components are left out.
    The first centroids are the vectors with the smallest SHA-256 of ``3:`` and the key (null keys
    last, repeated keys by value); with fewer vectors there are fewer centroids, and an empty table
    gives no rows. Repeated rows count as often as they occur; other columns play no part. A
    component too large for 64-bit distances fails the query. ``n_exact`` is the number of exact
    distances the last assignment made for the vector. The pivots come from a sample of ``sample``
    vectors chosen by hash; they decide about the work only, never about the result.
    """
    vectors = whole_vectors(rows, key, vector, size, scale)
    centroids = _first_by_hash(vectors, "3:", clusters)
    points = choose_pivots(_first_by_hash(vectors, "pivot:", sample), centroids, rounds, pivots)
    if not len(centroids):
        centroids = points = np.zeros((1, size), np.int64)
    table = pivot_table(vectors, points)
    for _ in range(rounds):
        centroids = _moved(table, centroids, points)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, (number, best, made) in _per_batch(batches, centroids, points):
            columns = [batch.column("key"), pa.array(number.astype(np.int32)), pa.array(best), pa.array(made)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "cluster", "distance", "n_exact"])

    kind = table.schema["key"].dataType.simpleString()
    assigned = durable(table.mapInArrow(assign, f"key {kind}, cluster int, distance bigint, n_exact int"))
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).cast("bigint")
    found = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(exact.alias("total")).collect()}
    inertia = sum(found.values())
    of_cluster = [
        (j, found[j], inertia, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest())
        for j in sorted(found)
    ]
    known = rows.sparkSession.createDataFrame(
        of_cluster, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(  # one row per centroid
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact"
    )
