"""Clustering by Lloyd's rounds with Elkan's bounds.

Every vector carries its cluster, an upper bound of the distance to its centroid and a lower
bound of the distance to each of the k centroids. A round moves the bounds by the distances the
centroids moved; a distance is computed only where neither the lower bound nor half the
distance between two centroids exceeds the upper bound. Bounds are rounded away from each other
and must differ strictly to prune, so equal distances are always computed and ties go to the
smaller number as in an exhaustive search. Distances that decide are exact integers.

A round is one pass over the vectors, written to the shared folder with their bounds; the
centroids, their mutual distances and the sums of a round are of k rows, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Steps
from weftline.llm.vectors import in_fixed_point, joined, lists_of, rows_of

#: Lower bounds are kept as 32-bit floats: rounded down by more than their precision; upper ones up by more than a double's.
LESS, MORE = 1 - 2.0**-20, 1 + 2.0**-40


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Round:
    """Centroids of a round, how far each moved since the last, and half the distances between them, rounded down."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        k = len(centroids)
        self.centroids = centroids
        self.moved = np.zeros(k) if before is None else np.sqrt(squared(centroids, before)) * MORE
        self.half = np.sqrt([squared(np.broadcast_to(c, centroids.shape), centroids) for c in centroids]) * LESS / 2
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1)

    def start(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster 0 and bounds that exclude nothing."""
        return np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf), np.zeros((len(x), len(self.centroids)), dtype=np.float32)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster, upper and lower bounds after this round, and how many distances it took."""
        cluster, taken = cluster.copy(), 0
        upper = (upper + self.moved[cluster]) * MORE
        lower = (np.maximum(lower - self.moved * MORE, 0) * LESS).astype(np.float32)
        best = np.zeros(len(x), dtype=np.int64)

        def open_to(rows: np.ndarray, j: int | slice) -> np.ndarray:
            limit = upper[rows] if isinstance(j, int) else upper[rows, None]
            return (lower[rows, j] <= limit) & (self.half[cluster[rows], j] <= limit)

        rows = np.flatnonzero(upper >= self.nearest[cluster])
        if len(rows):
            rows = rows[open_to(rows, slice(None)).any(axis=1)]
        if len(rows):  # the own distance first: it settles most of them
            own = cluster[rows]
            best[rows] = squared(x[rows], self.centroids[own])
            d = np.sqrt(best[rows])
            upper[rows], lower[rows, own] = d * MORE, d * LESS
            taken += len(rows)
            for j in range(len(self.centroids)):
                some = rows[(cluster[rows] != j) & open_to(rows, j)]
                if not len(some):
                    continue
                found = squared(x[some], self.centroids[j])
                d = np.sqrt(found)
                lower[some, j] = d * LESS
                wins = (found < best[some]) | ((found == best[some]) & (j < cluster[some]))
                won = some[wins]
                cluster[won], best[won], upper[won] = j, found[wins], d[wins] * MORE
                taken += len(some)
        return cluster, upper, lower, taken


def _next(rows: DataFrame, now: Round, id_type: str, first: bool) -> DataFrame:
    """The rows after a round: vec_id, x, cluster, upper, lower."""
    shared = rows.sparkSession.sparkContext.broadcast(now)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = rows_of(b.column(1), b.num_rows)
            state = shared.value.start(x) if first else (b.column(2).to_numpy(), b.column(3).to_numpy(), rows_of(b.column(4), b.num_rows))
            cluster, upper, lower, _ = shared.value.assign(x, *state)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster), pa.array(upper), lists_of(lower)], names=["vec_id", "x", "cluster", "upper", "lower"])

    return rows.mapInArrow(go, f"vec_id {id_type}, x array<int>, cluster int, upper double, lower array<float>")


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; a cluster without vectors keeps its centroid."""
    k, dims = centroids.shape
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in sums.collect():  # k rows
        out[r["cluster"]] = np.array([r[f"s{i}"] for i in range(dims)], dtype=np.int64) // r["n"]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of `dims` finite components.

    Vectors (vec_id, embedding) that are null, of another length, or hold null or non-finite
    components are left out; other columns are ignored. Components become floor(scale * x). The
    k vectors with the smallest sha256 of `seed:vec_id` start as centroids, in that order, those
    of one id by their components; a null id counts as empty text. With fewer vectors there are
    as many centroids. Repeated rows count as often as they stand. No vectors give no rows.
    """
    spark, id_type = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    kept = in_fixed_point(vectors.where(F.size("embedding") == dims), scale, "vec_id")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(key, "x").limit(k).collect()  # k rows
    centroids = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), dims)
    if not first:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    steps, state, now = Steps(spark), kept, Round(centroids)
    for i in range(rounds + 1):
        state = steps.put(_next(state, now, id_type, first=i == 0))
        if i:
            steps.drop(i)
        if i < rounds:
            moved = _moved(state, centroids)
            centroids, now = moved, Round(moved, centroids)
    final = steps.put(_distances(state, centroids, id_type))
    sums = [(r["cluster"], r["s"]) for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()]  # k rows
    inertia = sum(s for _, s in sums)
    each = [(c, s, inertia, hashlib.sha256(joined(centroids[c]).encode()).hexdigest()) for c, s in sums]
    each = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _distances(state: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(centroids)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = squared(rows_of(b.column(1), b.num_rows), shared.value[b.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found)], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "x", "cluster").mapInArrow(go, f"vec_id {id_type}, cluster int, distance long")
