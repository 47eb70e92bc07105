"""Centroid clustering of integer vectors: Lloyd's rounds, with Ptolemaic bounds from fixed pivots.

For pivots p, s and any x, c: ``|xp * cs - xs * cp| <= xc * ps`` (Ptolemy). The distances of every vector to the pivots
are computed once and kept beside it; those of a centroid once a round. They bound the vector's distance to each
centroid from below, and centroids whose bound passes a distance that is already known are never visited. Bounds
are rounded down; what is left is compared exactly, in 64-bit integers.

Odd input: a vector that is null, of another length, or with a null or non-finite component is left out. Components of
the integer vectors are held within +-2^27, so that no squared distance passes 64 bits. Equal vectors, repeated and null
keys are rows of their own; null keys start no cluster while there are others. Fewer vectors than clusters: as many
clusters as vectors. An empty table gives an empty one. Sums over a cluster that pass 64 bits are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted

LIMIT = 1 << 27
#: Vectors that are compared at one time.
BLOCK = 4096
#: Relative error of a double, with room for a few operations.
SLACK = 2.0**-48


def quantized(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 256) -> DataFrame:
    """(id, q): the kept vectors, each component x as floor(scale * x)."""
    x = quoted(vector)
    fine = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < math.inf))
    q = F.transform(x, lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return vectors.filter(fine).select(quoted(key).alias("id"), q.alias("q"))


def starting_centroids(rows: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The k vectors with the least sha256 of ``seed:id``; equal ones by their components. Null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.orderBy(order.asc_nulls_last(), "q").select("q").limit(k).collect()
    return np.array([r["q"] for r in found], np.int64)


def choose_pivots(centroids: np.ndarray, n: int = 6) -> np.ndarray:
    """Up to n different starting centroids, each the farthest from those before it."""
    chosen = [0]
    near = ((centroids - centroids[0]) ** 2).sum(1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((centroids - centroids[chosen[-1]]) ** 2).sum(1))
    return centroids[chosen]


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a from those of b, all pairs."""
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


@dataclass(frozen=True)
class Centroids:
    """Centroids with their distances to the pivots."""

    centers: np.ndarray
    pivots: np.ndarray

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances between vectors and centroids, from the vectors' distances to the pivots."""
        own = np.sqrt(exact_distances(self.centers, self.pivots).astype(np.float64))
        between = np.sqrt(exact_distances(self.pivots, self.pivots).astype(np.float64))
        low = np.zeros((len(to_pivots), len(self.centers)))
        for p, s in combinations(range(len(self.pivots)), 2):
            one, two = np.outer(to_pivots[:, p], own[:, s]), np.outer(to_pivots[:, s], own[:, p])
            np.maximum(low, (np.abs(one - two) - (one + two) * SLACK) / between[p, s], out=low)
        return low * (1 - SLACK)

    def nearest(self, q: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, the smaller number of equals; and how many
        distances were computed."""
        rows = np.arange(len(q))
        low = self.bounds(to_pivots)
        best = low.argmin(1)
        distance = ((q - self.centers[best]) ** 2).sum(1)
        low[rows, best] = np.inf
        # a bound is passed only if it is above the known distance for certain
        at, c = np.nonzero(low * low * (1 - SLACK) <= distance[:, None])
        for lo in range(0, len(at), 8 * BLOCK):
            i, j = at[lo : lo + 8 * BLOCK], c[lo : lo + 8 * BLOCK]
            d = ((q[i] - self.centers[j]) ** 2).sum(1)
            # of each vector's survivors the least distance, then the least number
            order = np.lexsort((j, d, i))
            first = order[np.r_[True, i[order][1:] != i[order][:-1]]]
            i, j, d = i[first], j[first], d[first]
            nearer = (d < distance[i]) | ((d == distance[i]) & (j < best[i]))
            best[i[nearer]], distance[i[nearer]] = j[nearer], d[nearer]
        return best, distance, len(at) + len(q)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches, with the matrix of column ``q``."""
    for whole in batches:
        for lo in range(0, whole.num_rows, BLOCK):
            part = whole.slice(lo, BLOCK)
            yield part, part.column("q").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)


def _pivot_distances(part: pa.RecordBatch) -> np.ndarray:
    return part.column("pivots").flatten().to_numpy().reshape(part.num_rows, -1)


def _with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q in _blocks(batches):
            d = np.sqrt(exact_distances(q, pivots).astype(np.float64))
            kept = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), d.ravel())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("q"), kept], names=["id", "q", "pivots"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, q array<int>, pivots array<double>")


def _moved(rows: DataFrame, state: Centroids) -> np.ndarray:
    """The centroids after a round: exact floors of the means of their vectors. The driver sees a row a centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = state.centers.shape
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for part, q in _blocks(batches):
            best, _, _ = state.nearest(q, _pivot_distances(part))
            np.add.at(sums, best, q)
            counts += np.bincount(best, minlength=k)
        has = np.flatnonzero(counts)
        if len(has):
            lists = pa.ListArray.from_arrays(np.arange(0, len(has) * size + 1, size, dtype=np.int32), sums[has].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has]), lists], names=["cluster", "n", "sums"])

    size = state.centers.shape[1]
    partial = rows.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
    centers = state.centers.copy()
    for r in total.collect():
        centers[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return centers


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2, n_pivots: int = 6) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of the kept vectors, the final centroids).

    Each round maps the vectors to sums by centroid within each task, and adds these up; the vectors are assigned once
    more after the last one.
    """
    rows = quantized(vectors, key, vector, size, scale)
    centers = starting_centroids(rows, k, seed)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not len(centers):
        return vectors.sparkSession.createDataFrame([], schema), centers
    pivots = choose_pivots(centers, n_pivots)
    rows = checkpointed(_with_pivots(rows, pivots))
    for _ in range(rounds):
        centers = _moved(rows, Centroids(centers, pivots))
    state = Centroids(centers, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q in _blocks(batches):
            best, distance, _ = state.nearest(q, _pivot_distances(part))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return rows.mapInArrow(assign, schema), centers


def cluster_report(vectors: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept vectors; the sums are exact."""
    found, centers = cluster_vectors(vectors, key, **options)
    found = checkpointed(found)
    # a row a centroid
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    each = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
