"""Centroid clustering of integer vectors through a vantage-point tree.

Each round builds a vantage-point tree over the centroids (at most a parameter's
number of them), broadcasts it, and sends every vector down it best first: the
node with the least lower bound is opened next, and a vector is done once that
bound exceeds its best distance. The bound is inclusive (a node at exactly the
best distance is opened, since it may hold a smaller number) and widened by the
rounding error of square roots, so no centroid that could win or tie is passed
over. Distances to vantage points and in leaves are exact integers; of equal ones
the smaller number wins.

A task adds its vectors up by cluster, so a round shuffles one row per task,
cluster and component whatever the size of a cluster, and the driver receives
the sums of the clusters alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import materialise

#: Centroids compared one by one where a branch of the tree ends.
LEAF = 4
#: Cells of the table of open nodes that are held at once.
FRONTIER_CELLS = 4_000_000
#: More than the relative error of a square root of a rounded integer, and of sums of two.
_SLACK = 2.0**-48


class VantageTree:
    """A vantage-point tree over integer points, searched for many vectors side by side."""

    def __init__(self, points: np.ndarray):
        self.points = np.ascontiguousarray(points, dtype=np.int64)
        self._members: list[list[int]] = []
        self._heirs: list[list[int]] = []
        self._between: list[tuple[float, float]] = []
        self._grow(np.arange(len(self.points)), (0.0, 0.0))
        self.members = np.array([m + [-1] * (LEAF - len(m)) for m in self._members], dtype=np.int64)
        self.heirs = np.array([h or [-1, -1] for h in self._heirs], dtype=np.int64)
        self.low, self.high = np.array(self._between).T

    def _grow(self, those: np.ndarray, between: tuple[float, float]) -> int:
        node = len(self._members)
        self._members.append([])
        self._heirs.append([])
        self._between.append(between)
        if len(those) <= LEAF:
            self._members[node] = those.tolist()
            return node
        vantage, rest = those[0], those[1:]
        self._members[node] = [int(vantage)]
        squares = squared(self.points[rest], self.points[vantage][None])
        order = np.argsort(squares, kind="stable")
        half = len(order) // 2
        for part in (order[:half], order[half:]):
            roots = np.sqrt(squares[part].astype(np.float64))
            self._heirs[node].append(self._grow(rest[part], (roots.min(), roots.max())))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest point's number (ties: the smallest) and squared distance, by vector."""
        step = max(1, FRONTIER_CELLS // len(self.members))
        parts = [self._search(vectors[a : a + step]) for a in range(0, len(vectors), step)]
        if not parts:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        best, label = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.points))
        frontier = np.full((n, len(self.members)), np.inf)
        frontier[:, 0] = 0.0
        live = np.arange(n)
        while True:
            node = frontier[live].argmin(axis=1)
            bound = frontier[live, node]
            on = bound <= np.sqrt(best[live].astype(np.float64)) * (1 + _SLACK)
            live, node, bound = live[on], node[on], bound[on]
            if not len(live):
                return label, best
            frontier[live, node] = np.inf
            for slot in range(LEAF):
                number = self.members[node, slot]
                there = np.flatnonzero(number >= 0)
                if not len(there):
                    break
                rows, number = live[there], number[there]
                squares = squared(vectors[rows], self.points[number])
                wins = (squares < best[rows]) | ((squares == best[rows]) & (number < label[rows]))
                best[rows[wins]], label[rows[wins]] = squares[wins], number[wins]
                if slot == 0:
                    from_vantage = np.sqrt(squares.astype(np.float64))
            inner = self.heirs[node, 0] >= 0
            for side in range(2):
                heir, away = self.heirs[node[inner], side], from_vantage[inner]
                gap = np.maximum(away - self.high[heir], self.low[heir] - away) - _SLACK * (away + self.high[heir])
                frontier[live[inner], heir] = np.maximum(bound[inner], gap)
            # every node has a first member, so ``from_vantage`` is aligned with ``node``


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def largest_component(dims: int) -> int:
    """Components below this in magnitude have squared distances that fit a long with room to spare."""
    return math.isqrt((1 << 62) // max(1, dims)) // 2


def grid(values: np.ndarray, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of flat values, as rows of integers."""
    scaled = np.floor(scale * values.astype(np.float64))
    if len(scaled) and np.abs(scaled).max() >= largest_component(dims):
        raise ValueError(f"a scaled component is not below {largest_component(dims)} in magnitude, so distances would not fit a long")
    return scaled.astype(np.int64).reshape(-1, dims)


def _vectors(batch: pa.RecordBatch, dims: int, scale: float) -> np.ndarray:
    return grid(batch.column("_vector").flatten().to_numpy(zero_copy_only=False), dims, scale)


def _summing(tree, dims: int, scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = tree.value.points
        sums, counts = np.zeros(points.shape, dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        for batch in batches:
            vectors = _vectors(batch, dims, scale)
            label, _ = tree.value.nearest(vectors)
            if len(label):
                order = np.argsort(label, kind="stable")
                found, starts = np.unique(label[order], return_index=True)
                sums[found] += np.add.reduceat(vectors[order], starts)
                counts += np.bincount(label, minlength=len(points))
        full = np.flatnonzero(counts)
        if len(full):
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array(counts[full]), pa.array(list(sums[full]), type=pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
            )

    return run


def _assigning(tree, dims: int, scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, best = tree.value.nearest(_vectors(batch, dims, scale))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, seed: int, dims: int, scale: float) -> np.ndarray:
    """The k rows of least hash of ``seed:id``, in that order; equal hashes by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(digest.alias("_digest"), "_vector").orderBy("_digest", "_vector").limit(k).collect()
    return grid(np.array([x for r in found for x in r["_vector"]], dtype=np.float64), dims, scale)


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """One row per kept vector (vec_id, cluster int, distance long), and the centroids as integers.

    Kept are vectors of exactly ``dims`` components, none null, NaN or infinite;
    a null vector is not. Repeated rows and ids, also null ids, are rows of
    their own. With fewer kept rows than ``k``, all are centroids; of equal
    centroids the first takes every vector and the others stay empty. A scaled
    component of ``largest_component(dims)`` or more in magnitude is an error.
    An empty table has no centroids and no rows. Every round reads ``vectors``
    again: write it first if it is dear to compute.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_vector"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("_vector") == dims) & finite)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, k, seed, dims, scale)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), centroids
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        sums = rows.select("_vector").mapInArrow(_summing(tree, dims, scale), "cluster int, n long, sums array<long>")
        sums = sums.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
        centroids = centroids.copy()
        for r in sums.collect():  # one row per cluster and component
            centroids[r["cluster"], r["place"]] = r["total"] // r["n"]
        tree.unpersist()
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    assigned = rows.mapInArrow(_assigning(tree, dims, scale), f"vec_id {id_type}, cluster int, distance long")
    return assigned, centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """``cluster_vectors`` with each cluster's and the whole inertia, and the digest of the final centroid."""
    assigned, centroids = cluster_vectors(vectors, **options)
    if not len(centroids):
        return assigned.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    assigned = materialise(assigned, "cluster-rows")
    totals = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    whole = sum(totals.values())
    named = [(c, total, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in totals.items()]
    clusters = assigned.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
