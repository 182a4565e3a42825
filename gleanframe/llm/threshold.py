"""Centroid clustering of vectors, nearest centroids by the threshold algorithm.

Each dimension has its centroids in a sorted list. For a vector the lists are walked outward from its own value, some
dimensions a turn; a centroid that turns up for the first time gets its exact distance. What no list has shown yet is at
least as far as the sum of the squared distances of all frontiers. When that exceeds the best exact distance, and not when
it only equals it, the rest can neither win nor tie, and the walk ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import lists, matrix, mean_floor, scaled

#: Dimensions whose lists go one place outward in a turn; vectors walked at a time.
WALKED, ROWS = 8, 4096
_FAR = np.int64(1) << 62


class Nearest:
    """Nearest centroids of integer vectors; of equally near ones the first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        k, dims = self.centroids.shape
        self.order = np.argsort(self.centroids, axis=0, kind="stable").T  # (dims, k)
        self.sorted = np.sort(self.centroids, axis=0).T
        # a frontier that has come to its list's end lies beyond everything
        self.fenced = np.concatenate([np.full((dims, 1), -1), self.order, np.full((dims, 1), -1)], axis=1)
        spread = self.sorted[:, -1] - self.sorted[:, 0]
        turns = np.argsort(-spread, kind="stable")  # dimensions that tell most apart first
        self.turns = [turns[i : i + WALKED] for i in range(0, dims, WALKED)]
        self.exact = 0

    def _gap(self, x: np.ndarray, dim: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distance from x to the list's entry at the place, far beyond the ends."""
        k = len(self.centroids)
        gap = x - self.sorted[dim, np.clip(at, 0, k - 1)]
        return np.where((at < 0) | (at >= k), _FAR, gap * gap)

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid."""
        found = [self._some(vectors[a : a + ROWS].astype(np.int64)) for a in range(0, len(vectors), ROWS)]
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        return tuple(np.concatenate(x) for x in zip(none, *found))

    def _some(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dims = x.shape
        k = len(self.centroids)
        right = np.stack([np.searchsorted(self.sorted[d], x[:, d]) for d in range(dims)], axis=1)
        left = right - 1
        every = np.arange(dims)
        front = np.minimum(self._gap(x, every, left), self._gap(x, every, right))
        seen = np.zeros((n, k), bool)
        best, who = np.full(n, _FAR), np.zeros(n, np.int64)
        on = np.arange(n)
        while len(on):
            for turn in self.turns:
                xs, l, r = x[np.ix_(on, turn)], left[np.ix_(on, turn)], right[np.ix_(on, turn)]
                a, b = self._gap(xs, turn, l), self._gap(xs, turn, r)
                down = a <= b
                ended = np.minimum(a, b) == _FAR
                met = self.fenced[turn, np.where(down, l, r) + 1]
                left[np.ix_(on, turn)] = l = l - (down & ~ended)
                right[np.ix_(on, turn)] = r = r + (~down & ~ended)
                front[np.ix_(on, turn)] = np.minimum(self._gap(xs, turn, l), self._gap(xs, turn, r))
                fresh = np.zeros((len(on), k + 1), bool)
                fresh[np.arange(len(on))[:, None], np.where(ended, k, met)] = True
                fresh = fresh[:, :k] & ~seen[on]
                seen[on] |= fresh
                for j in np.flatnonzero(fresh.any(axis=0)):
                    rows = on[fresh[:, j]]
                    self.exact += len(rows)
                    far = ((x[rows] - self.centroids[j]) ** 2).sum(axis=1)
                    nearer = (far < best[rows]) | ((far == best[rows]) & (j < who[rows]))
                    best[rows[nearer]], who[rows[nearer]] = far[nearer], j
                bound = np.where((front[on] == _FAR).any(axis=1), _FAR, front[on].sum(axis=1, where=front[on] < _FAR))
                on = on[(bound <= best[on]) & ~seen[on].all(axis=1)]
                if not len(on):
                    break
        return who, best


def _summed(centroids: np.ndarray):
    """x -> cluster, count, sums: one row for each cluster of a task."""

    def run(batches):
        nearest, (k, dims) = Nearest(centroids), centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            who, _ = nearest.of(x)
            for j in np.unique(who):
                sums[j] += x[who == j].sum(axis=0, dtype=np.int64)
            counts += np.bincount(who, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), lists(sums[some])], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        nearest, dims = Nearest(centroids), centroids.shape[1]
        for batch in batches:
            who, far = nearest.of(matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector of dims components
    that are all finite; other rows are left out, as are other columns.

    Components count as floor(scale * x). Centroids start as the k vectors whose `1:<vec_id>` has the smallest sha256 (of
    repeated vec_ids the smaller vector first, null vec_ids last; fewer vectors give fewer centroids). In each round every
    vector goes to the nearest centroid (ties to the smaller number), and a centroid becomes the floor of the mean of its
    vectors; one without vectors stays. distance is squared; inertia its sum over all, cluster_inertia over the cluster.
    Repeated rows count each. No vectors, no rows.
    """
    rows = cut(scaled(vectors, column, scale, dims, F.col("vec_id").cast("long").alias("vec_id")), "vectors")
    drawn = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(drawn.alias("drawn"), "x").orderBy(F.asc_nulls_last("drawn"), "x").limit(k).collect()  # k rows
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), dims)
    if not len(first):
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        parts = rows.select("x").mapInArrow(_summed(centroids), "cluster long, n long, sums array<long>")
        each = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(dims)])
        for r in each.collect():  # k rows at most
            centroids[r.cluster] = mean_floor(list(r[2:]), r.n)
    out = cut(rows.select("vec_id", "x").mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    whole = {r.cluster: r.far for r in out.groupBy("cluster").agg(F.sum("distance").alias("far")).collect()}
    name = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    each = vectors.sparkSession.createDataFrame([(j, whole.get(j, 0), sum(whole.values()), name(c)) for j, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
