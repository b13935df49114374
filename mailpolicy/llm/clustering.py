"""Centroid clustering in integers: a vector's nearest centroid is the winner of a tournament of bisector tests.

The points as near to centroid a as to b > a form a hyperplane with the integer normal 2 (b - a) and the threshold |b|^2 - |a|^2. A vector
on the threshold or below it stays with a, the smaller number. With normals and thresholds of all pairs at hand, k - 1 such tests leave one
centroid, and only to that one the distance is worked out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailpolicy.llm.common import kept, mapped, scaled_integers

#: Vectors tested at a time.
ROWS = 1024
#: Numbers in the normals of all pairs, at most: it bounds what is sent to the tasks' memory by k * k * width.
NORMALS = 1 << 26
_ASSIGNED = "vec_id long, cluster int, distance long"
_SUMS = "cluster int, n long, sums array<string>"


def usable(vectors: DataFrame, width: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, components as doubles, of the vectors with exactly ``width`` components, none null, NaN or infinite."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("x"))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) if a.dtype == object else np.einsum("ij,ij->i", a, b)


class Tournament:
    """Bisectors of all pairs of centroids, in the smallest kind of number that is exact for the vectors at hand."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, object)
        self.largest = max(abs(v) for c in centroids for v in c)
        self.made: dict[type, tuple[np.ndarray, ...]] = {}

    def _bisectors(self, kind: type) -> tuple[np.ndarray, ...]:
        if kind not in self.made:
            c = self.centroids.astype(kind)
            squares = (c * c).sum(axis=1)
            self.made[kind] = c, 2 * (c[:, None, :] - c[None, :, :]), squares[:, None] - squares[None, :]
        return self.made[kind]

    def _kind(self, x: np.ndarray) -> type:
        most = max(self.largest, int(np.abs(x).max()))
        bound = 4 * x.shape[1] * most * most  # of any product with a normal, and of any distance
        return float if bound < 2**52 else np.int64 if bound < 2**62 else object

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row, the smaller one of equally near ones."""
        best = np.zeros(len(x), np.int64)
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            kind = self._kind(part)
            _, normals, thresholds = self._bisectors(kind)
            part, won = part.astype(kind), best[at : at + ROWS]
            for j in range(1, len(normals)):
                beyond = _dot(part, normals[j][won]) > thresholds[j][won]
                won[beyond.astype(bool)] = j
        return best

    def distances(self, x: np.ndarray, best: np.ndarray) -> list[int]:
        out: list[int] = []
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            kind = self._kind(part)
            off = part.astype(kind) - self._bisectors(kind)[0][best[at : at + ROWS]]
            out += map(int, _dot(off, off).tolist())
        return out


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int, scale: int):
    for batch in batches:
        if batch.num_rows:
            x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield batch, scaled_integers(x, scale)


def _sum(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], scale: int) -> Iterator[pa.RecordBatch]:
    """One row for each cluster with vectors in this task."""
    tournament, k, width = Tournament(centroids), len(centroids), len(centroids[0])
    n, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
    for _, x in _matrices(batches, 0, width, scale):
        best = tournament.nearest(x)
        order = np.argsort(best, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(best[order]) > 0])
        clusters = best[order][starts]
        n += np.bincount(best, minlength=k)
        sums[clusters] += np.add.reduceat(x[order], starts, axis=0).astype(object)
    yield _sum_rows({c: (int(n[c]), sums[c]) for c in np.flatnonzero(n).tolist()})


def _sum_rows(totals: dict) -> pa.RecordBatch:
    columns = [pa.array(list(totals), pa.int32()), pa.array([n for n, _ in totals.values()], pa.int64()), pa.array([list(map(str, s)) for _, s in totals.values()], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same cluster as one, in integers of any size."""
    totals: dict = {}
    for batch in batches:
        for r in batch.to_pylist():
            n, sums = totals.get(r["cluster"], (0, 0))
            totals[r["cluster"]] = n + r["n"], sums + np.array(list(map(int, r["sums"])), object)
    yield _sum_rows(totals)


def _assign(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], scale: int) -> Iterator[pa.RecordBatch]:
    tournament = Tournament(centroids)
    for batch, x in _matrices(batches, 1, len(centroids[0]), scale):
        best = tournament.nearest(x)
        distances = [d if d < 2**63 else None for d in tournament.distances(x, best)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(distances, pa.int64())], names=["vec_id", "cluster", "distance"])


def started(vectors: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of the smallest digests of their ids, the first centroids; vectors without id come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()
    return scaled_integers(np.array([r.x for r in rows], float), scale).tolist()


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after one round: floors of the means of their vectors; those without vectors stay."""
    sums = mapped(vectors.select("x"), lambda it: _sum(it, centroids, scale), _SUMS)
    # A task gives k rows at most; they meet by cluster, and k rows come to the driver.
    found = mapped(sums.repartition("cluster"), _merge, _SUMS).collect()
    out = list(centroids)
    for r in found:
        out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with ``width`` finite components.

    Components are turned into floor(``scale`` * x). The first centroids are the ``k`` vectors with the smallest sha256 of
    ``seed:vec_id``, in that order; in each of ``rounds`` rounds all vectors are assigned to the nearest centroid (ties: smaller number), and
    every centroid with vectors becomes the floor of their mean. The result is of one more assignment, with squared distances, their sums
    over the cluster and over all, and the digest of the cluster's centroid.

    Vectors that are null, of another length, or with a null, NaN or infinite component are left out. Repeated rows count as often as they
    occur; rows without an id are clustered, and are first centroids only if there are fewer than ``k`` others. With fewer than ``k``
    vectors each is a centroid; an empty table gives no rows. Integers of any size are exact; a distance or a sum that is no long is
    null. Other columns are not looked at. Each round is one pass over the written vectors; k sums a task are what moves.
    """
    if k * k * width > NORMALS:
        raise ValueError(f"{k} centroids of {width} components need more than {NORMALS} numbers for the normals of all pairs")
    spark = vectors.sparkSession
    rows = kept(usable(vectors, width), "vectors")
    centroids = started(rows, k, scale, seed)
    if not centroids:
        return spark.createDataFrame([], f"{_ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    assigned = kept(mapped(rows, lambda it: _assign(it, centroids, scale), _ASSIGNED), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    # k rows.
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), exact).alias("s")).collect()}
    fits = lambda s: None if s is None or s >= 2**63 else int(s)
    total = fits(None if None in sums.values() else sum(sums.values()))
    of_cluster = [(c, fits(s), total, digest(centroids[c])) for c, s in sums.items()]
    facts = F.broadcast(spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return assigned.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
