"""Centroid clustering in whole numbers, with centroids filtered by an n-simplex projection.

Components become integers, floor(scale * x). The first centroids are the k vectors with the smallest hashes of their ids.
Each round assigns every vector to its nearest centroid and moves the centroids to the floored means.

The projection: up to PIVOTS of the first centroids stay pivots throughout. They span a simplex; a vector's distances to them
are taken once, and become the coordinates of an apex over that simplex: its place along the span, and how far it is from
it (the altitude). For two vectors the distance of their apexes is a lower bound of their own distance, and the distance of
the one to the mirror image of the other an upper bound. Apexes are written beside the vectors once (the cache); a round
only projects the centroids, and a vector is compared exactly, in integers, with those centroids alone whose lower bound
reaches its least upper bound. Bounds are doubles, so they are widened by MARGIN; pivots that would make the projection
ill-conditioned are passed over, and that margin covers what is left by far. With pivots that are all equal, the bounds are
those of the triangle inequality.

A task turns its vectors into one partial sum a centroid and batch; partial sums meet as k rows a component, the only
thing that reaches the driver, where the division is exact.

Defined cases: vectors that are null, of another length or hold a null or non-finite component take no part. Rows count
each for themselves, also with equal or null ids; rows with a null id never begin as a centroid, and of rows with equal ids
the lesser vector begins first. Equal distances go to the smaller centroid. A centroid without vectors stays. With fewer
than k vectors there are as many centroids as vectors; without vectors there is no row. Components beyond MOST in size are
an error, since their distances don't fit a long. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

PIVOTS = 8
#: The projection's matrix may have this condition; bounds of squares are widened by this part of the scale's square.
CONDITION, MARGIN = 100.0, 1e-4
MOST = 1 << 27


class Simplex:
    """Projects vectors onto the span of pivots, by their distances to them."""

    def __init__(self, starts: np.ndarray, pivots: int = PIVOTS) -> None:
        chosen, base = [0], np.zeros((0, 0))
        for i in range(1, len(starts)):
            if len(chosen) > pivots - 1:
                break
            edges = (starts[[*chosen[1:], i]] - starts[0]).astype(np.float64)
            gram = edges @ edges.T
            try:
                lower = np.linalg.cholesky(gram)
            except np.linalg.LinAlgError:
                continue
            if np.linalg.cond(lower) <= CONDITION:
                chosen.append(i)
                base = lower
        self.pivots, self.base = starts[chosen], base

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        return np.stack([((vectors - p) ** 2).sum(1) for p in self.pivots], 1)

    def apexes(self, squares: np.ndarray) -> np.ndarray:
        """The last coordinate is the altitude. The others solve base @ y = b: each b is a vector's inner product with an
        edge of the simplex, which the distances give."""
        squares = squares.astype(np.float64)
        edges = (self.base**2).sum(1)
        y = np.linalg.solve(self.base, ((squares[:, :1] + edges - squares[:, 1:]) / 2).T).T if len(edges) else np.zeros((len(squares), 0))
        return np.column_stack([y, np.sqrt(np.maximum(squares[:, 0] - (y**2).sum(1), 0))])


def reachable(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids each vector must be compared with, both given by their apexes."""
    flat = ((apexes[:, None, :-1] - centroids[None, :, :-1]) ** 2).sum(-1)
    near, far = apexes[:, None, -1] - centroids[None, :, -1], apexes[:, None, -1] + centroids[None, :, -1]
    slack = MARGIN * np.maximum((apexes**2).sum(1)[:, None], (centroids**2).sum(1)[None, :]) + 1e-6
    return flat + near**2 - slack <= (flat + far**2 + slack).min(1, keepdims=True)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, projected: np.ndarray, measure: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its squared distance (if measured or needed), and the number of comparisons."""
    open_ = reachable(apexes, projected)
    cluster, best = open_.argmax(1), np.full(len(vectors), np.iinfo(np.int64).max)
    ask = open_ if measure else open_ & (open_.sum(1, keepdims=True) > 1)
    for j in range(len(centroids)):
        rows = np.flatnonzero(ask[:, j])
        d = ((vectors[rows] - centroids[j]) ** 2).sum(1)
        better = d < best[rows]
        cluster[rows[better]], best[rows[better]] = j, d[better]
    return cluster, best, int(ask.sum())


def integers(vectors: DataFrame, scale: int, length: int) -> DataFrame:
    """vec_id, v of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_e"))
    kept = doubles.filter(F.col("_e").isNotNull() & (F.size("_e") == length) & F.forall("_e", finite))
    fits = lambda x: F.when(F.abs(x) < MOST, F.floor(x)).otherwise(F.raise_error(F.lit(f"components of {MOST} and more after scaling")).cast("bigint"))
    return kept.select("vec_id", F.transform("_e", lambda x: fits(x * scale)).alias("v"))


def _stacked(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch[column].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _assigned(table: DataFrame, simplex: Simplex, centroids: np.ndarray, measure: bool, make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    projected = simplex.apexes(simplex.distances(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _stacked(batch, "v")
                yield pa.RecordBatch.from_pydict(make(batch, v, *nearest(v, _stacked(batch, "apex"), centroids, projected, measure)[:2]))

    return table.mapInArrow(run, schema)


def moved(table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""

    def sums(batch: pa.RecordBatch, v: np.ndarray, cluster: np.ndarray, best: np.ndarray) -> dict:
        found, n = np.unique(cluster, return_counts=True)
        total = np.concatenate([v[cluster == j].sum(0) for j in found])
        at = np.tile(np.arange(v.shape[1], dtype=np.int32), len(found))
        return {"cluster": np.repeat(found, v.shape[1]).astype(np.int32), "i": at, "s": total, "n": np.repeat(n, v.shape[1])}

    parts = _assigned(table, simplex, centroids, False, sums, "cluster int, i int, s long, n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.i] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, length: int = 64, first: Column | None = None, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. first: what orders the rows of which
    the least k begin as centroids."""
    kept = integers(vectors, scale, length)
    order = first if first is not None else F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    begin = kept.select(order.alias("o"), "v").filter("o IS NOT NULL").orderBy("o", "v").limit(k).collect()
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not begin:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in begin], dtype=np.int64)
    simplex = Simplex(centroids, pivots)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apexes = simplex.apexes(simplex.distances(_stacked(batch, "v")))
                ends = np.arange(len(apexes) + 1, dtype=np.int32) * apexes.shape[1]
                yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "v": batch["v"], "apex": pa.ListArray.from_arrays(ends, apexes.ravel())})

    table = written(kept.mapInArrow(project, f"vec_id {kind}, v array<long>, apex array<double>"), "centroid-apexes")
    for _ in range(rounds):
        centroids = moved(table, simplex, centroids)

    def result(batch: pa.RecordBatch, v: np.ndarray, cluster: np.ndarray, best: np.ndarray) -> dict:
        return {"vec_id": batch["vec_id"], "cluster": cluster.astype(np.int32), "distance": best}

    rows = written(_assigned(table, simplex, centroids, True, result, f"vec_id {kind}, cluster int, distance long"), "centroid-rows")
    sums = {r["cluster"]: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    told = [(j, s, sum(sums.values()), digest(centroids[j])) for j, s in sums.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def comparisons(vectors: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[int, int]:
    """How many exact comparisons the bounds leave, and how many there are without them."""
    projected = simplex.apexes(simplex.distances(centroids))
    n = nearest(vectors, simplex.apexes(simplex.distances(vectors)), centroids, projected, True)[2]
    return n, math.prod((len(vectors), len(centroids)))
