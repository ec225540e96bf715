import hashlib
import math

import numpy as np
import pytest
from tessella.llm import centroids

ROWS = "vec_id long, embedding array<float>"


def brute(rows, k=16, rounds=3, length=64):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == length and all(x is not None and math.isfinite(x) for x in e)]
    begin = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    now = [v for _, v in begin]
    if not now:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(now)), key=lambda j: (far(v, now[j]), j))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        members = [[v for (_, v), a in zip(kept, at, strict=True) if a == j] for j in range(len(now))]
        now = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, now, strict=True)]
    out = [(i, j := near(v), far(v, now[j])) for i, v in kept]
    inertia = {j: sum(d for _, a, d in out if a == j) for _, j, _ in out}
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, j, d in out]


def rows_of(kind, n=300, length=64):
    r = np.random.default_rng(7)
    if kind == "groups":
        middles = r.normal(size=(12, length))
        return [(i, (middles[i % 12] + 0.1 * r.normal(size=length)).tolist()) for i in range(n)]
    if kind == "random":
        return [(i, r.normal(size=length).tolist()) for i in range(n)]
    if kind == "line":  # pivots on one line, altitudes of nought
        return [(i, [float(r.integers(-5, 5))] * length) for i in range(n)]
    if kind == "equal":
        return [(i, [0.5] * length) for i in range(n)]
    if kind == "large":
        return [(i, (r.normal(size=length) * 10.0 ** r.integers(-3, 6)).tolist()) for i in range(n)]
    if kind == "few":
        return [(i, r.normal(size=length).tolist()) for i in range(5)]
    same = [(2**53 + 1, [3.0] * length), (3, [1.0] * length), (3, [0.0] * length), (3, [1.0] * length), (None, [2.0] * length), (None, [2.0] * length)]
    odd = [(4, None), (5, [1.0] * (length - 1)), (6, [None] * length), (7, [float("nan")] * length), (8, [float("inf")] * length), (9, [])]
    return same + odd


@pytest.mark.parametrize("kind", ["groups", "random", "line", "equal", "large", "few", "odd"])
def test_equals_brute_force(spark, kind):
    from pyspark.sql import functions as F

    rows = rows_of(kind)
    df = spark.createDataFrame(rows, ROWS).repartition(5).withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1))
    got = [tuple(r) for r in centroids.cluster(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_no_rows(spark):
    got = centroids.cluster(spark.createDataFrame([], ROWS))
    assert got.count() == 0 and len(got.columns) == 6


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], ROWS)).collect()


@pytest.mark.parametrize("kind", ["groups", "random", "line", "large"])
def test_bounds_hold_the_nearest(kind):
    v = np.floor(64 * np.array([e for _, e in rows_of(kind)])).astype(np.int64)
    simplex = centroids.Simplex(v[:16])
    apexes = simplex.apexes(simplex.distances(v))
    centres = np.concatenate([v[:16], v[16:48].reshape(16, 2, 64).mean(1).astype(np.int64)])
    far = ((v[:, None] - centres[None]) ** 2).sum(-1)
    reach = centroids.reachable(apexes, simplex.apexes(simplex.distances(centres)))
    assert reach[far == far.min(1, keepdims=True)].all()


def test_bounds_spare_comparisons():
    v = np.floor(64 * np.array([e for _, e in rows_of("groups")])).astype(np.int64)
    asked, all_ = centroids.comparisons(v, v[:16], centroids.Simplex(v[:16]))
    assert asked < 0.4 * all_
