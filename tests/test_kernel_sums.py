import numpy as np
import pytest
from tessella.operators import distributions as dist, kernel_sums as ks


def plain(points, factor):
    m = factor**2 * np.cov(points.T)
    d = points[:, None] - points[None]
    q = np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(m), d)
    return np.exp(-0.5 * q).sum(1) / (len(points) * np.sqrt((2 * np.pi) ** 3 * np.linalg.det(m)))


@pytest.mark.parametrize("factor", [0.15, 2.0])
def test_equals_the_sum_over_all_pairs(spark, factor, monkeypatch):
    monkeypatch.setattr(ks, "PART", 300)
    r = np.random.default_rng(9)
    points = np.concatenate([r.normal(size=(700, 3)) @ r.normal(size=(3, 3)), r.normal(5, 0.01, (400, 3)), [[30, -20, 9]] * 3])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(-1, None, 1.0, 2.0)], "x long, a double, b double, c double")
    got = {g.x: g.density for g in dist.density_3d(df, "x", ["a", "b", "c"], factor).collect()}
    expected = plain(points, factor)
    m = factor**2 * np.cov(points.T)
    peak = 1 / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(m))
    assert len(got) == len(points)
    assert max(abs(got[i] - e) for i, e in enumerate(expected)) < ks.BOUND * peak


def test_what_points_meet_does_not_grow_with_them(spark):
    r = np.random.default_rng(10)
    counts = []
    for n in (2000, 16000):
        rows = [(*map(float, p), 1.0) for p in r.random((n, 3)) * 1.5]
        points = spark.createDataFrame(rows, "x double, y double, z double, w double")
        cells = points.selectExpr("*", *(f"CAST(floor({u} / {ks.CELL}) AS BIGINT) AS {c}" for u, c in zip("xyz", "ijk", strict=True)))
        counts.append(ks.sources(cells).count())
    assert counts == [27, 27]


def test_flat_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)], "k long, a double, b double, c double")
    assert {tuple(g) for g in dist.density_3d(df, "k", ["a", "b", "c"]).collect()} == {(1, 1.0), (2, 1.0)}
    assert dist.density_3d(df.filter("k = 0"), "k", ["a", "b", "c"]).count() == 0
