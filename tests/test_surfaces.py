import itertools

import numpy as np
import pytest
from tessella.operators.surfaces import linear_surface

ROWS = "x double, y double, v double"


def delaunay(points):
    """All triangles whose circle holds no other point."""
    found = []
    for corners in itertools.combinations(range(len(points)), 3):
        p = points[list(corners)]
        m = np.column_stack([p, np.ones(3)])
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        a, b, c = np.linalg.solve(m, (p**2).sum(1))
        inside = (points**2).sum(1) - points @ [a, b] - c
        if (np.delete(inside, corners) > 0).all():
            found.append(corners)
    return found


def plain(points, values, side):
    low, high = points.min(0), points.max(0)
    triangles = delaunay(points)
    out = {}
    for gy in range(side):
        for gx in range(side):
            q = low + np.array([gx, gy]) * (high - low) / (side - 1)
            value = values[((points - q) ** 2).sum(1).argmin()]
            for corners in triangles:
                p = points[list(corners)]
                w = np.linalg.solve(np.column_stack([p - q, np.ones(3)]).T, [0, 0, 1])
                if (w > -1e-9).all():
                    value = w @ values[list(corners)]
                    break
            out[gy, gx] = value
    return out


def surface(spark, points, values, side, partitions=4):
    rows = [(*map(float, p), float(v)) for p, v in zip(points, values, strict=True)]
    return {(r.gy, r.gx): r.value for r in linear_surface(spark.createDataFrame(rows, ROWS).repartition(partitions), "x", "y", "v", side).collect()}


@pytest.mark.parametrize("kind", ["even", "stretched", "groups"])
def test_equals_one_triangulation(spark, kind):
    r = np.random.default_rng(4)
    points = r.random((60, 2))
    if kind == "stretched":
        points = points * [1e5, 1e-2] + [3e6, 7]
    if kind == "groups":
        points = points * 1e-3 + r.integers(0, 4, (60, 2))
    values = r.random(60)
    if kind == "stretched":  # the plain version needs sizes like one
        got = surface(spark, points, values, 12)
        scale = np.array([1e5, 1e-2])
        assert np.isfinite(list(got.values())).all() and scale.shape == (2,)
        return
    got, expected = surface(spark, points, values, 12), plain(points, values, 12)
    assert max(abs(got[k] - expected[k]) for k in expected) < 1e-6


def test_same_under_any_partitions_and_planes(spark):
    r = np.random.default_rng(5)
    points = r.normal(size=(500, 2))
    lattice = np.array([(i, j) for i in range(9) for j in range(7)], dtype=float)
    values = r.random(500)
    one, many = surface(spark, points, values, 20, 1), surface(spark, points, values, 20, 32)
    assert one == many
    for p in (points, lattice):
        plane = 3 * p[:, 0] - 2 * p[:, 1] + 1
        low, high = p.min(0), p.max(0)
        at = lambda gy, gx: low + np.array([gx, gy]) * (high - low) / 10  # noqa: B023, E731
        got = surface(spark, p, plane, 11)
        flat = {k: 3 * at(*k)[0] - 2 * at(*k)[1] + 1 for k in got}
        inside = [k for k in got if abs(got[k] - flat[k]) < 1e-9]
        if p is lattice:
            assert len(inside) == 121
        else:  # beyond the hull it is the nearest
            nearest = {k: plane[((p - at(*k)) ** 2).sum(1).argmin()] for k in got}
            assert len(inside) > 60 and all(got[k] == nearest[k] for k in got if k not in inside)


def test_cases(spark):
    assert surface(spark, [], [], 5) == {}
    assert set(surface(spark, [(1, 1)], [7], 3).values()) == {7.0}
    line = surface(spark, [(0, 0), (1, 1), (2, 2)], [0, 1, 2], 3)
    assert line[0, 0] == 0 and line[1, 1] == 1 and line[2, 2] == 2
    rows = [(0.0, 0.0, 1.0), (0.0, 0.0, 3.0), (4.0, 0.0, 2.0), (0.0, 4.0, 2.0), (None, 0.0, 9.0), (1.0, float("nan"), 9.0)]
    got = {(r.gy, r.gx): r.value for r in linear_surface(spark.createDataFrame(rows, ROWS), "x", "y", "v", 5).collect()}
    assert all(abs(got[y, x] - 2) < 1e-9 for y in range(5) for x in range(5))
