import numpy as np
import pytest
from tessella.operators import metric_join

ROWS = "k long, v array<double>"


def brute(v, threshold):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    return {(i, j) for i, j in zip(*np.nonzero(d <= threshold), strict=True) if i < j}


@pytest.mark.parametrize(("pivots", "threshold"), [(16, 0.8), (1, 0.5), (5, 2.5)])
def test_equals_brute_force(spark, pivots, threshold):
    r = np.random.default_rng(11)
    v = np.concatenate([r.normal(m, 0.3, (500, 6)) for m in range(0, 12, 3)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], ROWS).repartition(7)
    got = metric_join.near_pairs(df, "k", "v", threshold, pivots).collect()
    expected = brute(v, threshold)
    assert len(got) == len(expected) and {(g.i, g.j) for g in got} == expected
    if pivots == 16:  # of two million pairs
        met = metric_join.candidates(metric_join.classes(df, "k", "v"), threshold, pivots).count()
        assert len(expected) <= met < 0.25 * len(v) * (len(v) - 1) / 2


def test_cases(spark):
    rows = [(3, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 1.0]), (4, [5.0, 5.0]), (None, [0.0, 0.5]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, ROWS)
    assert [tuple(r) for r in metric_join.near_pairs(df, "k", "v", 1.0).collect()] == [(1, 2, 2, 1, 1.0)]
    assert metric_join.near_pairs(df.limit(0), "k", "v", 1.0).count() == 0


def exact(rows, threshold):
    """i, j, ni, nj and distance by plain loops over the distinct vectors."""
    found = {}
    for k, v in rows:
        found.setdefault(tuple(v), []).append(k)
    kept = sorted((min(ks), len(ks), v) for v, ks in found.items())
    met = []
    for x, (i, ni, a) in enumerate(kept):
        d = np.zeros(len(kept) - x - 1)
        rest = np.array([v for _, _, v in kept[x + 1 :]]).reshape(len(d), len(a))
        with np.errstate(over="ignore"):
            for c in range(len(a)):
                d = d + (rest[:, c] - a[c]) ** 2
        met += [(i, kept[x + 1 + y][0], ni, kept[x + 1 + y][1], float(np.sqrt(d[y]))) for y in np.flatnonzero(np.sqrt(d) <= threshold)]
    return met


def test_pivots_of_no_use(spark):
    """Random directions are about as far from each pivot: few pairs but those sought may be compared one by one."""
    v = np.random.default_rng(5).normal(size=(2400, 64))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype("f4").astype("f8")
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, ROWS)
    expected = exact(rows, 1.2)
    assert len(expected) > 20_000
    assert sorted(map(tuple, metric_join.near_pairs(df, "k", "v", 1.2).collect())) == expected
    met = metric_join.candidates(metric_join.classes(df, "k", "v"), 1.2).count()
    assert len(expected) <= met < 1.01 * len(expected)


def odd(kind):
    r = np.random.default_rng(3)
    v = {
        "offset": lambda: 1e7 + r.normal(size=(300, 5)),
        "small": lambda: np.concatenate([r.normal(size=(200, 3)), 1 + 1e-6 * r.normal(size=(100, 3))]),
        "large": lambda: np.concatenate([r.normal(size=(200, 2)) * [0, 1] + [1e200, 0], r.normal(size=(50, 2)) * [0, 1], [[1e308, 0], [-1e308, 1]]]),
        "all": lambda: r.normal(size=(300, 4)),
        "line": lambda: r.integers(0, 500, (400, 1)).astype(float),
    }[kind]()
    return [(f"k{i:03}", x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize(("kind", "threshold"), [("offset", 0.7), ("small", 1e-6), ("large", 0.1), ("all", 100.0), ("line", 3.0)])
def test_odd_scales_in_several_blocks(spark, kind, threshold):
    rows = odd(kind)
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(3)
    expected = exact(rows, threshold)
    assert expected and sorted(map(tuple, metric_join.near_pairs(df, "k", "v", threshold, 4, 60).collect())) == expected


def test_far_blocks_do_not_meet(spark):
    rows = [(i // 10, [float(i), float(i % 10)]) for i in range(200)]
    placed = spark.createDataFrame(rows, "block long, d array<double>")
    assert {tuple(r) for r in metric_join.block_pairs(placed, 2, 1.0).collect()} == {(a, b) for a in range(20) for b in (a, a + 1) if b < 20}
    assert metric_join.block_pairs(placed, 2, 1000.0).count() == 210


def test_cases_of_keys(spark):
    rows = [(1, [0.0]), (1, [0.5]), (2, [0.25]), (None, [0.25]), (3, [float("inf")])]  # a key may stand for two vectors; rows without one count
    found = metric_join.near_pairs(spark.createDataFrame(rows, ROWS), "k", "v", 0.6).collect()
    assert [tuple(r) for r in found] == [(1, 2, 1, 2, 0.25)] * 2
    with pytest.raises(Exception, match="one length"):
        metric_join.near_pairs(spark.createDataFrame([(i, [0.0] * (1 + (i == 40))) for i in range(80)], ROWS), "k", "v", 1.0).collect()


def test_block_size():
    assert [metric_join.block_size(n, 64) for n in (0, 1, 10_256, 51_282, 205_128, 10**9)] == [1024, 1024, 1024, 4096, 8547, 16384]
    assert metric_join.block_size(10**9, 1024) == 4096
