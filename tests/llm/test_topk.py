import math
import random

import numpy as np

from tessella.llm import topk

KIND = "vec_id long, embedding array<float>, score string"


def brute(rows, asked, k):
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {q: min(w for i, w in sound if i == q) for q, _ in sound if q in asked}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def check(spark, rows, asked, k=5, **options):
    df = spark.createDataFrame([(i, v, "theirs") for i, v in rows], KIND)
    got = topk.top_k(df.filter(df.vec_id.isin(list(asked))), df, k, **options).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, asked, k)
    assert len(got) == len(set(got))


def test_matches_brute_force_with_ties_and_odd_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(i, [0.25] * 8) for i in range(300, 420)]  # equal vectors: ties go to the smaller id
    rows += [(900, None), (901, [None] * 8), (902, [math.nan] + [0.0] * 7), (903, [math.inf] * 8), (None, [0.1] * 8), (904, [0.0] * 8), (905, [3e4] * 8)]
    asked = set(range(0, 420, 30)) | {900, 902, 904, 905}
    check(spark, rows, asked)
    check(spark, rows, asked, block=50)


def test_few_candidates_and_none(spark):
    check(spark, [(1, [0.5, 1.0]), (2, [0.25, -1.0])], {1, 2})
    check(spark, [(1, [0.5, 1.0])], {1})
    check(spark, [], set())
    check(spark, [(1, []), (2, [])], {1})


def test_repeated_rows_and_common_vectors(spark):
    r = random.Random(3)
    rows = [(7, [0.5, 0.25])] * 12 + [(i, [0.5, 0.25]) for i in range(20, 60)] + [(i, [r.gauss(0, 0.2), r.gauss(0, 0.2)]) for i in range(100, 160)]
    check(spark, rows, {7, 20, 100, 110}, block=16)
    check(spark, [(1, [0.5]), (1, [0.25]), (2, [0.5]), (2, [1.0])], {2}, k=2)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    vectors, queries = rng.integers(-300, 300, (200, 16)), rng.integers(-300, 300, (20, 16))
    grid = topk.Grid(vectors.min(axis=0), vectors.max(axis=0))
    low, high = grid.bounds(queries, grid.cells(vectors))
    exact = queries @ vectors.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).max() < np.abs(exact).max()


def test_few_exact_vectors_are_read(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (4000, 32)))]
    read, write = [], topk.written

    def spy(df, label):
        out = write(df, label)
        if label in ("topk-first", "topk-rest"):
            read.append(out.count())
        return out

    monkeypatch.setattr(topk, "written", spy)
    check(spark, rows, set(range(0, 4000, 400)), block=500)
    assert sum(read) < 10 * 4000 * 0.02
