"""Linear interpolation of scattered places on a grid, over their Delaunay triangulation, at any number of places.

The triangulation is never built as a whole: a grid point needs only the triangle that it lies in. Lifted onto the paraboloid
around a grid point q, places make a lower hull, and the triangle under q is the facet where the hull is lowest. That is a small
linear program a grid point, solved by adding the places that violate its current answer:

1. one pass over the places takes the nearest in each of eight sectors around every grid point;
2. of these, the triangle around q with the lowest lift is the answer so far. A place inside its circle is a violation. If
   no triangle holds q, the line that parts q from them is the answer, and a place beyond that line a violation;
3. the next pass finds, for the grid points still open, the deepest violation in each sector, which joins the answer's own
   corners; and so on until there's none. The triangle's circle is then empty of all places, so it is a Delaunay triangle.

A pass is blocks of places against the grid, with partial minima: what leaves a block, and what is collected, are eight rows
a grid point at most, whatever the number of places.

Beyond the places' hull, and where no three places make a triangle, the value is the nearest place's. Where four places or
more lie on one circle there are several such triangulations; which one holds is fixed by the places' order, not by partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.sources.scratch import written

#: Places of a block.
BLOCK = 2048
#: Parts of the magnitudes of its terms by which a score must be negative, and of an area by which a corner's weight may be.
SLACK, EDGE = 1e-10, 1e-9
#: Grid points are located a little nearer to the middle, and a little aside, so that none lies on an edge.
INWARD, ASIDE = 1e-7, 1e-10


def sector(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x >= 0) + 2 * (y >= 0) + 4 * (np.abs(x) >= np.abs(y))


def deepest(places: DataFrame, at: np.ndarray, asked: np.ndarray, score: np.ndarray, first: bool) -> dict[int, np.ndarray]:
    """For each grid point of `asked` the places (x, y, v) of least score in each sector, where it is negative (or always).

    score: a row (a, b, c, d) a grid point; a place at (x, y) from it scores a * (x * x + y * y) + b * x + c * y + d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, c, d = score.T
        for batch in batches:
            every = np.stack([batch[n].to_numpy(zero_copy_only=False) for n in ("x", "y", "v")], 1)
            for begin in range(0, len(every), BLOCK):
                p = every[begin : begin + BLOCK]
                p = p[np.lexsort((p[:, 1], p[:, 0], p[:, 2]))]  # of equal scores the first counts
                x, y = p[:, :1] - at[asked, 0], p[:, 1:2] - at[asked, 1]
                squares = a * (x * x + y * y)
                s = squares + b * x + c * y + d
                if not first:
                    s = np.where(s < -SLACK * (squares + np.abs(b * x) + np.abs(c * y) + np.abs(d)), s, np.inf)
                of = sector(x, y)
                for k in range(8):
                    masked = np.where(of == k, s, np.inf)
                    best = masked.argmin(0)
                    found = np.flatnonzero(np.isfinite(masked[best, np.arange(len(asked))]))
                    rows = p[best[found]]
                    made = [asked[found].astype(np.int32), np.full(len(found), k, np.int32), masked[best[found], found], rows[:, 2], rows[:, 0], rows[:, 1]]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, made)), ["q", "k", "s", "v", "x", "y"])

    parts = places.mapInArrow(run, "q int, k int, s double, v double, x double, y double")
    out: dict[int, list] = {}
    for r in parts.groupBy("q", "k").agg(F.min(F.struct("s", "v", "x", "y")).alias("m")).select("q", "m.*").collect():
        out.setdefault(r.q, []).append((r.s, r.v, r.x, r.y))
    return {q: np.array([(x, y, v) for _, v, x, y in sorted(rows)]) for q, rows in out.items()}


def facet(points: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The corners of the triangle of points around the origin with the lowest lift, and the lift; None if no triangle holds it."""
    if len(points) < 3:
        return None
    corners = np.array(list(combinations(range(len(points)), 3)))
    a, b, c = (points[corners[:, i]] for i in range(3))
    cross = lambda u, w: u[:, 0] * w[:, 1] - u[:, 1] * w[:, 0]
    weights = np.stack([cross(b, c), cross(c, a), cross(a, b)], 1)
    area = weights.sum(1)
    span = np.abs(weights).sum(1)
    holds = (np.abs(area) > EDGE * span) & (weights * np.sign(area)[:, None] >= -EDGE * span[:, None] * 1e-3).all(1) & (span > 0)
    if not holds.any():
        return None
    lift = (points**2).sum(1)
    height = (weights[holds] * lift[corners[holds]]).sum(1) / area[holds]
    return corners[holds][height.argmin()], float(height.min())


def circle(points: np.ndarray) -> tuple[float, float, float, float]:
    """The score that is negative inside the circle through three points."""
    m = np.column_stack([points, np.ones(3)])
    x, y, d = np.linalg.solve(m, (points**2).sum(1))
    return 1.0, -x, -y, -d


def parting(points: np.ndarray) -> tuple[np.ndarray, float, tuple[float, float, float, float]]:
    """The one or two points that are next to the origin, how far they are (squared), and the score that is negative beyond
    the line that parts them from it."""
    best, corners, foot = np.inf, np.array([0]), points[0]
    for i in range(len(points)):
        for j in range(i, len(points)):
            u = points[j] - points[i]
            t = np.clip(-(points[i] @ u) / (u @ u), 0, 1) if u @ u > 0 else 0.0
            at = points[i] + t * u
            if at @ at < best:
                best, corners, foot = at @ at, np.array([i] if i == j else [i, j]), at
    return corners, float(best), (0.0, foot[0], foot[1], -float(best) * (1 - 1e-9))


def linear_values(places: DataFrame, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The interpolated values at the points `at` (rows x, y). places: x, y, v, no place twice; inside: a point of their hull."""
    # a hull is the same at any scale, a line that parts is found best on equal ones
    scale = np.where(np.ptp(at, axis=0) > 0, np.ptp(at, axis=0), 1.0)
    turned = np.stack([-(at - inside)[:, 1], (at - inside)[:, 0]], 1)
    moved = at + INWARD * (inside - at) + ASIDE * turned
    n = len(at)
    near = deepest(places, moved, np.arange(n), np.tile([1.0, 0.0, 0.0, 0.0], (n, 1)), True)
    # of equal distances the smaller value counts
    nearest = {q: min(zip(np.round(((p[:, :2] - at[q]) ** 2).sum(1), 9), p[:, 2], strict=True))[1] for q, p in near.items()}
    values, known = np.array([nearest[q] for q in range(n)]), near
    asked = np.arange(n)
    corners: dict[int, np.ndarray] = {}
    reached: dict[int, tuple[int, float]] = {}
    while len(asked):
        score, going = np.zeros((n, 4)), []
        for q in asked:
            p = known[q][:, :2] - moved[q]
            if found := facet(p):
                kept, level = found[0], (0, found[1])
            else:
                kept, far, line = parting(p / scale)
                level = (1, far)
            if level < reached.get(q, (2, 0.0)):  # else only rounding is left
                score[q] = (line[0], *(np.array(line[1:3]) / scale), line[3]) if level[0] else circle(p[kept])
                corners[q], reached[q] = known[q][kept], level
                going.append(q)
        more = deepest(places, moved, np.array(going), score[going], False) if going else {}
        known = {q: np.unique(np.concatenate([corners[q], p]), axis=0) for q, p in more.items()}
        asked = np.array(sorted(known), dtype=int)
    for q, p in corners.items():
        if len(p) == 3:
            weights = np.linalg.solve(np.column_stack([p[:, :2] - at[q], np.ones(3)]).T, [0.0, 0.0, 1.0])
            values[q] = weights @ p[:, 2]
    return values


def linear_surface(points: DataFrame, x: str, y: str, value: str, side: int) -> DataFrame:
    """gy, gx, value on a grid of side * side over the points' range. Points of one place are averaged; rows with a missing
    number are left out. Without points there is no row."""
    spark = points.sparkSession
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    given = points.filter(finite(x) & finite(y) & finite(value)).select(*(F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (value, "v"))))
    places = written(given.groupBy("x", "y").agg(F.avg("v").alias("v")), "surface-places")
    box = places.agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max), ("m", F.avg)))).first()
    if box.x0 is None:
        return spark.createDataFrame([], "gy int, gx int, value double")
    gy, gx = (g.ravel() for g in np.mgrid[0:side, 0:side])
    step = lambda low, high: (high - low) / max(side - 1, 1)
    at = np.stack([box.x0 + gx * step(box.x0, box.x1), box.y0 + gy * step(box.y0, box.y1)], 1)
    values = linear_values(places, at, np.array([box.xm, box.ym]))
    return spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(gy, gx, values, strict=True)], "gy int, gx int, value double")
