"""Sums of Gaussian kernels in three dimensions at every point of a table, with a grid as index.

Points are whitened, so the kernel is exp(-|u - v|^2 / 2), and dealt into cells of edge CELL. A cell of up to DIRECT points is
its points; a fuller one is its moments about its middle, the sums of exp(-|d|^2 / 2) * d^a / a! over all powers a below degree
TERMS, since exp(r . d) is the sum of r^a * d^a / a!. So what a point meets are cells, however many points they hold: points times
cells within reach, which grows with the points and not with their square.

Cells and points meet in blocks of SPAN cells an edge, as wide as the kernel reaches: a cell goes to the 27 blocks around it, a
block's points are dealt into parts of about PART. Nothing else grows with a block.

Left out are kernels beyond REACH, each below exp(-REACH^2 / 2) = 6e-13 of the peak, and terms of degree TERMS and more, below
1e-9 of it: a mean of kernels is off by less than BOUND times their peak.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tessella.sources.scratch import written

CELL, SPAN, REACH, TERMS = 0.5, 15, 7.5, 12
DIRECT, PART = 32, 4096
BOUND = 2e-9
_POWERS = [a for a in product(range(TERMS), repeat=3) if sum(a) < TERMS]
_U, _CELL = ["x", "y", "z"], ["i", "j", "k"]
#: Cells that may be evaluated at once, times points.
_AT_ONCE = 1 << 19


def _monomials(d: np.ndarray) -> Iterator[np.ndarray]:
    """d^a for all powers, in their order; the last axis of d are the dimensions."""
    powers = [[np.ones(d.shape[:-1])] for _ in range(3)]
    for axis in range(3):
        for _ in range(TERMS - 1):
            powers[axis].append(powers[axis][-1] * d[..., axis])
    for a, b, c in _POWERS:
        yield powers[0][a] * powers[1][b] * powers[2][c]


def moments(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of points at d from a cell's middle: one column a power."""
    by = w * np.exp(-0.5 * (d**2).sum(1))
    return np.stack([m * by / (factorial(a) * factorial(b) * factorial(c)) for m, (a, b, c) in zip(_monomials(d), _POWERS, strict=True)], 1)


def sources(points: DataFrame) -> DataFrame:
    """i, j, k, x, y, z, m: what cells are to others, a point with its weight alone or a middle with moments."""
    n = points.groupBy(*_CELL).agg(F.count("*").alias("n"))
    sized = points.join(n, _CELL)
    few = sized.filter(F.col("n") <= DIRECT).select(*_CELL, *_U, F.array("w").alias("m"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cells, at = np.unique(batch[_CELL].to_numpy(), axis=0, return_inverse=True)
                d = batch[_U].to_numpy() - (cells[at.ravel()] + 0.5) * CELL
                sums = np.zeros((len(cells), len(_POWERS)))
                np.add.at(sums, at.ravel(), moments(d, batch.w.to_numpy()))
                yield pd.DataFrame(cells, columns=_CELL).assign(m=list(sums))

    full = sized.filter(F.col("n") > DIRECT).select(*_CELL, *_U, "w").mapInPandas(partial, "i long, j long, k long, m array<double>")
    full = full.groupBy(*_CELL).agg(vector_to_array(Summarizer.sum(array_to_vector("m"))).alias("m"))
    middles = [((F.col(c) + 0.5) * CELL).alias(u) for c, u in zip(_CELL, _U, strict=True)]
    return few.unionByName(full.select(*_CELL, *middles, "m"))


def _sums(at: np.ndarray, of: np.ndarray, m: list[np.ndarray]) -> np.ndarray:
    """Kernel sums at points near each other, over what is within reach of all of them."""
    near = ((np.maximum(0, np.maximum(at.min(0) - of, of - at.max(0))) ** 2).sum(1)) <= (REACH + CELL) ** 2
    out = np.zeros(len(at))
    of, m = of[near], [x for x, n in zip(m, near, strict=True) if n]
    single = np.array([len(x) == 1 for x in m], dtype=bool)
    for rows in (single, ~single):
        some, values = of[rows], [x for x, r in zip(m, rows, strict=True) if r]
        step = max(1, _AT_ONCE // max(len(at), 1))
        for begin in range(0, len(some), step):
            r = at[:, None, :] - some[None, begin : begin + step]
            own = np.stack(values[begin : begin + step])
            total = own[None, :, 0] if own.shape[1] == 1 else sum(x * c for x, c in zip(_monomials(r), own.T, strict=True))
            out += (np.exp(-0.5 * (r**2).sum(-1)) * total).sum(1)
    return out


def kernel_sums(points: DataFrame) -> DataFrame:
    """points (id columns, x, y, z whitened, w) with s, the sum of all points' weighted kernels there; no place twice."""
    cells = [F.floor(F.col(u) / CELL).alias(c) for c, u in zip(_CELL, _U, strict=True)]
    blocks = [F.floor(F.col(c) / SPAN).alias(f"b{c}") for c in _CELL]
    names = [f"b{c}" for c in _CELL]
    points = written(points.select("*", *cells).select("*", *blocks), "kernel-points")
    parts = written(points.groupBy(*names).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "kernel-blocks")
    asked = points.join(parts, names).withColumn("part", F.pmod(F.xxhash64(*_U), F.col("parts")).cast("int"))
    around = F.explode(F.array(*(F.struct(*((F.col(n) + d).alias(n) for n, d in zip(names, move, strict=True))) for move in product((-1, 0, 1), repeat=3))))
    given = sources(points).select(*_U, "m", *blocks).select(*_U, "m", around.alias("to")).select(*_U, "m", "to.*")
    given = given.join(parts, names).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # other names, as both sides come from the same points
    given = given.select(*(F.col(c).alias(f"of_{c}") for c in [*names, "part", *_U, "m"]))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"x": [], "y": [], "z": [], "s": []})
        x = x.sort_values([*_CELL, *_U], ignore_index=True)
        at, of, m = x[_U].to_numpy(), y[[f"of_{u}" for u in _U]].to_numpy(), [np.asarray(v) for v in y.of_m]
        out = np.concatenate([_sums(at[i : i + 64], of, m) for i in range(0, len(at), 64)])
        return x[_U].assign(s=out)

    key = [*names, "part"]
    made = asked.groupBy(*key).cogroup(given.groupBy(*(f"of_{c}" for c in key))).applyInPandas(meet, "x double, y double, z double, s double")
    return points.drop(*_CELL, *names).join(made, _U)
