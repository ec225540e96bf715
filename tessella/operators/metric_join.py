"""Pairs of vectors within a distance of each other, by pivots, the triangle inequality and matrix products.

Equal vectors are one class. Distances to a few pivots are taken once; classes are sorted by their nearest pivot and the distance
to it, and cut into blocks. Two blocks hold no pair if their distances to some pivot lie further apart than the threshold; all
others meet as arrays, each pair of blocks as a group of its own. Inside, tiles of blocks are told apart by the pivots likewise, then
a matrix product, less a bound of its rounding, leaves few pairs besides those sought, and only these are compared exactly
and become rows. Where the threshold reaches so far that pivots tell nothing apart, every block meets every other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators.ranks import numbered
from tessella.sources.scratch import written

#: Rounding of the threshold, as a part of it, and of distances, as a part of them.
SLACK, ROUNDING = 1e-9, 1e-12
#: Classes in a block, usually and at least (if there are so many); in a tile; pairs that are compared at once; tasks at most.
SIZE, LEAST, TILE, CHUNK, TASKS = 4096, 1024, 128, 4096, 10_000
#: Components in a block of more than SIZE classes, at most.
WHOLE = 2**20
#: Larger distances than this would overflow when squared.
FAR = 1e154
LENGTHS = "vectors must be of one length"
PAIR = ["i", "j", "ni", "nj", "distance"]


def classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """k (smallest key), n and v of each distinct vector that has a key; those with a missing, NaN or infinite component take no part."""
    given = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    given = given.filter("v IS NOT NULL").filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    return given.groupBy("v").agg(F.min("k").alias("k"), F.count("*").alias("n")).filter("k IS NOT NULL")


def _to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each vector to each pivot, at most FAR."""
    with np.errstate(all="ignore"):
        return np.stack([np.minimum(np.sqrt(((v - p) ** 2).sum(1)), FAR) for p in pivots], 1)


def _packed(v: np.ndarray) -> list[bytes]:
    """Each row's bytes, in single precision if that is exact."""
    with np.errstate(all="ignore"):
        short = v.astype("f4")
    return [(s if e else x).tobytes() for s, x, e in zip(short, v, (short == v).all(1), strict=True)]


def _placed(found: DataFrame, pivots: np.ndarray) -> DataFrame:
    """k, n, v (packed), d (distances to pivots), cell (the nearest pivot) and near."""
    size = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column("v")
            if not pc.all(pc.equal(pc.list_value_length(given), size), min_count=0).as_py():
                raise ValueError(LENGTHS)
            v = given.flatten().to_numpy(zero_copy_only=False).reshape(len(given), size)
            d = _to_pivots(v, pivots)
            cell = d.argmin(1).astype("i4")
            made = [pa.array(_packed(v), pa.binary()), pa.array(list(d), pa.list_(pa.float64())), pa.array(cell), pa.array(d[np.arange(len(d)), cell])]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n"), *made], ["k", "n", "v", "d", "cell", "near"])

    return found.select("k", "n", "v").mapInArrow(run, f"k {_kind(found)}, n long, v binary, d array<double>, cell int, near double")


def _kind(found: DataFrame) -> str:
    return found.schema["k"].dataType.simpleString()


def block_pairs(placed: DataFrame, pivots: int, most: float) -> DataFrame:
    """a <= b, the blocks that may hold two classes within `most`; placed: block and d."""
    ends = [f(F.col("d")[i]).alias(f"{name}{i}") for i in range(pivots) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("block").agg(*ends)
    side = lambda s: boxes.select(F.col("block").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in boxes.columns[1:]))
    meets: Column = F.col("a") <= F.col("b")
    for i in range(pivots):
        reach = most + ROUNDING * (F.col(f"a_hi{i}") + F.col(f"b_hi{i}"))
        meets &= (F.col(f"b_lo{i}") - F.col(f"a_hi{i}") <= reach) & (F.col(f"a_lo{i}") - F.col(f"b_hi{i}") <= reach)
    return side("a").join(F.broadcast(side("b")), meets).select("a", "b")


def block_size(classes: int, dimensions: int) -> int:
    """As each block visits all others at worst, there are some 12 to 24 of them as long as a block's components fit WHOLE."""
    return max(min(SIZE, max(LEAST, -(-classes // 12))), min(-(-classes // 24), WHOLE // dimensions))


class _Side:
    """The classes of a block, in order, and its tiles: runs of a cell's classes with the least and greatest distances to each pivot."""

    def __init__(self, rows: pa.Table, pivots: np.ndarray) -> None:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("at", "ascending")])).combine_chunks()
        size, self.k, self.n, cell = pivots.shape[1], rows["k"], rows["n"].to_numpy(), rows["cell"].to_numpy()
        self.v = np.array([np.frombuffer(x, "f4" if len(x) == 4 * size else "f8") for x in rows["v"].to_pylist()], "f8").reshape(-1, size)
        begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.tiles = np.concatenate([np.arange(b, e, TILE) for b, e in zip(begins, [*begins[1:], len(cell)], strict=True)])
        self.ends, d = np.append(self.tiles[1:], len(cell)), _to_pivots(self.v, pivots)
        self.low, self.high = np.minimum.reduceat(d, self.tiles), np.maximum.reduceat(d, self.tiles)
        self.t = np.ascontiguousarray(self.v.T)


def _distances(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of vectors in columns r of x and c of y; squares are added in their order, as SQL does."""
    made = np.empty(len(r))
    with np.errstate(all="ignore"):
        for k in range(0, len(r), CHUNK):
            part = slice(k, k + CHUNK)
            made[part] = np.sqrt(np.add.reduce((x.take(r[part], 1) - y.take(c[part], 1)) ** 2, axis=0))
    return made


def _screens(x: _Side, y: _Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is at most 1, or not a number, where a distance is at most the threshold.

    The product is the squared distance around the common mean and in units of the threshold, less a bound of its rounding; in
    single precision where that bound is small."""
    size, one = x.v.shape[1], lambda s: np.ones((len(s.v), 1))
    bound = lambda kind: 4 * (size + 16) * np.finfo(kind).eps
    with np.errstate(all="ignore"):
        mean = np.concatenate([x.v, y.v]).mean(0)
        a, b = ((s.v - mean) / threshold for s in (x, y))
        p, q = ((m * m).sum(1, keepdims=True) for m in (a, b))
        kind = np.float32 if bound(np.float32) * max(p.max(), q.max()) < 0.05 else np.float64
        less = 1 - bound(kind)
        return np.hstack([-2 * a, less * p, one(x)]).astype(kind), np.hstack([b, one(y), less * q]).astype(kind)


def _left(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b that their product doesn't tell apart."""
    with np.errstate(all="ignore"):
        return np.divmod(np.flatnonzero(~(a @ b.T > 1 + 1e-5)), len(b))


def _meet(rows: pa.Table, pivots: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a block with another, or with itself; a batch for each tile, so that memory holds where all are near."""
    other = pc.equal(rows["role"], 1)
    same = not pc.any(other).as_py()
    x = _Side(rows.filter(pc.invert(other)), pivots)
    y = x if same else _Side(rows.filter(other), pivots)
    left, right = _screens(x, y, threshold)
    keys, n = pa.chunked_array([*x.k.chunks, *y.k.chunks]).combine_chunks(), np.concatenate([x.n, y.n])
    rank = pc.rank(keys, tiebreaker="dense").to_numpy().astype("i8")
    most = threshold * (1 + SLACK)
    for t, (begin, end) in enumerate(zip(x.tiles, x.ends, strict=True)):
        reach = most + ROUNDING * (x.high[t] + y.high)
        near = ((y.low - x.high[t] <= reach) & (x.low[t] - y.high <= reach)).all(1)
        if same:
            near[:t] = False
        at = np.flatnonzero(np.repeat(near, y.ends - y.tiles))
        if not len(at):
            continue
        together = at[-1] - at[0] + 1 == len(at)
        r, c = _left(left[begin:end], right[at[0] : at[-1] + 1] if together else right[at])
        r, c = r + begin, at[c]
        i, j = r, c + len(x.v)
        keep = (rank[i] != rank[j]) & (r < c) if same else rank[i] != rank[j]
        r, c, i, j = r[keep], c[keep], i[keep], j[keep]
        swap = rank[i] > rank[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        made = [keys.take(pa.array(i)), keys.take(pa.array(j)), pa.array(n[i]), pa.array(n[j]), pa.array(_distances(x.t, y.t, r, c))]
        yield pa.RecordBatch.from_arrays(made, PAIR)


def candidates(found: DataFrame, threshold: float, pivots: int = 16, size: int | None = None) -> DataFrame:
    """i < j (keys), ni, nj and distance of the classes that are compared exactly, each pair once; vectors must be of one length."""
    kind = _kind(found)
    schema = f"i {kind}, j {kind}, ni long, nj long, distance double"
    found = written(found, "metric-classes")
    firsts = [r.v for r in found.orderBy(F.xxhash64("k"), "k").limit(pivots).collect()]
    if len({len(v) for v in firsts}) > 1:
        raise ValueError(LENGTHS)
    chosen = np.array(firsts, "f8")
    if not chosen.size:
        return found.sparkSession.createDataFrame([], schema)
    size = size or block_size(found.count(), chosen.shape[1])
    placed = numbered(_placed(found, chosen), ["cell", "near", "k"], name="at")
    placed = written(placed.withColumn("block", F.floor((F.col("at") - 1) / size)), "metric-blocks")
    pairs = written(block_pairs(placed, len(chosen), threshold * (1 + SLACK)), "metric-pairs")
    role = lambda own, k: pairs.select(F.col(own).alias("block"), "a", "b", F.lit(k).alias("role"))
    visits = role("a", 0).union(role("b", 1).filter("a < b"))
    guests = placed.select("block", "at", "k", "n", "v", "cell").join(visits, "block").drop("block")
    guests = guests.repartition(min(TASKS, max(1, pairs.count())), "a", "b").sortWithinPartitions("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            of = np.stack([batch.column(c).to_numpy() for c in ("a", "b")], 1)
            cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]).any(1)]) if len(of) else []
            for begin, end in zip(cuts, [*cuts[1:], len(of)], strict=True):
                if held and at != tuple(of[begin]):
                    yield from _meet(pa.Table.from_batches(held), chosen, threshold)
                    held = []
                at = tuple(of[begin])
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from _meet(pa.Table.from_batches(held), chosen, threshold)

    return guests.mapInArrow(run, schema)


def near_pairs(df: DataFrame, key: str, vector: str, threshold: float, pivots: int = 16, size: int | None = None) -> DataFrame:
    """i < j, the smallest keys of two distinct vectors at most `threshold` apart, how many rows each stands for, and distance."""
    return candidates(classes(df, key, vector), threshold, pivots, size).filter(F.col("distance") <= threshold)
