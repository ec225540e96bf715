"""Exact top-k search with a vector-approximation file.

Components become integers, floor(scale * x). The approximation file is a table of its own: for each vector one byte a
component, its cell out of CELLS of equal width between the least and the greatest value of that component.

1. Scan the file in blocks for bounds: from the cells alone a query gets a lower and an upper bound of its inner product
   with each candidate. A block keeps the candidates whose upper bound reaches the kth best lower bound inside it.
2. The k best lower bounds over all blocks, which are all among those kept, give the query's limit: its kth best score is
   no smaller. Only candidates whose upper bound reaches it stay, and only their exact vectors are read, by a join.
3. Exact vectors are read in the order of upper bounds: first each query's FIRST * k best; their kth exact score is a
   sharper limit, and of the others only those whose upper bound reaches it are read. Then the kth result is certain.

Each query block meets each block of the file in a group of its own (about `block` rows at most of either), so the work
is the query set against all rows in blocks, and no group grows with the input; what moves are queries and cells. Rows are
dealt to blocks by row numbers, so equal ids spread over them. Of equal vectors only the k + 1 smallest ids take part: no
other can be among a query's k best, so a vector that a third of all rows have is no crowd that meets its own queries.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id;
vectors of different lengths don't meet. Equal scores go to the smaller id. Repeated rows of a candidate each count (k at most can matter); a
query given more than once counts once (its smallest vector). With fewer than k candidates all come back; without
candidates or queries there is no row. Scores are exact as long as they fit into a long. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import few, written

CELLS, FIRST = 256, 2
#: Below every score, and so is no negative of it.
NO_LIMIT = 1 - 2**63


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in doubles while these are exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Grid:
    """The cells of vectors of one length: component i is in cell (v - least[i]) // width[i]."""

    def __init__(self, least: np.ndarray, most: np.ndarray) -> None:
        self.least, self.width = least, (most - least) // CELLS + 1

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.least) // self.width).astype(np.uint8)

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all inner products: each component is taken at its cell's worse and better edge."""
        base = _inner(queries, self.least[None, :]) + _inner(queries * self.width, cells.astype(np.int64))
        slack = (self.width - 1)[:, None]
        return base + np.minimum(queries, 0) @ slack, base + np.maximum(queries, 0) @ slack


def grids(vectors: DataFrame) -> dict[int, Grid]:
    """One grid for each length of vectors that occurs: two numbers a component."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, some in batch.v.groupby(batch.v.map(len)):
                v = np.stack(some.to_list()).reshape(len(some), n)
                yield pd.DataFrame({"n": n, "i": np.arange(n), "least": v.min(axis=0), "most": v.max(axis=0)})

    found = vectors.select("v").mapInPandas(ends, "n int, i int, least long, most long").groupBy("n", "i").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    table = found.toPandas().sort_values(["n", "i"])
    return {int(n): Grid(g.least.to_numpy(), g.most.to_numpy()) for n, g in table.groupby("n")}


def approximated(vectors: DataFrame, grid: dict[int, Grid]) -> DataFrame:
    """row, id, n and cells (a byte a component)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch.v.map(len)
            for n, some in batch.groupby(sizes):
                cells = grid[n].cells(np.stack(some.v.to_list()).reshape(len(some), n)) if n else np.zeros((len(some), 0), np.uint8)
                yield pd.DataFrame({"row": some.row, "id": some.id, "n": n, "cells": [c.tobytes() for c in cells]})

    return vectors.select("row", "id", "v").mapInPandas(run, "row long, id long, n int, cells binary")


def _best(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each query; a task keeps no more than k of each before rows move."""
    return df.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("at") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256, block: int = 8192, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query."""

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(embedding).cast("array<double>")
        sound = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        ints = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
        return df.filter(sound).select(F.col(vec_id).cast("long").alias("id"), ints.alias("v"))

    # of equal vectors only those of the k + 1 smallest ids can be among the k best of a query
    each = whole(candidates).withColumn("again", F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))).filter(F.col("again") <= k)
    each = each.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= k + 1)
    exact = written(each.select("id", "v", F.monotonically_increasing_id().alias("row")), "topk-vectors")
    grid = grids(exact)
    file = written(approximated(exact, grid), "topk-cells")
    asked = written(whole(queries).groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("q"), "v"), "topk-queries")
    q_blocks, c_blocks = (max(1, -(-df.count() // block)) for df in (asked, file))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({x: [] for x in ("q", "row", "id", "low", "high")}).astype("int64")]
        if len(a) and len(b):
            n = len(a.v.iloc[0])
            cells = np.frombuffer(b"".join(b.cells), np.uint8).reshape(len(b), n)
            for at in range(0, len(a), 128):
                some = a.iloc[at : at + 128]
                low, high = grid[n].bounds(np.stack(some.v.to_list()).reshape(len(some), n), cells) if n else [np.zeros((len(some), len(b)), np.int64)] * 2
                other = some.q.to_numpy()[:, None] != b.id.to_numpy()[None, :]
                low = np.where(other, low, NO_LIMIT)
                at_least = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k] if len(b) >= k else NO_LIMIT
                i, j = np.nonzero((high >= at_least) & other)
                out.append(pd.DataFrame({"q": some.q.to_numpy()[i], "row": b.row.to_numpy()[j], "id": b.id.to_numpy()[j], "low": low[i, j], "high": high[i, j]}))
        return pd.concat(out)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(q_blocks)).cast("int")).withColumn("cb", every(c_blocks)).withColumn("n", F.size("v"))
    right = file.withColumn("cb", F.pmod(F.xxhash64("row"), F.lit(c_blocks)).cast("int")).withColumn("qb", every(q_blocks))
    keys = ["qb", "cb", "n"]
    kept = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q long, row long, id long, low long, high long")
    kept = written(kept, "topk-kept")
    limits = _best(kept, [F.desc("low")], k).groupBy("q").agg(F.min("low").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
    near = kept.join(limits.select("q", "least"), "q", "left").filter("least IS NULL OR high >= least").select("q", "row", "id", "high")
    product = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)

    def read(pairs: DataFrame) -> DataFrame:
        """q, id, score by the exact vectors of the rows named, and no others."""
        rows = written(pairs.select("row").distinct(), "topk-rows")
        vectors = exact.join(few(rows), "row").select("row", F.col("v").alias("w"))
        met = pairs.select("q", "row", "id").join(vectors, "row").join(asked.select("q", "v"), "q")
        return met.select("q", "id", product.alias("score"))

    ordered = near.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("high"), "row")))
    ordered = written(ordered, "topk-order")
    first = written(read(ordered.filter(F.col("at") <= FIRST * k)), "topk-first")
    certain = _best(first, [F.desc("score")], k).groupBy("q").agg(F.min("score").alias("sure"), F.count("*").alias("n")).filter(F.col("n") == k)
    rest = ordered.filter(F.col("at") > FIRST * k).join(certain, "q", "left").filter("sure IS NULL OR high >= sure")
    both = first.unionByName(read(written(rest.select("q", "row", "id"), "topk-rest")))
    ranked = _best(both, [F.desc("score"), F.col("id")], k)
    return ranked.select(F.col("q").alias("query_id"), F.col("at").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
