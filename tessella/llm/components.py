"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames.

Each step hangs neighbours onto the smallest node in sight; the number of steps grows with the logarithm of a component's
width. Minima are taken by groupBy with partial aggregation and met again by an equi-join, so a node with very many links
is neither collected nor one task's work. Each round is a written table: lineage stays short and lost executors cost one
round at most.

Defined cases: no links give no rows; links to itself and repeated links change nothing; null ends are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _hang(links: DataFrame, larger_only: bool) -> DataFrame:
    """links (u, v): every v next to u hangs onto the least node of u's neighbourhood."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = links.join(least, "u")
    if larger_only:
        moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link to another."""
    own = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    now = written(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, larger_only=True)
        now = written(_hang(large.filter("v < u"), larger_only=False), "links")
