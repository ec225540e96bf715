"""Exact quantiles at any size.

A column of few distinct values goes through one aggregation, whose state is a count for each of them. With many, that
state would be one task's; then distinct values are counted, range-sorted, and ranks follow from running sums inside
partitions and a table of partition totals. Both give the same numbers: linear interpolation between order statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tessella.sources.scratch import written

#: Up to so many distinct values (estimated) are counted in one state.
FEW = 1_000_000


def few_values(df: DataFrame, columns: list[str], few: int = FEW) -> dict[str, bool]:
    found = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
    return {c: found[c] <= few for c in columns}


def by_sorting(df: DataFrame, column: str, shares: list[float], by: list[str]) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    placed = written(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "quantiles")
    inside = Window.partitionBy("_part", *by).orderBy("_v")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *by).agg(F.sum("_c").alias("_t"))
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(["_part", *by])]
    totals = totals.select(*named, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"), F.sum("_t").over(Window.partitionBy(*by)).alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(["_part", *by])]
    ranks = placed.join(totals, reduce(lambda a, b: a & b, same))
    end = F.sum("_c").over(inside) + F.col("_o")
    ranks = ranks.withColumn("_end", end).withColumn("_begin", F.col("_end") - F.col("_c"))
    picked = []
    for q in shares:
        at = F.lit(q) * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        hit = lambda r: F.max(F.when((F.col("_begin") <= r) & (r < F.col("_end")), F.col("_v")))
        picked.append(hit(low) + (hit(high) - hit(low)) * (F.max(at) - F.max(low)))
    return ranks.groupBy(*by).agg(F.array(*picked).alias("quantiles"))


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None, few: int = FEW) -> DataFrame:
    """by..., quantiles: an array in the order of shares. Nulls don't count; a group without values gets nulls or no row."""
    by = by or []
    if few_values(df, [column], few)[column]:
        return df.groupBy(*by).agg(F.percentile(column, F.array(*map(F.lit, shares))).alias("quantiles"))
    return by_sorting(df, column, shares, by)
