"""Running numbers in an order over whole groups, at any size: a range sort, row numbers inside partitions, and a table of
partition totals, one row a partition and group. No group is one task's work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tessella.sources.scratch import written


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "i") -> DataFrame:
    """df with a running number from 1 in each group, and _n, the rows of the group. Order must tell a group's rows apart.
    Names that begin with an underscore are the operator's own; null keys are groups like others."""
    by = by or []
    # partition numbers must be the same for every reader, hence the table
    placed = written(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranks")
    totals = placed.groupBy("_part", *by).agg(F.count("*").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(["_part", *by])]
    totals = totals.select(*named, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(*by)).alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(["_part", *by])]
    met = placed.join(totals, reduce(lambda a, b: a & b, same))
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return met.select(*df.columns, (inside + F.col("_before")).cast("bigint").alias(name), F.col("_n"))
