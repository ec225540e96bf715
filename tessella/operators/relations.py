"""Correlation, analysis of variance, and the graphs that follow from them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from tessella.functions.safe import safe_corr, within_levels
from tessella.functions.special import f_p_value, r_p_value
from tessella.sources.scratch import written

from .quantiles import quantiles


def correlation(df: DataFrame, x: str, y: str, by: list[str] | None = None, p_value: bool = False) -> DataFrame:
    """r, r2 and the number of pairs; with p_value also the two-sided p."""
    pairs = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n")
    out = df.groupBy(*(by or [])).agg(safe_corr(x, y).alias("r"), pairs).withColumn("r2", F.col("r") * F.col("r"))
    return out.withColumn("p", r_p_value(F.col("r"), F.col("n"))) if p_value else out


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every ordered pair of columns, from one aggregation over the data."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*(safe_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)))
    cells = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.col(f"s{i}") > 0, F.lit(1.0)).alias("r")) for i, c in enumerate(columns)]
    for i, (a, b) in enumerate(pairs):
        cells += [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")) for x, y in ((a, b), (b, a))]
    return wide.select(F.inline(F.array(*cells)))


def wide_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """matrix() of many columns, from one pass that sums their products; rows with a missing value are left out."""
    values = F.array(*(F.col(c).cast("double") for c in columns))
    x = df.select(values.alias("_a")).filter(F.forall("_a", lambda v: v.isNotNull() & ~F.isnan(v))).select(array_to_vector("_a").alias("_f"))
    r = Correlation.corr(x, "_f").first()[0].toArray()
    cells = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(cells, "a string, b string, r double")


def network(correlations: DataFrame, threshold: float) -> DataFrame:
    """Undirected edges a < b whose |r| is above the threshold."""
    return correlations.filter((F.col("a") < F.col("b")) & (F.abs("r") > threshold)).select("a", "b", F.col("r").alias("correlation"), F.abs("r").alias("weight"))


def density(edges: DataFrame, nodes: int) -> DataFrame:
    most = nodes * (nodes - 1)
    return edges.agg(F.count("*").alias("n_edges")).select(F.lit(nodes).cast("long").alias("n_nodes"), "n_edges", (2.0 * F.col("n_edges") / F.lit(float(max(1, most)))).alias("density"))


def paired(df: DataFrame, pairs: list[tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of the correlations of column pairs."""
    each = df.groupBy(*(by or [])).agg(F.array(*(safe_corr(a, b) for a, b in pairs)).alias("_r")).select(*(by or []), F.explode("_r").alias("r"))
    return each.groupBy(*(by or [])).agg(F.avg("r").alias("r_mean"), F.stddev_pop("r").alias("r_std"), F.count("r").alias("n"))


def anova(df: DataFrame, group: str, value: str, p_value: bool = False) -> DataFrame:
    """One-way: k, n, F, eta_squared, and with p_value the upper tail. Null where there's nothing to compare."""
    per = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    # deviations from the grand mean, not a difference of large squares
    grand = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    apart = F.col("m") - F.col("grand")
    total = per.join(F.broadcast(grand)).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * apart * apart).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw")
    )
    between, within = F.col("k") - 1, F.col("n") - F.col("k")
    out = total.select(
        "k",
        "n",
        F.try_divide(F.try_divide(F.col("ssb"), between), F.try_divide(F.col("ssw"), within)).alias("f"),
        F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_squared"),
    )
    return out.withColumn("p", f_p_value(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k"))) if p_value else out


def adjacent(levels: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Directed edges between factor combinations one level apart; levels: a dimension table of a few rows."""
    a, b = (levels.select(F.col(key).alias(f"{key}_{s}"), F.col(first).alias(f"f{s}"), F.col(second).alias(f"s{s}")) for s in "ab")
    near = within_levels(F.col("fa"), F.col("sa"), F.col("fb"), F.col("sb")) == 1
    return a.join(F.broadcast(b), near).select(F.col(f"{key}_a").alias("source"), F.col(f"{key}_b").alias("target"))


def distances(df: DataFrame, key: str, vector: str, first: int = 50) -> DataFrame:
    """i, j, distance, similarity 1 / (1 + d) of the first rows by key with every row, itself included.

    Components are standardised over all rows first, missing ones count as their mean; constant ones are 0. How many rows
    are asked for is the operator's own parameter, so the work and the result grow with the rows alone."""
    given = written(df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k IS NOT NULL AND v IS NOT NULL"), "distance-vectors")
    stats = given.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = F.broadcast(stats.agg(F.sort_array(F.collect_list(F.struct("at", "m", "s"))).alias("stats")))  # one row of the vectors' length
    z = F.transform("v", lambda x, i: F.coalesce(F.try_divide(x - F.col("stats")[i]["m"], F.col("stats")[i]["s"]), F.lit(0.0)))
    scaled = given.join(stats).select("k", z.alias("v"))
    asked = scaled.orderBy("k").limit(first).select(F.col("k").alias("i"), F.col("v").alias("vi"))
    squares = F.aggregate(F.zip_with("vi", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    met = scaled.withColumnRenamed("k", "j").join(F.broadcast(asked))
    return met.select("i", "j", F.sqrt(squares).alias("distance")).withColumn("similarity", 1 / (1 + F.col("distance")))


def similarity_edges(pairs: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Edges i < j whose similarity is above an exact quantile of all pairs, those of a row with itself included."""
    pairs = written(pairs, "similarity-pairs")
    edge = quantiles(pairs, "similarity", [quantile]).select(F.col("quantiles")[0].alias("threshold"))
    return pairs.join(F.broadcast(edge)).filter("i < j AND similarity > threshold").select("i", "j", F.col("similarity").alias("weight"))
