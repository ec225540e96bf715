"""Group summaries: several statistics of several columns in one aggregation each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.safe import cv_pop, cv_samp

from .quantiles import by_sorting, few_values
from .ranks import numbered


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """by..., feature, and count, mean, std, min, quartiles (exact), max of each column, in long form."""
    made, by, shares = [], by or [], [0.25, 0.5, 0.75]
    few = few_values(df, columns)
    if not all(few.values()):
        return reduce(DataFrame.unionByName, (_describe_sorted(df, c, by, shares) for c in columns))
    for c in columns:
        quartiles = F.percentile(c, F.array(*map(F.lit, shares)))
        made.append(
            F.struct(
                F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"),
                quartiles[0].alias("q1"), quartiles[1].alias("median"), quartiles[2].alias("q3"), F.max(c).alias("most"),
            ).alias(c)
        )
    wide = df.groupBy(*by).agg(*made)
    return wide.select(*by, F.inline(F.array(*columns)))


def _describe_sorted(df: DataFrame, c: str, by: list[str], shares: list[float]) -> DataFrame:
    """describe() of one column of very many values."""
    stats = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"))
    q = by_sorting(df, c, shares, by)
    met = stats.join(q, by, "left") if by else stats.join(F.broadcast(q), how="left")
    names = zip(("q1", "median", "q3"), range(3), strict=True)
    return met.select(*by, F.lit(c).alias("feature"), "n", "mean", "std", "least", *(F.col("quantiles")[i].alias(x) for x, i in names), "most")


def summary(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean, sample deviation, least, most of each column, and the rows of each group."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in columns for n, f in stats.items()))


def rate(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """Percentage of rows with the flag."""
    return df.groupBy(*by).agg((F.avg(flag.cast("double")) * 100).alias("rate_pct"), F.count("*").alias("n"))


def variation(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(column).alias("n"), cv_pop(column).alias("cv_pop"), cv_samp(column).alias("cv_samp"))


def mean_of(stats: DataFrame, by: list[str], column: str) -> DataFrame:
    """The mean of a group statistic over coarser groups."""
    return stats.groupBy(*by).agg(F.avg(column).alias(f"mean_{column}"), F.count(column).alias("n_groups"))


def first_by(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each group's first row in a total order."""
    first = df.groupBy(*by).agg(F.min(F.struct(*order, *columns)).alias("_f"))
    return first.select(*by, *(F.col(f"_f.{c}").alias(f"first_{c}") for c in columns))


def pivot_mean(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Means by row and column key; the column keys are given, so that no extra pass looks for them."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def reindexed(df: DataFrame, key: str, order: list, place: str = "place") -> DataFrame:
    """The rows of df by a fixed order of keys: `place` counts them from 0. Keys that df doesn't have are rows of nulls, keys
    that the order doesn't have are left out, as are null keys; keys that df has more than once keep all their rows."""
    kind = df.schema[key].dataType.simpleString()
    ordinals = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(dict.fromkeys(order))], f"_place int, _key {kind}")
    # a table of the caller's own few keys
    met = df.join(F.broadcast(ordinals), F.col(key) == F.col("_key"))
    absent = ordinals.join(met.select(F.col("_key").alias("_had")).distinct(), F.col("_key") == F.col("_had"), "left_anti")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col("_key").alias(key) for f in df.schema]
    return met.select(F.col("_place").alias(place), *df.columns).unionByName(absent.select(F.col("_place").alias(place), *rest))


def ranges(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each column of a table of group means: its range over the groups and its coefficient of variation."""
    long = wide.unpivot([key], columns, "feature", "value")
    return long.groupBy("feature").agg((F.max("value") - F.min("value")).alias("value_range"), cv_samp("value").alias("cv_pct"))


def weighted_sum(long: DataFrame, factors: DataFrame, by: str, component: str, amount: str, factor: str) -> DataFrame:
    """Sum of amount times the component's factor, and of the amounts alone."""
    met = long.join(factors, component)
    return met.groupBy(by).agg(F.sum(F.col(amount) * F.col(factor)).alias("weighted"), F.sum(amount).alias("total"))


def mean_shares(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means of the columns, scaled to sum to 1 in each group."""
    means = df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))
    total = reduce(lambda a, b: a + b, map(F.col, columns))
    return means.select(*by, *(F.try_divide(F.col(c), total).alias(f"{c}_share") for c in columns))


def mean_over_most(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Radar metrics: each column's mean as a share of its largest value, in long form."""
    wide = df.groupBy(*by).agg(*(F.try_divide(F.avg(c), F.max(c)).alias(c) for c in columns))
    return wide.unpivot(by, columns, "metric", "score") if by else wide.withColumn("_", F.lit(0)).unpivot(["_"], columns, "metric", "score").drop("_")


def factorial_design(*factors: DataFrame) -> DataFrame:
    """Every combination of the factors' levels; meant for dimension tables of a few rows."""
    return reduce(lambda a, b: a.crossJoin(b), factors)


def most_variable(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k columns of the largest absolute coefficient of variation."""
    wide = df.agg(*(F.abs(cv_samp(c)).alias(c) for c in columns)).withColumn("_", F.lit(0))
    return wide.unpivot(["_"], columns, "feature", "cv_pct").select("feature", "cv_pct").orderBy(F.desc_nulls_last("cv_pct"), "feature").limit(k)


def by_mean(means: DataFrame, mean: str, key: str) -> DataFrame:
    """Group means with their place from 1 in the order of the means, largest first; ties by key, null means last."""
    order = means.withColumn("_last", F.col(mean).isNull()).withColumn("_less", -F.col(mean))
    return numbered(order, ["_last", "_less", key], name="place").select(*means.columns, "place")


def profile(df: DataFrame, by: list[str], scores: dict[str, str]) -> DataFrame:
    """by..., metric, score: a radar vector of scores of different kinds, by column: "max", the mean over the largest
    value; "spread", 1 less the coefficient of variation; "rate", the share of rows above 0. Null where undefined."""
    kinds = {
        "max": lambda c: F.try_divide(F.avg(c), F.max(c)),
        "spread": lambda c: 1 - F.try_divide(F.stddev_samp(c), F.avg(c)),
        "rate": lambda c: F.avg((F.col(c) > 0).cast("double")),
    }
    return df.groupBy(*by).agg(*(kinds[k](c).alias(c) for c, k in scores.items())).unpivot(by, list(scores), "metric", "score")
