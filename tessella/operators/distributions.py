"""Scaling, binning, densities and resampling. One-row aggregates are broadcast, tables of groups are not; no window
spans the whole table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions.special import normal_quantile
from tessella.sources.scratch import written

from .kernel_sums import kernel_sums
from .quantiles import by_sorting, few_values, quantiles
from .ranks import numbered


def with_stats(df: DataFrame, *stats: Column) -> DataFrame:
    """df beside one row of statistics over it."""
    return df.join(F.broadcast(df.agg(*stats)))


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their means, over their population deviations; constant columns become 0."""
    stats = [s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.when(F.col(c).isNotNull(), F.lit(0.0))) for c in columns}
    return with_stats(df, *stats).withColumns(z).select(*df.columns)


def row_zscores(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, feature, row_z: each value less its row's mean, over its row's population deviation."""
    values = F.array(*(F.col(c).cast("double") for c in columns))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(columns)
    m = wide.select(key, values.alias("v")).withColumn("m", mean(F.col("v")))
    s = m.withColumn("s", F.sqrt(mean(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m"))))))
    names = F.array(*map(F.lit, columns))
    return s.select(key, "m", "s", F.inline(F.arrays_zip(names.alias("feature"), F.col("v").alias("value")))).select(key, "feature", F.try_divide(F.col("value") - F.col("m"), F.col("s")).alias("row_z"))


def minmax(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    met = with_stats(df, F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (high - low) + low
    return met.select(*df.columns, scaled.alias(f"{column}_scaled"))


def below_quantile(df: DataFrame, columns: list[str], q: float = 0.99) -> DataFrame:
    """The rows strictly below the quantile in every column."""
    met, few = df, few_values(df, columns)
    if all(few.values()):
        met = with_stats(df, *(F.percentile(c, F.lit(q)).alias(f"_q_{c}") for c in columns))
    else:
        for c in columns:
            met = met.join(F.broadcast(by_sorting(df, c, [q], []).select(F.col("quantiles")[0].alias(f"_q_{c}"))))
    for c in columns:
        met = met.filter(F.col(c) < F.col(f"_q_{c}"))
    return met.select(*df.columns)


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    met = with_stats(df, *(F.avg(c).alias(f"_m_{c}") for c in columns))
    return met.select(*(F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins 0 .. bins - 1 of equal width, the last one closed; flat data are bin 0."""
    at = F.coalesce(F.floor(F.try_divide(value - low, high - low) * bins), F.lit(0))
    return F.when(value.isNotNull(), F.least(at, F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Counts over the grid of equal-width bins of one or more columns; empty cells are left out."""
    met = with_stats(df, *(s for c in columns for s in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))))
    keys = [bin_of(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), bins).alias(f"bin_{c}") for c in columns]
    edges = {f"center_{c}": F.first(F.col(f"_lo_{c}") + (F.col(f"bin_{c}") + 0.5) * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / bins) for c in columns}
    placed = met.select(*keys, *(f"_{e}_{c}" for c in columns for e in ("lo", "hi"))).na.drop()
    return placed.groupBy(*(f"bin_{c}" for c in columns)).agg(F.count("*").alias("n"), *(e.alias(n) for n, e in edges.items()))


def hexbin(df: DataFrame, x: str, y: str, grid: int = 20) -> DataFrame:
    """Counts over a hexagonal grid: each point goes to the nearer of two interleaved rectangular lattices' centres."""
    met = with_stats(df.select(x, y).na.drop(), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    rows = int(grid / 3**0.5)
    u = F.coalesce(F.try_divide(F.col(x) - F.col("x0"), F.col("x1") - F.col("x0")), F.lit(0.0)) * grid
    v = F.coalesce(F.try_divide(F.col(y) - F.col("y0"), F.col("y1") - F.col("y0")), F.lit(0.0)) * rows
    at = met.select(u.alias("u"), v.alias("v")).select("u", "v", F.floor(F.col("u") + 0.5).alias("a"), F.floor(F.col("v") + 0.5).alias("b"), F.floor("u").alias("c"), F.floor("v").alias("d"))
    near = (F.col("u") - F.col("a")) ** 2 + 3 * (F.col("v") - F.col("b")) ** 2
    far = (F.col("u") - F.col("c") - 0.5) ** 2 + 3 * (F.col("v") - F.col("d") - 0.5) ** 2
    cell = at.select((near < far).alias("even"), F.when(near < far, F.col("a")).otherwise(F.col("c")).alias("col"), F.when(near < far, F.col("b")).otherwise(F.col("d")).alias("row"))
    return cell.groupBy("even", "col", "row").agg(F.count("*").alias("n"))


def terciles(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with Low, Medium or High by exact terciles; intervals are closed on the right, so ties stay together."""
    met = df.join(F.broadcast(quantiles(df, column, [1 / 3, 2 / 3]).select(F.col("quantiles").alias("_q"))))
    label = F.when(F.col(column) <= F.col("_q")[0], "Low").when(F.col(column) <= F.col("_q")[1], "Medium").when(F.col(column).isNotNull(), "High")
    return met.select(*df.columns, label.alias(name))


def boxes(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Five numbers, and the most extreme values within 1.5 interquartile ranges of the box."""
    five = quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0], by).withColumnRenamed("quantiles", "_p")
    named = five.select(*by, *(F.col("_p")[i].alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "most"))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.select(*by, F.col(column).alias("_v")).join(named, by)
    fences = inside.groupBy(*by).agg(F.min(F.when(F.col("_v") >= F.col("q1") - reach, F.col("_v"))).alias("low_fence"), F.max(F.when(F.col("_v") <= F.col("q3") + reach, F.col("_v"))).alias("high_fence"))
    return named.join(fences, by)


#: Kernels reach so many widths (beyond, exp(-32) is left out); buckets are a quarter of a width, expanded to so many terms.
REACH, PARTS, TERMS = 8, 4, 14


def density_1d(df: DataFrame, group: str, column: str, low: float, high: float, points: int, factor: float | None = None, least: int = 3) -> DataFrame:
    """group, g, x, density, scaled (to the group's peak): Gaussian kernel estimate on a grid; the width is factor (Scott's
    rule if none) times the sample deviation. Groups of fewer rows, or without spread, are left out.

    Values meet the grid as buckets: a bucket's values are TERMS sums of powers of their distances d to its middle, since at
    a distance r (both in widths) exp(-(r - d)^2 / 2) = exp(-r^2 / 2) * exp(-d^2 / 2) * sum of (r * d)^k / k!, where |r * d| is 1 at most. What
    is cut off is below 3 / TERMS! of the kernel's peak a value. So the rows are read once, into partial sums, and what meets
    the grid are buckets, within reach only: their number depends on the range and the width, not on the rows."""
    stats = df.groupBy(F.col(group).alias("_of")).agg(F.count(column).alias("n"), F.stddev_samp(column).alias("s")).filter((F.col("n") >= least) & (F.col("s") > 0))
    width = F.col("s") * (F.lit(factor) if factor else F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    stats = written(stats.select("_of", "n", width.alias("h")), "density-widths")
    middle = F.lit(low) + (F.col("bucket") + 0.5) * F.col("h") / PARTS
    placed = df.filter(F.col(column).isNotNull()).select(F.col(group).alias("_of"), F.col(column).cast("double").alias("v")).join(stats, "_of")
    placed = placed.withColumn("bucket", F.floor((F.col("v") - low) / F.col("h") * PARTS))
    placed = placed.withColumn("d", (F.col("v") - middle) / F.col("h")).withColumn("m0", F.exp(-0.5 * F.col("d") * F.col("d")))
    powers = [F.col("m0")]
    for k in range(1, TERMS):
        powers.append(powers[-1] * F.col("d") / k)
    buckets = placed.groupBy("_of", "bucket").agg(F.array(*(F.sum(p) for p in powers)).alias("m"))
    step = (high - low) / (points - 1)
    buckets = buckets.join(stats, "_of").withColumn("c", middle)
    first = F.greatest(F.ceil((F.col("c") - low - REACH * F.col("h")) / step), F.lit(0))
    last = F.least(F.floor((F.col("c") - low + REACH * F.col("h")) / step), F.lit(points - 1))
    met = buckets.filter(first <= last).withColumn("g", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    r = (F.lit(low) + F.col("g") * step - F.col("c")) / F.col("h")
    value = F.aggregate(F.reverse("m"), F.lit(0.0), lambda s, m: s * r + m) * F.exp(-0.5 * r * r)
    mass = met.groupBy("_of", "g").agg(F.sum(value).alias("k"))
    grid = stats.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).join(mass, ["_of", "g"], "left")
    density = F.coalesce("k", F.lit(0.0)) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * 3.141592653589793)))
    made = grid.select("_of", "g", (F.lit(low) + F.col("g") * F.lit(step)).alias("x"), density.alias("density"))
    scaled = F.try_divide(F.col("density"), F.max("density").over(Window.partitionBy("_of")))
    return made.select(F.col("_of").alias(group), "g", "x", "density", scaled.alias("scaled"))


def density_3d(df: DataFrame, key: str, columns: list[str], factor: float = 0.15) -> DataFrame:
    """key, density at every row: Gaussian kernel over all rows, with their covariance times factor squared, within
    kernel_sums.BOUND of the kernel's peak.

    Equal points are one, with their number as weight. Without a full covariance, density is 1."""
    given = df.select(F.col(key).alias("key"), *(F.col(x).cast("double").alias(n) for x, n in zip(columns, "abc", strict=True))).na.drop()
    means = [F.avg(n).alias(f"m{n}") for n in "abc"]
    cov = given.agg(*(F.covar_samp(x, y).alias(x + y) for x, y in ("aa", "bb", "cc", "ab", "ac", "bc")), *means, F.count("*").alias("n")).first()
    flat = given.select(F.col("key").alias(key), F.lit(1.0).alias("density"))
    if cov.n < 2:
        return flat
    m = factor**2 * np.array([[cov.aa, cov.ab, cov.ac], [cov.ab, cov.bb, cov.bc], [cov.ac, cov.bc, cov.cc]])
    det = float(np.linalg.det(m))
    if not det > 0:
        return flat
    whiten, scale = np.linalg.inv(np.linalg.cholesky(m)), cov.n * float(np.sqrt((2 * np.pi) ** 3 * det))
    from_mean = [F.col(n) - F.lit(cov[f"m{n}"]) for n in "abc"]
    axes = [sum((float(whiten[i, j]) * from_mean[j] for j in range(1, i + 1)), float(whiten[i, 0]) * from_mean[0]).alias(n) for i, n in enumerate("xyz")]
    points = given.groupBy("a", "b", "c").agg(F.count("*").cast("double").alias("w"))
    made = kernel_sums(points.select("a", "b", "c", *axes, "w"))
    made = made.groupBy("a", "b", "c").agg((F.max("s") / scale).alias("density"))
    return given.join(made, ["a", "b", "c"]).select(F.col("key").alias(key), "density")


def normal_plot(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """group, i, p, sample, theoretical: ordered values against normal quantiles at Filliben's medians of ranks. The order
    is a range sort, so a group is spread over as many tasks as it fills."""
    given = df.filter(F.col(value).isNotNull()).select(group, F.col(value).alias("_v"), F.col(key).alias("_key"))
    ranked = numbered(given, ["_v", "_key"], [group])
    n, i = F.col("_n"), F.col("i")
    end = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365))
    return ranked.select(group, "i", p.alias("p"), F.col("_v").alias("sample")).withColumn("theoretical", normal_quantile(F.col("p")))


def normal_fit(plot: DataFrame, group: str) -> DataFrame:
    x, y = F.col("theoretical"), F.col("sample")
    return plot.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


#: Multipliers and modulus of the generator of resampling weights.
DRAW_A, DRAW_B, DRAW_C, DRAW_M = 48271, 16807, 11, 2147483647
#: From these values of the generator on, a row counts once, twice and so on: the shares of a Poisson distribution of mean 1.
DRAW_LIMITS = [int(DRAW_M * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def draw_weights(key: Column, draws: int) -> Column:
    """How often a row counts in each of the draws, from fixed arithmetic on its key and the draw's number."""
    limits = F.array(*map(F.lit, DRAW_LIMITS))

    def weights(x: Column) -> Column:
        def weight(b: Column) -> Column:
            y = (b * DRAW_A + DRAW_C) % DRAW_M

            def mixed(u: Column) -> Column:
                return F.size(F.filter(limits, lambda t: t <= (u * u + x + y) % DRAW_M)).cast("double")

            return F.transform(F.array((x * y) % DRAW_M), mixed)[0]

        return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long")), weight)

    return F.transform(F.array((F.pmod(key.cast("long"), F.lit(DRAW_M)) * DRAW_B + DRAW_C) % DRAW_M), weights)[0]


def bootstrap(df: DataFrame, group: str, value: str, key: str, draws: int, least: int = 6) -> DataFrame:
    """Percentile interval of the mean from `draws` resamples of each group, in one pass.

    In a draw every row counts as often as its weight says: independent Poisson weights of mean 1, which is what drawing n
    of n rows comes to for each row. A row becomes one vector, its weights and its weighted values, and vectors are summed by
    partial aggregation, so no draw is ever a row. Groups below `least` rows get nulls; rows without a
    key count as if it were 0."""
    given = df.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"), F.coalesce(F.col(key), F.lit(0)).alias("r"))
    sizes = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    weighted = given.withColumn("w", draw_weights(F.col("r"), draws)).select(group, array_to_vector(F.concat("w", F.transform("w", lambda w: w * F.col("v")))).alias("x"))
    sums = weighted.groupBy(group).agg(vector_to_array(Summarizer.sum(F.col("x"))).alias("x"))
    means = F.array_sort(F.filter(F.zip_with(F.slice("x", 1, draws), F.slice("x", draws + 1, draws), lambda w, s: F.try_divide(s, w)), lambda m: m.isNotNull()))
    at = lambda q: q * (F.size("m") - 1)
    low = lambda q: F.get("m", F.floor(at(q)).cast("int"))
    end = lambda q: low(q) + (at(q) - F.floor(at(q))) * (F.get("m", F.ceil(at(q)).cast("int")) - low(q))
    ends = sums.select(F.col(group).alias("_g"), means.alias("m")).select("_g", end(0.025).alias("low"), end(0.975).alias("high"))
    met = sizes.join(ends, F.col(group).eqNullSafe(F.col("_g")), "left")
    enough = F.col("n") >= least
    return met.select(group, "n", "mean", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))
