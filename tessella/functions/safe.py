"""Scalar and aggregate expressions that hold on constant, missing and odd input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def no_nan(c: str | Column) -> Column:
    """NaN as null: Spark's aggregates skip nulls, but let NaN through."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(c)


def clean_numbers(df: DataFrame) -> DataFrame:
    """df with NaN as null in all floating columns."""
    return df.withColumns({n: no_nan(n) for n, t in df.dtypes if t in ("double", "float")})


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over the pairs without nulls; null if either side is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def cv_pop(c: str) -> Column:
    """Coefficient of variation in percent, by the population's deviation; null for one row or a mean that isn't positive."""
    return F.when((F.count(c) > 1) & (F.avg(c) > 0), F.stddev_pop(c) / F.avg(c) * 100)


def cv_samp(c: str) -> Column:
    """Coefficient of variation in percent, by the sample's deviation."""
    return F.try_divide(F.stddev_samp(c), F.avg(c)) * 100


def sample_block(image_id: str | Column, size: int = 5) -> Column:
    """Which block of `size` consecutive ids, both from 1."""
    return F.floor((F.col(image_id) - 1 if isinstance(image_id, str) else image_id - 1) / size) + 1


def replicate(image_id: str, size: int = 5) -> Column:
    return F.pmod(F.col(image_id) - 1, F.lit(size)) + 1


def p_value_text(p: Column) -> Column:
    return F.when(p.isNull(), None).when(p < 0.001, F.lit("<0.001")).otherwise(F.format_number(p, 4))


def p_value_stars(p: Column) -> Column:
    # The usual levels of significance.
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def readable(name: Column) -> Column:
    """A column name for display: modality prefixes spelt out, distance and angle suffixes marked, words capitalised."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^normal_", "optical_"), "_d([0-9])", " D$1"), "_a([0-9]+)", " A$1")
    return F.initcap(F.replace(spaced, F.lit("_"), F.lit(" ")))


def within_levels(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Manhattan distance of two factor levels."""
    return F.abs(a - c) + F.abs(b - d)
