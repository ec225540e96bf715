"""Tails of the F and t distributions, as Arrow UDFs over the few rows that statistics leave, and the normal quantile."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, between: float, within: float) -> float:
    return beta_share(within / 2, between / 2, within / (within + between * f))


def t_tails(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def _over(rows: pd.DataFrame, f) -> pd.Series:
    return pd.Series([None if any(pd.isna(x) for x in r) else f(*r) for r in zip(*(rows[c] for c in rows), strict=True)], dtype="float64")


def f_p_value(f: Column, between: Column, within: Column) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _over(pd.DataFrame({"a": a, "b": b, "c": c}), f_tail)

    return p(f.cast("double"), between.cast("double"), within.cast("double"))


def r_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n pairs."""

    def one(r: float, n: float) -> float | None:
        return None if n < 3 else 0.0 if abs(r) >= 1 else t_tails(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return _over(pd.DataFrame({"a": a, "b": b}), one)

    return p(r.cast("double"), n.cast("double"))


# Wichura's rational approximations of the normal quantile (1988), lowest powers first: near the middle, in the
# tails, and far out.
_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile as arithmetic on columns, so that it may run over all rows; null outside of 0 to 1."""

    def ratio(x: Column, both: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
        ends = []
        for powers in both:
            value = F.lit(powers[-1])
            for c in reversed(powers[:-1]):
                value = value * x + F.lit(c)
            ends.append(value)
        return ends[0] / ends[1]

    p = p.cast("double")
    from_middle = p - 0.5
    depth = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(depth <= 5, ratio(depth - 1.6, _TAIL)).otherwise(ratio(depth - 5, _FAR))
    value = F.when(F.abs(from_middle) <= 0.425, from_middle * ratio(0.180625 - from_middle * from_middle, _MIDDLE)).otherwise(F.signum(from_middle) * tail)
    return F.when((p > 0) & (p < 1), value)
