"""Every row of one table with every row of another, in blocks: for operators that are defined over all pairs.

Rows are dealt into blocks of bounded size; each block of the left meets each block of the right in a group of its own, as
arrays. What a group returns is aggregated by the caller, so no pair of rows becomes a row unless it's wanted."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessella.sources.scratch import written

SIZE = 4096


def meet(left: DataFrame, right: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, size: int = SIZE) -> DataFrame:
    """f over all pairs of blocks; both tables' own columns reach it unchanged."""

    left, right = written(left, "blocks"), written(right, "blocks")
    n, m = (max(1, -(-df.count() // size)) for df in (left, right))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    home = lambda k: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(k)).cast("int")
    a = left.withColumn("_l", home(n)).withColumn("_r", every(m))
    b = right.withColumn("_r", home(m)).withColumn("_l", every(n))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return f(x, y)[names] if len(x) and len(y) else pd.DataFrame({c: [] for c in names})

    return a.groupBy("_l", "_r").cogroup(b.groupBy("_l", "_r")).applyInPandas(run, schema)
