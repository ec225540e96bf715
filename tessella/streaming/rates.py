"""Detection rates as records arrive: the batch operator's grouping over event-time windows, with late data bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def windowed_rate(records: DataFrame, time: str, by: list[str], flag: Column, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, by..., n and rate_pct; records later than `late` are dropped, windows are final after that."""
    records = records.withColumn(time, F.col(time).cast("timestamp"))
    seen = records.withWatermark(time, late) if records.isStreaming else records
    groups = seen.groupBy(F.window(time, window).alias("_w"), *by)
    return groups.agg(F.count("*").alias("n"), (F.avg(flag.cast("double")) * 100).alias("rate_pct")).select(F.col("_w.start").alias("start"), *by, "n", "rate_pct")
