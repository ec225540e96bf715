"""The whole analysis in one call: every query, and sinks for their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.sources.tables import write_csv, write_report

from . import imaging, statistics


def all_queries() -> dict:
    return statistics.registry.queries | imaging.registry.queries


def all_sql() -> dict[str, str]:
    return statistics.registry.sql | imaging.registry.sql


def run_all(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The named queries' results, or all, in the order given. The first that fails ends the run, and the error names it;
    what a step lacks is an empty result, not an error."""
    known, results = all_queries(), {}
    for step, n in enumerate(names or known, 1):
        try:
            results[n] = known[n](spark, folder)
        except Exception as e:
            raise RuntimeError(f"step {step}, {n}, failed; {len(results)} were done") from e
    return results


def save(results: dict[str, DataFrame], folder: str) -> None:
    """Each result as CSV, and a report of their sizes."""
    counts = []
    for i, (name, df) in enumerate(sorted(results.items())):
        write_csv(df, f"{folder}/{name}.csv")
        counts.append((i, f"{name}: {df.count()} rows"))
    spark = next(iter(results.values())).sparkSession
    write_report(spark.createDataFrame(counts, "n int, line string"), f"{folder}/report", "n", "line")


def events_as_detections(events: DataFrame, above: float = 10.0) -> DataFrame:
    """Events as detection records: condition, element, coverage, detected."""
    return events.select((F.col("user_id") % 9).alias("condition"), F.col("event_type").alias("element"), F.col("value").alias("coverage"), (F.col("value") > above).alias("detected"))
