"""The dimension tables of the droplet experiment: conditions, compositions, ions, elements; each a few fixed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators import groups, relations

# Factor levels, concentrations in mM, and half the sum of squared charges per unit of each salt.
TEMPERATURES = [(20, 23), (23, 26), (26, 29)]
HUMIDITIES = [(35, 40), (40, 45), (45, 50)]
SALTS = ["NaHCO3", "CaCl2", "MgCl2", "Na2SO4", "NaH2PO4", "KF", "Fe(NO3)3", "CuSO4"]
COMPOSITION = {
    "A": [0.1, 1.5, 0.5, 0.35, 0.033, 0.4, 0.005, 0.00024],
    "B": [0.2, 1.0, 0.35, 0.35, 0.033, 0.4, 0.005, 0.00024],
    "C": [0.1, 0.5, 0.2, 0.35, 0.033, 0.4, 0.005, 0.00024],
    "D": [0.0, 1.0, 1.0, 1.35, 0.033, 0.4, 0.005, 0.00024],
    "E": [0.0, 1.0, 0.5, 2.35, 0.033, 0.4, 0.005, 0.00024],
}
ION_FACTORS = [1.0, 3.0, 3.0, 3.0, 1.0, 1.0, 6.0, 4.0]
ELEMENTS = ["C", "Ca", "Cl", "Mg", "Na", "O", "S"]
REPLICATES = 5


def conditions(spark: SparkSession) -> DataFrame:
    rows = [
        ("condition_" + "ABCDEFGHI"[3 * t + h], "ABCDEFGHI"[3 * t + h], *TEMPERATURES[t], *HUMIDITIES[h], t, h)
        for t in range(len(TEMPERATURES)) for h in range(len(HUMIDITIES))
    ]
    return spark.createDataFrame(rows, "condition string, letter string, temp_min int, temp_max int, hum_min int, hum_max int, temp_level int, hum_level int")


def composition(spark: SparkSession) -> DataFrame:
    """sample, component, concentration in long form."""
    return spark.createDataFrame([(s, c, x) for s, row in COMPOSITION.items() for c, x in zip(SALTS, row, strict=True)], "sample string, component string, concentration double")


def ion_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(SALTS, ION_FACTORS, strict=True)), "component string, factor double")


def ionic_strength(spark: SparkSession) -> DataFrame:
    """sample, weighted (the ionic strength) and total concentration."""
    return groups.weighted_sum(composition(spark), ion_factors(spark), "sample", "component", "concentration", "factor")


def design(spark: SparkSession) -> DataFrame:
    """225 rows: every condition, sample and replicate, with interval means and the image number in its condition."""
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(COMPOSITION)], "water_sample string, sample_number int")
    replicates = spark.range(1, REPLICATES + 1).select(F.col("id").cast("int").alias("replicate"))
    every = groups.factorial_design(conditions(spark), samples, replicates)
    return every.withColumns(
        {
            "temp_mean": (F.col("temp_min") + F.col("temp_max")) / 2,
            "humidity_mean": (F.col("hum_min") + F.col("hum_max")) / 2,
            "image_id": F.col("sample_number") * REPLICATES + F.col("replicate"),
        }
    ).drop("sample_number")


def transitions(spark: SparkSession) -> DataFrame:
    """Directed edges between conditions one level apart."""
    return relations.adjacent(conditions(spark), "condition", "temp_level", "hum_level")
