"""Scans and sinks: Parquet tables, CSV with a schema, image files, tiles from vectors; CSV and text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions.safe import clean_numbers


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; the schema is given, so that the file is read once. NaN counts as missing."""
    return clean_numbers(spark.read.csv(path, header=True, schema=schema, nanValue="NaN"))


def tiles(vectors: DataFrame, side: int = 8, image_id: str = "vec_id", values: str = "embedding") -> DataFrame:
    """image_id, h, w, v (row-major doubles): each vector as a square grey image."""
    return vectors.select(F.col(image_id).cast("long").alias("image_id"), F.lit(side).alias("h"), F.lit(side).alias("w"), F.col(values).cast("array<double>").alias("v"))


def pixels(images: DataFrame) -> DataFrame:
    """image_id, y, x, v: one row per pixel."""
    return images.select("image_id", "w", F.posexplode("v").alias("p", "v")).select("image_id", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), "v")


def image_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Image files below path as condition, modality, image_id and the decoded image.

    Files are named <modality>_<number>.<kind> inside folders condition_<letter>."""
    read = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).option("pathGlobFilter", pattern).load(path)
    name = F.col("image.origin")
    return read.select(
        F.regexp_extract(name, r"/(condition_\w+)/[^/]*$", 1).alias("condition"),
        F.lower(F.regexp_extract(name, r"/([A-Za-z]+)_\d+\.\w+$", 1)).alias("modality"),
        F.regexp_extract(name, r"_(\d+)\.\w+$", 1).cast("long").alias("image_id"),
        "image",
    )


def csv_or(spark: SparkSession, path: str, otherwise: str, schema: str) -> DataFrame:
    """csv() of path, or of the other path if nothing is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return csv(spark, path if there else otherwise, schema)


def element_files(spark: SparkSession, path: str, conditions: DataFrame, elements: DataFrame, replicates: int = 5) -> DataFrame:
    """condition, replicate, element, image: the signal maps <path>/<condition>/<replicate>/<element>.png of the whole
    design; image is null where a map is missing. conditions, elements: dimension tables of that one column."""
    read = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).option("pathGlobFilter", "*.png").load(path)
    part = lambda i: F.regexp_extract("image.origin", r"([^/]+)/(\d+)/([^/]+)\.png$", i)
    maps = read.select(part(1).alias("condition"), part(2).cast("int").alias("replicate"), part(3).alias("element"), "image").filter("condition <> ''")
    design = conditions.select("condition").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).crossJoin(elements.select("element"))
    return design.join(maps, ["condition", "replicate", "element"], "left")


def image_pairs(images: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs of both modalities of an image; halves without the other are left out."""
    side = lambda m: images.filter(F.col("modality") == m).select("condition", "image_id", F.col("image").alias(m))
    return side(first).join(side(second), ["condition", "image_id"])


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for results of a few rows."""
    df.coalesce(1).write.csv(path, header=True, mode="overwrite")


def write_report(lines: DataFrame, path: str, order: str = "n", text: str = "line") -> None:
    """The lines as one text file, in order."""
    lines.coalesce(1).sortWithinPartitions(order).select(text).write.text(path)
