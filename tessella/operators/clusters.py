"""Principal components, k-means, hierarchical clustering of features, and nearest-neighbour surfaces."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.sources.scratch import written


def _vectors(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, _f: the columns standardised by their population deviations; rows with a missing value are left out."""
    raw = df.select(key, F.array(*(F.col(c).cast("double") for c in columns)).alias("_a")).filter(F.forall("_a", lambda x: x.isNotNull() & ~F.isnan(x)))
    x = written(raw.select(key, array_to_vector("_a").alias("_r")), "cluster-vectors")
    n = x.count()
    scaler = StandardScaler(inputCol="_r", outputCol="_z", withMean=True, withStd=True).fit(x)
    by = [((n / (n - 1)) ** 0.5 if n > 1 else 1.0)] * len(columns)
    return ElementwiseProduct(scalingVec=Vectors.dense(by), inputCol="_z", outputCol="_f").transform(scaler.transform(x)).select(key, "_f")


def principal_components(df: DataFrame, key: str, columns: list[str], k: int = 2) -> DataFrame:
    """component, feature, loading (absolute), explained: of the standardised columns. Signs are arbitrary, hence none."""
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(_vectors(df, key, columns))
    rows = [(i, c, float(abs(model.pc[j, i])), float(model.explainedVariance[i])) for i in range(k) for j, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "component int, feature string, loading double, explained double")


def component_scores(df: DataFrame, key: str, columns: list[str], k: int = 2) -> DataFrame:
    x = _vectors(df, key, columns)
    scored = PCA(k=k, inputCol="_f", outputCol="_p").fit(x).transform(x).withColumn("_p", vector_to_array("_p"))
    return scored.select(key, *(F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)))


def kmeans(df: DataFrame, key: str, columns: list[str], k: int = 3, seed: int = 42, starts: int = 10) -> DataFrame:
    """key, cluster: the best of several starts by the within-cluster sum of squares."""
    x = written(_vectors(df, key, columns), "kmeans-vectors")
    models = [KMeans(k=k, seed=seed + s, featuresCol="_f", predictionCol="cluster").fit(x) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(x).select(key, "cluster")


def linkage(rows: np.ndarray, how: str) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) of rows by Euclidean distance, "complete" or "ward"; new clusters count on from n."""
    n = len(rows)
    gaps = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    live, size, dist = set(range(n)), dict.fromkeys(range(n), 1), {(i, j): gaps[i, j] for i in range(n) for j in range(i + 1, n)}
    merges = []
    for new in range(n, 2 * n - 1):
        (a, b), d = min(((p, dist[p]) for p in dist if p[0] in live and p[1] in live), key=lambda x: (x[1], x[0]))
        live -= {a, b}
        for c in live:
            ac, bc = dist[tuple(sorted((a, c)))], dist[tuple(sorted((b, c)))]
            if how == "complete":
                dist[(c, new)] = max(ac, bc)
            else:
                na, nb, nc = size[a], size[b], size[c]
                dist[(c, new)] = float(np.sqrt(((na + nc) * ac**2 + (nb + nc) * bc**2 - nc * d**2) / (na + nb + nc)))
        live.add(new)
        size[new] = size[a] + size[b]
        merges.append((a, b, float(d), size[new]))
    return merges


def leaves(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    def walk(i: int) -> list[int]:
        return [i] if i < n else walk(merges[i - n][0]) + walk(merges[i - n][1])

    return walk(n + len(merges) - 1) if merges else list(range(n))


def feature_tree(correlations: DataFrame, how: str = "complete", most: int = 200) -> DataFrame:
    """step, left_node, right_node, distance, size of a correlation matrix's rows (for ward, of 1 - r).

    The matrix is the one thing collected: at most `most` features, or it is an error."""
    cells = correlations.limit(most * most + 1).collect()
    names = sorted({c.a for c in cells})
    if len(names) > most:
        raise ValueError(f"more than {most} features")
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for c in cells:
        m[at[c.a], at[c.b]] = np.nan_to_num(np.nan if c.r is None else c.r)
    rows = [(s, *x) for s, x in enumerate(linkage(m if how == "complete" else 1 - m, how))]
    return _frame(correlations.sparkSession, rows, "step int, left_node int, right_node int, distance double, size int")


def in_leaf_order(correlations: DataFrame, how: str = "complete", most: int = 200) -> DataFrame:
    """The cells of a correlation matrix with the places of their row and column in the tree's order: row_place, col_place."""
    names = sorted(r.a for r in correlations.select("a").distinct().limit(most + 1).collect())
    merges = [(r.left_node, r.right_node, r.distance, r.size) for r in feature_tree(correlations, how, most).orderBy("step").collect()]
    order = _frame(correlations.sparkSession, [(names[leaf], place) for place, leaf in enumerate(leaves(merges, len(names)))], "name string, place int")
    side = lambda c: order.select(F.col("name").alias(c), F.col("place").alias({"a": "row_place", "b": "col_place"}[c]))
    return correlations.join(side("a"), "a").join(side("b"), "b")


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def nearest_surface(points: DataFrame, x: str, y: str, value: str, side: int) -> DataFrame:
    """gy, gx, value of the nearest of the points on a grid over their range; ties go to the smaller value.

    Points are first averaged by place; every place meets the grid, which is the side that is broadcast."""
    places = points.na.drop(subset=[x, y, value]).groupBy(F.col(x).alias("px"), F.col(y).alias("py")).agg(F.avg(value).alias("v"))
    box = places.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    step = lambda n: F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias(n)
    grid = box.select("*", step("gx")).select("*", step("gy"))
    at = grid.select("gx", "gy", (F.col("x0") + F.col("gx") * (F.col("x1") - F.col("x0")) / (side - 1)).alias("ax"), (F.col("y0") + F.col("gy") * (F.col("y1") - F.col("y0")) / (side - 1)).alias("ay"))
    far = F.round((F.col("ax") - F.col("px")) ** 2 + (F.col("ay") - F.col("py")) ** 2, 9)
    return places.join(F.broadcast(at)).groupBy("gy", "gx").agg(F.min(F.struct(far.alias("d"), F.col("v"))).alias("m")).select("gy", "gx", F.col("m.v").alias("value"))
