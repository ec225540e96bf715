"""Queries of the image operators; a vector of 64 components stands for an 8 x 8 grey tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators import groups, images, kernels, regions
from tessella.sources.tables import pixels, table, tiles

from .registry import Registry
from .statistics import rounded

registry = Registry()
query = registry.add

_PX = "SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS i)"
_BOX = f"SELECT image_id, min(v) AS lo, max(v) AS hi FROM ({_PX}) GROUP BY image_id"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles(table(spark, d, "embeddings"))


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every even tile beside the next, odd one, as two modalities of one image."""
    every = _tiles(spark, d)
    of = lambda odd: every.filter(F.col("image_id") % 2 == odd).withColumn("image_id", F.floor(F.col("image_id") / 2))
    return of(0), of(1)


@query(f"SELECT image_id, y, x, round(v, 6) AS v FROM ({_PX})")
def tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pixels(_tiles(spark, d)))


@query(f"""
WITH p AS ({_PX}), b AS ({_BOX}), h AS (SELECT image_id, least(floor((v - lo) / (hi - lo) * 256), 255) AS b, count(*) AS n FROM p JOIN b USING (image_id) GROUP BY ALL),
e AS (SELECT image_id, -sum(n / 64.0 * ln(n / 64.0)) AS entropy FROM h GROUP BY 1)
SELECT image_id, round(avg(v), 6) AS brightness, round(stddev_pop(v), 6) AS contrast, round(min(entropy), 6) AS entropy FROM p JOIN e USING (image_id) GROUP BY image_id
""")
def tile_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.basic_stats(_tiles(spark, d)))


@query(f"""
WITH p AS ({_PX}), s AS (SELECT image_id, avg(v) AS m, stddev_pop(v) AS s FROM p GROUP BY 1)
SELECT a.image_id // 2 AS image_id, round(CASE WHEN b.m > 0 THEN a.m / b.m ELSE 0 END, 4) AS brightness_ratio, round(CASE WHEN b.s > 0 THEN a.s / b.s ELSE 0 END, 4) AS contrast_ratio
FROM s a JOIN s b ON a.image_id % 2 = 0 AND b.image_id = a.image_id + 1
""")
def modality_ratios(spark: SparkSession, d: str) -> DataFrame:
    a, b = _pair(spark, d)
    return rounded(images.modality_ratios(images.basic_stats(a), images.basic_stats(b)), 4)


@query("""
SELECT vec_id AS image_id, i, round(0.2125 * r + 0.7154 * g + 0.0721 * b, 6) AS luminance, round((r + g + b) / 3, 6) AS channel_mean, round(0.114 * b + 0.587 * g + 0.299 * r, 6) AS video
FROM (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS r, embedding[i + 17]::DOUBLE AS g, embedding[i + 33]::DOUBLE AS b FROM embeddings CROSS JOIN (SELECT unnest(range(0, 16)) AS i))
""")
def grey_conversions(spark: SparkSession, d: str) -> DataFrame:
    """The first 48 components of a vector as the channels of a 4 x 4 colour tile."""
    v = _tiles(spark, d).select("image_id", F.lit(4).alias("h"), F.lit(4).alias("w"), *(F.slice("v", 16 * i + 1, 16).alias(c) for i, c in enumerate("rgb")))
    made = {"luminance": images.luminance, "channel_mean": images.channel_mean, "video": lambda r, g, b: images.video_grey(b, g, r)}
    out = None
    for name, how in made.items():
        one = images.grey(v, how).select("image_id", F.posexplode("v").alias("i", name))
        out = one if out is None else out.join(one, ["image_id", "i"])
    return rounded(out)


def _channel(n: int) -> str:
    return f"embedding[{16 * n + 1}:{16 * n + 16}]::DOUBLE[]"


_CHANNELS = {"red": _channel(0), "green": _channel(1), "blue": _channel(2)}
_CHANNEL_SQL = ", ".join(f"round(list_avg({v}), 6) AS {c}_mean, round(list_stddev_pop({v}), 6) AS {c}_std" for c, v in _CHANNELS.items())


@query(f"""
SELECT image_id, grey_mean, grey_std, {", ".join(f"{c}_{m}" for c in _CHANNELS for m in ("mean", "std"))} FROM (SELECT vec_id AS image_id, {_CHANNEL_SQL},
  round(list_avg(list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE + embedding[i + 16] + embedding[i + 32]) / 3)), 6) AS grey_mean,
  round(list_stddev_pop(list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE + embedding[i + 16] + embedding[i + 32]) / 3)), 6) AS grey_std FROM embeddings)
""")
def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    v = _tiles(spark, d).select("image_id", F.lit(4).alias("h"), F.lit(4).alias("w"), *(F.slice("v", 16 * i + 1, 16).alias(c) for i, c in enumerate("rgb")))
    return rounded(images.channel_stats(v))


def _light(n: int) -> str:
    return f"list_transform({_channel(n)}, lambda x: least(greatest(x * 40 + 128, 0), 255))"


@query(f"""
WITH c AS (SELECT vec_id AS image_id, {_light(0)} AS r, {_light(1)} AS g, {_light(2)} AS b FROM embeddings),
m AS (SELECT *, (list_avg(r) + list_avg(g) + list_avg(b)) / 3 AS grey FROM c)
SELECT image_id, {", ".join(f"round(list_avg(list_transform({c}, lambda x: power(least(x * grey / list_avg({c}), 255) / 255, 1 / 1.2) * 255)), 4) AS {c}" for c in "rgb")} FROM m
""")
def preprocessed(spark: SparkSession, d: str) -> DataFrame:
    """Mean channels after grey-world white balance and gamma."""
    lit = lambda i: F.transform(F.slice("v", 16 * i + 1, 16), lambda x: F.least(F.greatest(x * 40 + 128, F.lit(0.0)), F.lit(255.0)))
    v = _tiles(spark, d).select("image_id", F.lit(4).alias("h"), F.lit(4).alias("w"), *(lit(i).alias(c) for i, c in enumerate("rgb")))
    made = images.gamma_corrected(images.white_balanced(v))
    return rounded(made.select("image_id", *((F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)).alias(c) for c in "rgb")), 4)


_GREY = f"SELECT image_id, y, x, least(greatest(v * 40 + 128, 0), 255) AS v FROM ({_PX})"


def _grey(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).withColumn("v", F.transform("v", lambda x: F.least(F.greatest(x * 40 + 128, F.lit(0.0)), F.lit(255.0))))


@query(f"""
WITH p AS (SELECT image_id, y, x, floor(v) AS q, y // 4 AS ty, x // 4 AS tx FROM ({_GREY})),
h AS (SELECT image_id, ty, tx, q, count(*) AS n FROM p GROUP BY ALL), e AS (SELECT image_id, ty, tx, sum(greatest(n - 0.5, 0)) AS over FROM h GROUP BY ALL),
m AS (SELECT p.image_id, p.y, p.x, p.q, (p.y + 0.5) / 4 - 0.5 AS fy, (p.x + 0.5) / 4 - 0.5 AS fx FROM p),
t AS (SELECT m.*, greatest(0, least(1, floor(fy) + a)) AS ty, greatest(0, least(1, floor(fx) + b)) AS tx, CASE WHEN a = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END * CASE WHEN b = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END AS w
  FROM m CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b)),
c AS (SELECT t.image_id, t.y, t.x, t.w, (t.q + 1) * e.over / 256 AS spread, (SELECT coalesce(sum(least(h.n, 0.5)), 0) FROM h WHERE h.image_id = t.image_id AND h.ty = t.ty AND h.tx = t.tx AND h.q <= t.q) AS own
  FROM t JOIN e ON e.image_id = t.image_id AND e.ty = t.ty AND e.tx = t.tx)
SELECT image_id, (8 * y + x)::BIGINT AS i, round(sum(w * (own + spread) / 16 * 255), 4) AS v FROM c GROUP BY image_id, y, x
""")
def equalised_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Contrast-limited equalisation in 2 x 2 parts; a part's histogram is cut off at 8 times its mean, half a pixel."""
    return rounded(images.equalised(_grey(spark, d), tiles=2, clip=8.0).select("image_id", F.posexplode("v").alias("i", "v")), 4)


@query(f"""
WITH p AS ({_GREY}), w AS (SELECT a.image_id, a.y, a.x, b.v, exp(-(power(a.y - b.y, 2) + power(a.x - b.x, 2)) / 8) * exp(-power(a.v - b.v, 2) / 1250) AS w FROM p a JOIN p b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2)
SELECT image_id, (8 * y + x)::BIGINT AS i, round(sum(w * v) / sum(w), 4) AS v FROM w GROUP BY image_id, y, x
""")
def bilateral_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.bilateral(_grey(spark, d)).select("image_id", F.posexplode("v").alias("i", "v")), 4)


@query(f"SELECT image_id, (8 * y + x)::BIGINT AS i, floor((v - lo) * 255 / (hi - lo))::BIGINT AS q FROM ({_PX}) p JOIN ({_BOX}) b USING (image_id)")
def tile_quantise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.quantised(_tiles(spark, d)).select("image_id", F.posexplode("q").alias("i", "q")))


_OFFSETS = ", ".join(f"({d}, {a}, {y}, {x})" for (d, a), (y, x) in images.OFFSETS.items())
_GLCM = f"""
WITH q AS (SELECT image_id, y, x, floor((v - lo) * 255 / (hi - lo)) AS q FROM ({_PX}) p JOIN ({_BOX}) b USING (image_id)), o(d, a, dy, dx) AS (VALUES {_OFFSETS}),
p AS (SELECT l.image_id, d, a, l.q AS i, r.q AS j FROM q l CROSS JOIN o JOIN q r ON r.image_id = l.image_id AND r.y = l.y + dy AND r.x = l.x + dx),
s AS (SELECT * FROM p UNION ALL SELECT image_id, d, a, j, i FROM p), c AS (SELECT image_id, d, a, i, j, count(*) AS c FROM s GROUP BY ALL)
SELECT image_id, d::BIGINT AS d, a::BIGINT AS a, sum(c * power(i - j, 2)) / sum(c) AS contrast, sum(c * abs(i - j)) / sum(c) AS dissimilarity, sum(c / (1 + power(i - j, 2))) / sum(c) AS homogeneity, sqrt(sum(c * c)) / sum(c) AS energy FROM c GROUP BY image_id, d, a
"""
_GLCM_ROUND = ", ".join(f"round({t}, 6) AS {t}" for t in images.TEXTURES)


@query(f"SELECT image_id, d, a, {_GLCM_ROUND} FROM ({_GLCM})")
def glcm_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.texture(_tiles(spark, d)))


def _spectrum_sql(limit: int) -> str:
    return f"""
WITH p AS (SELECT * FROM ({_PX}) WHERE image_id < {limit}), f AS (SELECT f // 8 AS u, f % 8 AS k FROM (SELECT unnest(range(0, 64)) AS f)),
s AS (SELECT image_id, u, k, sum(v * cos(2 * pi() * (u * y / 8.0 + k * x / 8.0))) AS re, sum(v * sin(2 * pi() * (u * y / 8.0 + k * x / 8.0))) AS im FROM p CROSS JOIN f GROUP BY ALL),
w AS (SELECT image_id, re * re + im * im AS power, sqrt(power((u + 4) % 8 - 4, 2) + power((k + 4) % 8 - 4, 2)) AS r FROM s)
SELECT image_id, avg(sqrt(power)) FILTER (r < 4 / 3.0) AS low_freq_magnitude, avg(sqrt(power)) FILTER (r >= 4 / 3.0 AND r < 8 / 3.0) AS mid_freq_magnitude, avg(sqrt(power)) FILTER (r >= 8 / 3.0) AS high_freq_magnitude,
  sum(power) FILTER (r < 4 / 3.0) / sum(power) AS low_freq_energy_ratio, sum(power) FILTER (r >= 4 / 3.0 AND r < 8 / 3.0) / sum(power) AS mid_freq_energy_ratio, sum(power) FILTER (r >= 8 / 3.0) / sum(power) AS high_freq_energy_ratio,
  sum(power) AS total_spectral_energy FROM w GROUP BY image_id
"""


_BAND_ROUND = ", ".join(f"round({c}, 5) AS {c}" for c in [f"{b}_freq_{m}" for m in ("magnitude", "energy_ratio") for b in ("low", "mid", "high")] + ["total_spectral_energy"])


@query(f"SELECT image_id, {_BAND_ROUND} FROM ({_spectrum_sql(1 << 40)})")
def tile_dft_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.bands(images.spectrum(_tiles(spark, d))), 5)


_BITS = f"""
WITH p AS (SELECT image_id, y, x, least(floor((v - lo) / (hi - lo) * 256), 255) AS b FROM ({_PX}) JOIN ({_BOX}) USING (image_id)),
h AS (SELECT image_id, b, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT image_id, b, sum(n) OVER u AS n0, sum(n * b) OVER u AS s0, sum(n) OVER w AS n1, sum(n * b) OVER w AS s1 FROM h WINDOW u AS (PARTITION BY image_id ORDER BY b), w AS (PARTITION BY image_id)),
t AS (SELECT image_id, arg_max(b, (round(n0 * (n1 - n0) * power(s0 / n0 - (s1 - s0) / (n1 - n0), 2), 6), -b)) AS t FROM s WHERE n1 > n0 GROUP BY 1)
SELECT image_id, y, x, (b > t)::INT AS bit FROM p JOIN t USING (image_id)
"""


@query(f"SELECT image_id, sum(bit)::BIGINT AS n_foreground FROM ({_BITS}) GROUP BY image_id")
def otsu_foreground(spark: SparkSession, d: str) -> DataFrame:
    bits = images.foreground(_tiles(spark, d))
    return bits.select("image_id", F.aggregate("bits", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_foreground"))


_DISK = ", ".join(f"({y}, {x})" for y, x in images.DISK)
_MORPH = f"""
WITH b AS ({_BITS}), k(dy, dx) AS (VALUES {_DISK}),
n AS (SELECT b.image_id, b.y, b.x, min(o.bit) AS e, max(o.bit) AS d, min(b.bit) AS o FROM b CROSS JOIN k JOIN b o ON o.image_id = b.image_id AND o.y = b.y + dy AND o.x = b.x + dx GROUP BY ALL)
SELECT image_id, round(avg(o), 6) AS object_area_ratio, round(avg(e), 6) AS erosion_area_ratio, round(avg(d), 6) AS dilation_area_ratio FROM n GROUP BY image_id
"""


@query(_MORPH)
def erode_dilate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.morphology(images.foreground(_tiles(spark, d))))


@query(f"""
WITH RECURSIVE b AS (SELECT image_id, (8 * y + x)::INT AS p, y, x FROM ({_BITS}) WHERE bit = 1),
r AS (SELECT image_id, p AS root, p, y, x FROM b UNION SELECT r.image_id, r.root, b.p, b.y, b.x FROM r JOIN b ON b.image_id = r.image_id AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1),
c AS (SELECT image_id, p, min(root) AS c FROM r GROUP BY ALL), s AS (SELECT image_id, c, count(*) AS n FROM c GROUP BY ALL)
SELECT image_id, count(*) AS num_objects, round(avg(n), 6) AS mean_object_area, max(n)::DOUBLE AS largest_object_area FROM s GROUP BY image_id
""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regions.objects(images.foreground(_tiles(spark, d))))


@query(f"""
WITH p AS (SELECT image_id, y, x, (v - lo) / (hi - lo + 1e-8) AS v FROM ({_PX}) JOIN ({_BOX}) USING (image_id)),
m AS (SELECT a.image_id // 2 AS image_id, a.y, a.x, a.v AS s, b.v AS t FROM p a JOIN p b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x AND a.image_id % 2 = 0),
g AS (SELECT unnest(range(3, 5)) AS gy), w AS (SELECT image_id, gy, gx, avg(s) AS ms, avg(t) AS mt, var_samp(s) AS vs, var_samp(t) AS vt, covar_samp(s, t) AS c
  FROM m JOIN g ON abs(y - gy) <= 3 JOIN (SELECT unnest(range(3, 5)) AS gx) ON abs(x - gx) <= 3 GROUP BY ALL)
SELECT image_id, round(avg((2 * ms * mt + 0.0001) * (2 * c + 0.0009) / ((ms * ms + mt * mt + 0.0001) * (vs + vt + 0.0009))), 6) AS ssim FROM w GROUP BY image_id
""")
def ssim_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.similarity(*_pair(spark, d)))


@query(f"""
SELECT image_id, round(avg((v > 0.1)::INT), 6) AS coverage, round(CASE WHEN count(*) FILTER (v > 0.1) > 10 THEN avg(v) FILTER (v > 0.1) ELSE 0 END, 6) AS mean_signal FROM ({_PX}) GROUP BY image_id
""")
def coverage_signal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.coverage(_tiles(spark, d), 0.1, 10))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return images.features(*_pair(spark, d))


@query()
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d)


@query(f"""
WITH g AS ({_GLCM}) SELECT label::BIGINT AS label, count(*) AS n, round(avg(contrast), 4) AS contrast_mean, round(avg(homogeneity), 4) AS homogeneity_mean FROM g JOIN embeddings ON vec_id = image_id WHERE d = 1 AND a = 0 GROUP BY label
""")
def features_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: tiles -> texture -> joined to their label -> group means."""
    vectors = table(spark, d, "embeddings")
    texture = images.texture(tiles(vectors), {(1, 0): images.OFFSETS[(1, 0)]})
    met = texture.join(vectors.select(F.col("vec_id").alias("image_id"), "label"), "image_id")
    means = groups.summary(met, ["label"], ["contrast", "homogeneity"])
    return rounded(means.select("label", "n", "contrast_mean", "homogeneity_mean"), 4)


@query()
def kernel_features(spark: SparkSession, d: str) -> DataFrame:
    return kernels.image_features(_tiles(spark, d))
