"""Image operators on the relation image_id, h, w, v (row-major doubles): one row per image, no joins between pixels.

A pixel's neighbours are slices of its own image's array or bits of its packed rows, or numpy works on the array inside its
task (spectra), so nothing is shuffled but one partial sum per image. `kernels` gives the same numbers as one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions.safe import safe_ratio

# Offsets (rows, columns) of the co-occurrence distances and angles; the disk of radius 3; SSIM's constants.
OFFSETS = {(d, a): (round(math.sin(math.radians(a)) * d), round(math.cos(math.radians(a)) * d)) for d in (1, 2) for a in (0, 45, 90, 135)}
DISK = [(y, x) for y in range(-3, 4) for x in range(-3, 4) if x * x + y * y <= 9]
LUMA_RGB, LUMA_BGR = (0.2125, 0.7154, 0.0721), (0.114, 0.587, 0.299)
SSIM_RADIUS, SSIM_C1, SSIM_C2 = 3, 0.01**2, 0.03**2
TEXTURES = ("contrast", "dissimilarity", "homogeneity", "energy")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Grey by perceived brightness (texture, morphology, similarity)."""
    return LUMA_RGB[0] * r + LUMA_RGB[1] * g + LUMA_RGB[2] * b


def channel_mean(r: Column, g: Column, b: Column) -> Column:
    """Grey as the plain mean of channels (spectra, basic statistics)."""
    return (r + g + b) / 3


def video_grey(b: Column, g: Column, r: Column) -> Column:
    """Grey of blue-green-red pixels (signal maps)."""
    return LUMA_BGR[0] * b + LUMA_BGR[1] * g + LUMA_BGR[2] * r


def grey(channels: DataFrame, how) -> DataFrame:
    """image_id, h, w, v from image_id, h, w, r, g, b arrays."""
    v = F.transform(F.arrays_zip("r", "g", "b"), lambda p: how(p["r"], p["g"], p["b"]))
    return channels.select("image_id", "h", "w", v.alias("v"))


def _spread(images: DataFrame) -> DataFrame:
    return images.withColumns({"lo": F.array_min("v"), "hi": F.array_max("v")})


def basic_stats(images: DataFrame) -> DataFrame:
    """Mean, population deviation, and entropy (nats) of the 256-bin histogram."""
    px = _spread(images).select("image_id", "lo", "hi", F.explode("v").alias("v"))
    px = px.withColumn("b", F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * 256), F.lit(255)), F.lit(0)))
    bins = px.groupBy("image_id", "b").agg(F.count("*").alias("n"))
    logs = bins.groupBy("image_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    return _moments(images, "v", "brightness", "contrast").join(logs, "image_id").select("image_id", "brightness", "contrast", (F.ln("n") - F.col("nln") / F.col("n")).alias("entropy"))


def _moments(images: DataFrame, v: str, mean: str, deviation: str) -> DataFrame:
    """Mean and population deviation of an array, in the row: deviations are summed, not squares."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    met = images.select("image_id", v).withColumn(mean, total(F.col(v)))
    return met.select("image_id", mean, F.sqrt(total(F.transform(v, lambda x: (x - F.col(mean)) * (x - F.col(mean))))).alias(deviation))


def channel_stats(channels: DataFrame) -> DataFrame:
    """Mean and population deviation of the three channels of each image, and of their mean: red_mean, red_std, ..."""
    out = _moments(grey(channels, channel_mean), "v", "grey_mean", "grey_std")
    for c, name in zip("rgb", ("red", "green", "blue"), strict=True):
        out = out.join(_moments(channels, c, f"{name}_mean", f"{name}_std"), "image_id")
    return out


def modality_ratios(stats_a: DataFrame, stats_b: DataFrame) -> DataFrame:
    """Brightness and contrast of the first modality over the second's, 0 where that is not positive."""
    b = stats_b.select("image_id", F.col("brightness").alias("_b"), F.col("contrast").alias("_c"))
    return stats_a.join(b, "image_id").select("image_id", safe_ratio(F.col("brightness"), F.col("_b")).alias("brightness_ratio"), safe_ratio(F.col("contrast"), F.col("_c")).alias("contrast_ratio"))


def quantised(images: DataFrame) -> DataFrame:
    """images with q: 256 levels between each image's least and greatest value, cut off; null for flat images."""
    level = F.when(F.col("hi") > F.col("lo"), F.transform("v", lambda x: F.floor((x - F.col("lo")) * 255 / (F.col("hi") - F.col("lo"))).cast("int")))
    return _spread(images).withColumn("q", level).drop("lo", "hi")


def texture(images: DataFrame, offsets: dict[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """image_id, d, a, contrast, dissimilarity, homogeneity, energy of the symmetric co-occurrences; flat images are left out."""
    shifts = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(a).alias("a"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for (d, a), (y, x) in (offsets or OFFSETS).items()))
    q = quantised(images).filter("q IS NOT NULL").select("image_id", "h", "w", "q", F.explode(shifts).alias("o")).select("image_id", "h", "w", "q", "o.*")
    # the overlap of the image with itself, shifted: its rows are slices of the array
    first, rows, width = F.greatest(-F.col("dy"), F.lit(0)), F.col("h") - F.abs("dy"), F.col("w") - F.abs("dx")
    q = q.filter((rows > 0) & (width > 0)).withColumn("y", F.sequence(first, first + rows - 1))
    cut = lambda down, right: F.flatten(F.transform("y", lambda y: F.slice("q", (y + down) * F.col("w") + F.greatest(right, F.lit(0)) + 1, width)))
    pairs = q.select("image_id", "d", "a", F.inline(F.arrays_zip(cut(F.lit(0), -F.col("dx")).alias("i"), cut(F.col("dy"), F.col("dx")).alias("j"))))
    key = ["image_id", "d", "a"]
    counts = pairs.groupBy(*key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.count("*").alias("c"))
    apart = (F.col("j") - F.col("i")).cast("double")
    n, c = F.sum("c"), F.col("c")
    squares = F.sum(F.when(F.col("i") == F.col("j"), 4 * c * c).otherwise(2 * c * c))  # each pair counts both ways
    return counts.groupBy(*key).agg(
        (F.sum(c * apart * apart) / n).alias("contrast"),
        (F.sum(c * apart) / n).alias("dissimilarity"),
        (F.sum(c / (1 + apart * apart)) / n).alias("homogeneity"),
        (F.sqrt(squares) / (2 * n)).alias("energy"),
    )


def spectrum(images: DataFrame) -> DataFrame:
    """image_id, h, w, u, k, power: squared magnitudes of the discrete Fourier transform."""

    def frame(images: list[tuple[int, int, int, np.ndarray]]) -> pd.DataFrame:
        ids, heights, widths, powers = zip(*images, strict=True)
        sizes = [h * w for h, w in zip(heights, widths, strict=True)]
        at = np.concatenate([np.arange(n) for n in sizes])
        h, w = (np.repeat(x, sizes) for x in (heights, widths))
        return pd.DataFrame({"image_id": np.repeat(ids, sizes), "h": h, "w": w, "u": at // w, "k": at % w, "power": np.concatenate(powers)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done, size = [], 0
            for i, h, w, v in zip(batch.image_id, batch.h, batch.w, batch.v, strict=True):
                power = np.abs(np.fft.fft2(np.asarray(v, dtype=float).reshape(h, w))) ** 2
                done.append((i, h, w, power.ravel()))
                size += h * w
                if size >= 1 << 18:
                    yield frame(done)
                    done, size = [], 0
            if done:
                yield frame(done)

    return images.select("image_id", "h", "w", "v").mapInPandas(run, "image_id long, h int, w int, u int, k int, power double")


def bands(power: DataFrame) -> DataFrame:
    """Mean magnitude and energy share of three radial bands around the shifted origin, and the total energy."""
    cy, cx = F.floor(F.col("h") / 2), F.floor(F.col("w") / 2)
    y, x = (F.col("u") + cy) % F.col("h") - cy, (F.col("k") + cx) % F.col("w") - cx
    r, most = F.sqrt(y * y + x * x), F.least(cy, cx)
    band = F.when(r < most / 3, "low").when(r < 2 * most / 3, "mid").otherwise("high")
    at = power.select("image_id", band.alias("band"), "power")
    of = lambda b, e: F.when(F.col("band") == b, e)
    names = ("low", "mid", "high")
    return at.groupBy("image_id").agg(
        *(F.avg(of(b, F.sqrt("power"))).alias(f"{b}_freq_magnitude") for b in names),
        *(F.try_divide(F.sum(of(b, F.col("power"))), F.sum("power")).alias(f"{b}_freq_energy_ratio") for b in names),
        F.sum("power").alias("total_spectral_energy"),
    )


def foreground(images: DataFrame) -> DataFrame:
    """images with bits: whether a pixel is above Otsu's threshold of a 256-bin histogram (the first maximum wins).

    Flat images have no foreground."""
    level = F.transform("v", lambda x: F.least(F.floor(F.coalesce(F.try_divide(x - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 256), F.lit(255)).cast("int"))
    leveled = _spread(images).withColumn("b", level)
    bins = leveled.select("image_id", F.explode("b").alias("b")).groupBy("image_id", "b").agg(F.count("*").alias("n"))
    upto, whole = Window.partitionBy("image_id").orderBy("b"), Window.partitionBy("image_id")
    sums = bins.select("image_id", "b", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("b")).over(upto).alias("s0"), F.sum("n").over(whole).alias("n1"), F.sum(F.col("n") * F.col("b")).over(whole).alias("s1"))
    rest = F.col("n1") - F.col("n0")
    gap = F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("s1") - F.col("s0"), rest)
    best = sums.filter(rest > 0).groupBy("image_id").agg(F.max(F.struct(F.round(F.col("n0") * rest * gap * gap, 6).alias("g"), (-F.col("b")).alias("b"))).alias("best"))
    met = leveled.join(best.select("image_id", (-F.col("best.b")).alias("t")), "image_id", "left")
    return met.withColumn("bits", F.transform("b", lambda x: F.coalesce((x > F.col("t")).cast("int"), F.lit(0)))).select(*images.columns, "bits")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def packed(bits: str | Column = "bits") -> Column:
    """Rows of 64-pixel words, pixel j of a word at bit j; the last word of a row may be part empty. Needs h, w."""
    words = F.ceil(F.col("w") / 64).cast("int")

    def word(i: Column) -> Column:
        y, k = F.floor(i / words), i % words
        some = F.slice(bits, (y * F.col("w") + k * 64 + 1).cast("int"), F.least(F.lit(64), F.col("w") - k * 64).cast("int"))
        return F.aggregate(F.reverse(some), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))

    return F.transform(F.sequence(F.lit(0), F.col("h") * words - 1), word)


def _wider(words: Column, n: Column, reach: int) -> Column:
    """Every pixel spread over `reach` pixels to both sides of its row; n: words of a row."""

    def spread(x: Column, i: Column) -> Column:
        before = F.when(i % n > 0, F.get(words, i - 1)).otherwise(F.lit(0).cast("long"))
        after = F.when(i % n < n - 1, F.get(words, i + 1)).otherwise(F.lit(0).cast("long"))
        out = x
        for s in range(1, reach + 1):
            out = out.bitwiseOR(F.shiftleft(x, s)).bitwiseOR(F.shiftrightunsigned(before, 64 - s)).bitwiseOR(F.shiftrightunsigned(x, s)).bitwiseOR(F.shiftleft(after, 64 - s))
        return out

    return F.transform(words, spread) if reach else words


def dilated(words: Column, n: Column) -> Column:
    """Packed rows under a disk of radius 3: rows that far apart are or-ed, each spread as wide as the disk is there."""
    reach = {dy: max(x for y, x in DISK if y == dy) for dy in range(-3, 4)}
    spread = F.struct(*(_wider(words, n, r).alias(f"r{r}") for r in sorted(set(reach.values()))))

    def rows(a: Column) -> Column:
        def cell(i: Column) -> Column:
            out = F.lit(0).cast("long")
            for dy, r in reach.items():
                at = i + dy * n
                out = out.bitwiseOR(F.coalesce(F.when(at >= 0, F.get(a[f"r{r}"], at.cast("int"))), F.lit(0).cast("long")))
            return out

        return F.transform(F.sequence(F.lit(0), F.size(words) - 1), cell)

    return _let(spread, rows)


def morphology(bits: DataFrame) -> DataFrame:
    """Shares of foreground, and of its erosion and dilation by a disk of radius 3; pixels outside don't count.

    Images are packed into 64-pixel words, so a row's shift is a shift of words. What erosion leaves is what the dilation of
    the background doesn't reach."""
    n = F.col("n")
    # the pixels that a row's last word has
    full = F.when((F.col("w") % 64) == 0, F.lit(-1).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - F.col("w") % 64).cast("int")))
    inside = lambda a: F.transform(a, lambda x, i: F.when(i % n == n - 1, x.bitwiseAND(F.col("full"))).otherwise(x))
    count = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))
    size = F.col("h") * F.col("w")
    met = bits.filter(size > 0).select("image_id", "h", "w", packed().alias("p"), F.ceil(F.col("w") / 64).cast("int").alias("n"), full.alias("full"))
    met = met.withColumn("rest", inside(F.transform("p", lambda x: F.bitwise_not(x))))
    return met.select(
        "image_id",
        (count(F.col("p")) / size).alias("object_area_ratio"),
        (1 - count(inside(dilated(F.col("rest"), n))) / size).alias("erosion_area_ratio"),
        (count(inside(dilated(F.col("p"), n))) / size).alias("dilation_area_ratio"),
    )


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, ssim of two images with one id, cropped to their common top left; 7 x 7 windows, sample covariances."""
    other = b.select("image_id", F.col("h").alias("h2"), F.col("w").alias("w2"), F.col("v").alias("v2"))
    met = a.join(other, "image_id").withColumns({"ch": F.least("h", "h2"), "cw": F.least("w", "w2")})

    def crop(v: str, width: str) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.col("ch") - 1), lambda y: F.slice(F.col(v), (y * F.col(width) + 1).cast("int"), F.col("cw"))))

    met = met.select("image_id", "ch", "cw", crop("v", "w").alias("v"), crop("v2", "w2").alias("v2"))

    def scaled(v: str) -> Column:
        return F.transform(v, lambda x: (x - F.array_min(v)) / (F.array_max(v) - F.array_min(v) + 1e-8))

    met = met.withColumns({"v": scaled("v"), "v2": scaled("v2")})
    side = 2 * SSIM_RADIUS + 1
    met = met.filter((F.col("ch") >= side) & (F.col("cw") >= side))

    def windows(values: Column) -> Column:
        """Sums over all windows: along rows, then of rows; a window's sums follow each other as its corners do."""
        width, across = F.col("cw"), F.col("cw") - side + 1
        every = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
        total = lambda a, at, step: sum((F.get(a, (at + step * k).cast("int")) for k in range(1, side)), F.get(a, at.cast("int")))
        rows = F.transform(every(F.col("ch") * across), lambda i: total(values, F.floor(i / across) * width + i % across, F.lit(1)))
        return _let(rows, lambda a: F.transform(every((F.col("ch") - side + 1) * across), lambda i: total(a, i, across)))

    product = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    sums = {"s": F.col("v"), "t": F.col("v2"), "ss": product("v", "v"), "tt": product("v2", "v2"), "st": product("v", "v2")}
    n = side * side
    met = met.select("image_id", F.arrays_zip(*(windows(a).alias(c) for c, a in sums.items())).alias("sums"))

    def likeness(x: Column) -> Column:
        ms, mt = x["s"] / n, x["t"] / n
        spread = lambda c, a, b: (x[c] - n * a * b) / (n - 1)
        top = (2 * ms * mt + SSIM_C1) * (2 * spread("st", ms, mt) + SSIM_C2)
        return top / ((ms * ms + mt * mt + SSIM_C1) * (spread("ss", ms, ms) + spread("tt", mt, mt) + SSIM_C2))

    return met.select("image_id", (F.aggregate("sums", F.lit(0.0), lambda a, x: a + likeness(x)) / F.size("sums")).alias("ssim"))


def coverage(images: DataFrame, above: float = 5.0, least: int = 50) -> DataFrame:
    """Share of pixels above a signal level, and their mean if there are more than `least`, else 0."""
    high = F.filter("v", lambda x: x > above)
    mean = F.aggregate("high", F.lit(0.0), lambda s, x: s + x) / F.size("high")
    return images.withColumn("high", high).select("image_id", (F.size("high") / F.size("v")).alias("coverage"), F.when(F.size("high") > least, mean).otherwise(0.0).alias("mean_signal"))


def texture_wide(textures: DataFrame) -> DataFrame:
    """One row per image: texture_<property>_d<distance>_a<angle>."""
    made = [F.max(F.when((F.col("d") == d) & (F.col("a") == a), F.col(t))).alias(f"texture_{t}_d{d}_a{a}") for t in TEXTURES for d, a in OFFSETS]
    return textures.groupBy("image_id").agg(*made)


def features(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("normal", "sem")) -> DataFrame:
    """The 91 features of each pair: texture 32, spectrum 7 and morphology 6 of either image, and their similarity."""
    from .regions import objects

    out = similarity(first, second).withColumnRenamed("ssim", "cross_modal_ssim")
    for images, name in zip((first, second), names, strict=True):
        bits = foreground(images)
        shape = morphology(bits).join(objects(bits), "image_id")
        parts = [(texture_wide(texture(images)), ""), (bands(spectrum(images)), "freq_"), (shape, "morph_")]
        for df, kind in parts:
            out = out.join(df.select("image_id", *(F.col(c).alias(f"{name}_{kind}{c}") for c in df.columns if c != "image_id")), "image_id", "left")
    return out


def white_balanced(channels: DataFrame) -> DataFrame:
    """image_id, h, w, r, g, b with each channel scaled to the mean of all three (grey world), cut off at 255; a channel
    without light stays."""
    mean = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x) / F.size(c)
    met = channels.withColumns({f"_{c}": mean(c) for c in "rgb"})
    grey_level = (F.col("_r") + F.col("_g") + F.col("_b")) / 3

    def scaled(c: str) -> Column:
        by = F.when(F.col(f"_{c}") > 0, grey_level / F.col(f"_{c}")).otherwise(1.0)
        return F.transform(c, lambda x: F.least(x * by, F.lit(255.0)))

    return met.select("image_id", "h", "w", *(scaled(c).alias(c) for c in "rgb"))


def gamma_corrected(channels: DataFrame, gamma: float = 1.2) -> DataFrame:
    """Channels from 0 to 255 raised to 1 / gamma on the scale from 0 to 1."""
    lift = lambda c: F.transform(c, lambda x: F.pow(F.greatest(x, F.lit(0.0)) / 255, F.lit(1 / gamma)) * 255)
    return channels.select("image_id", "h", "w", *(lift(c).alias(c) for c in "rgb"))


def equalised(images: DataFrame, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """image_id, h, w, v: contrast-limited adaptive equalisation of grey levels from 0 to 255.

    The image is cut into tiles * tiles parts (fewer if it is smaller). Each part's histogram of 256 levels is cut off at `clip` times its
    mean, what is cut off is spread over all levels, and its running share maps levels to 0 to 255. A pixel's value is
    blended from the maps of the four tiles whose middles are around it. Histograms are counted by a shuffle of levels, not of
    pixels, and an image gets its maps back in one row, tiles * tiles * 256 numbers at any size."""
    cut = lambda size: F.least(F.lit(tiles), F.col(size))
    level = F.transform("v", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x).cast("int"))))
    given = images.filter((F.col("h") > 0) & (F.col("w") > 0)).select("image_id", "h", "w", level.alias("q"), cut("h").alias("th"), cut("w").alias("tw"))
    row, column = F.floor(F.col("p") / F.col("w")), F.col("p") % F.col("w")
    tile = F.floor(row * F.col("th") / F.col("h")) * F.col("tw") + F.floor(column * F.col("tw") / F.col("w"))
    levels = given.select("image_id", "h", "w", "th", "tw", F.posexplode("q").alias("p", "q")).groupBy("image_id", tile.alias("tile"), "q").agg(F.count("*").cast("double").alias("n"))
    counts = levels.groupBy("image_id", "tile").agg(F.map_from_entries(F.collect_list(F.struct("q", "n"))).alias("n"), F.sum("n").alias("all"))
    limit = clip * F.col("all") / 256
    over = F.aggregate(F.map_values("n"), F.lit(0.0), lambda s, x: s + F.greatest(x - limit, F.lit(0.0)))
    share = lambda i, o: F.least(F.coalesce(F.try_element_at("n", i), F.lit(0.0)), limit) + o / 256
    none = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("to"))

    def running(o: Column) -> Column:
        def add(now: Column, i: Column) -> Column:
            return _let(now["sum"] + share(i, o), lambda x: F.struct(x.alias("sum"), F.array_append(now["to"], x / F.col("all") * 255).alias("to")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(255)), none, add, lambda now: now["to"])

    maps = counts.select("image_id", "tile", _let(over, running).alias("map"))
    maps = maps.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", "map"))), lambda x: x["map"]).alias("maps"))

    def side(at: Column, n: str, size: str) -> Column:
        place = (at + 0.5) * F.col(n) / F.col(size) - 0.5
        inside = lambda x: F.greatest(F.lit(0), F.least(x, F.col(n) - 1)).cast("int")
        return F.struct(inside(F.floor(place)).alias("low"), inside(F.floor(place) + 1).alias("high"), (place - F.floor(place)).alias("part"))

    def blended(q: Column, p: Column) -> Column:
        def among(y: Column, x: Column) -> Column:
            of = lambda a, b: F.get(F.get("maps", a * F.col("tw") + b), q)
            across = lambda a: (1 - x["part"]) * of(a, x["low"]) + x["part"] * of(a, x["high"])
            return (1 - y["part"]) * across(y["low"]) + y["part"] * across(y["high"])

        return _let(side(F.floor(p / F.col("w")), "th", "h"), lambda y: _let(side(p % F.col("w"), "tw", "w"), lambda x: among(y, x)))

    return given.join(maps, "image_id").select("image_id", "h", "w", F.transform("q", blended).alias("v"))


def bilateral(images: DataFrame, radius: int = 2, space: float = 2.0, level: float = 25.0) -> DataFrame:
    """image_id, h, w, v: each pixel as the mean of those around it, weighted by how near they are in place and in value;
    pixels outside don't count."""
    near = [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * space * space))) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]

    def smooth(v: np.ndarray) -> np.ndarray:
        weights, sums = np.zeros_like(v), np.zeros_like(v)
        h, w = v.shape
        for dy, dx, by in near:
            to = (slice(max(0, -dy), max(0, min(h, h - dy))), slice(max(0, -dx), max(0, min(w, w - dx))))
            of = (slice(max(0, dy), max(0, min(h, h + dy))), slice(max(0, dx), max(0, min(w, w + dx))))
            weight = by * np.exp(-((v[of] - v[to]) ** 2) / (2 * level * level))
            weights[to] += weight
            sums[to] += weight * v[of]
        return sums / weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(v=[smooth(np.asarray(v, dtype=float).reshape(h, w)).ravel() for h, w, v in zip(batch.h, batch.w, batch.v, strict=True)])

    return images.select("image_id", "h", "w", "v").mapInPandas(run, "image_id long, h int, w int, v array<double>")
