"""8-connected regions of images of any size: strips are labelled each for itself, labels are joined along the seams.

A strip is some rows of an image and the first row of the next strip. Runs of true pixels are joined to local labels within the
strip; the row that two strips share has the same runs in both, so a run's two labels belong together. Those links are an
equi-join on (image, row, where the run begins), and regions are the links' connected components, found by steps that hang
every label onto the least one in sight, whose number grows with the logarithm of how many strips a region crosses. No image,
and no region, is one task's work; images of one strip have no seams and no steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.sources.scratch import written

#: Rows of a strip.
STRIP = 256


def strips(bits: DataFrame, rows: int = STRIP) -> DataFrame:
    """image_id, strip, first (row), own (rows), w, bits (of the own rows and the next strip's first) from image_id, h, w, bits."""
    cut = bits.withColumn("strip", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("h") / rows) - 1, F.lit(0)).cast("int"))))
    first = F.col("strip") * rows
    own = F.least(F.lit(rows), F.col("h") - first)
    taken = F.least(F.lit(rows + 1), F.col("h") - first)
    return cut.select("image_id", "strip", first.alias("first"), own.alias("own"), "w", F.slice("bits", first * F.col("w") + 1, taken * F.col("w")).alias("bits"))


def labelled(bits: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs of true pixels, row by row, as (begin, end, label); a label is the number of its region's first run."""
    parent: list[int] = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows: list[list[tuple[int, int, int]]] = []
    for row in bits:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))).tolist()
        above, here, at = rows[-1] if rows else [], [], 0
        for begin, end in zip(edges[::2], edges[1::2], strict=True):
            own = len(parent)
            parent.append(own)
            while at < len(above) and above[at][1] < begin:
                at += 1
            k = at
            while k < len(above) and above[k][0] <= end:
                x, y = top(above[k][2]), top(own)
                parent[max(x, y)] = min(x, y)
                k += 1
            here.append((begin, end, own))
        rows.append(here)
    return [[(a, b, top(i)) for a, b, i in row] for row in rows]


def _labels(cut: DataFrame) -> DataFrame:
    """image_id, strip, label, n (pixels of own rows), row and begin: a region's size, or (n null) one of its runs on a seam."""
    kind = cut.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                strip, first, own, w = (batch[c][at].as_py() for c in ("strip", "first", "own", "w"))
                bits = batch["bits"][at].values.to_numpy(zero_copy_only=False).astype(bool)
                rows = labelled(bits.reshape(-1, w)) if w else []
                sizes: dict[int, int] = {}
                for row in rows[:own]:
                    for begin, end, label in row:
                        sizes[label] = sizes.get(label, 0) + end - begin
                out = [(label, n, None, None) for label, n in sizes.items()]
                # the first row is a seam with the strip above, the row behind the own ones with the strip below
                for y in [0] * (strip > 0) + [own] * (len(rows) > own):
                    out += [(label, None, first + y, begin) for begin, _, label in rows[y]]
                if out:
                    made = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                    image = pa.array([batch["image_id"][at].as_py()] * len(out), batch["image_id"].type)
                    yield pa.RecordBatch.from_arrays([image, pa.array([strip] * len(out), pa.int64()), *made], ["image_id", "strip", "label", "n", "row", "begin"])

    return cut.mapInArrow(run, f"image_id {kind}, strip long, label long, n long, row long, begin long")


def least_in_reach(links: DataFrame) -> DataFrame:
    """image_id, node, least: the least node that links (image_id, u, v) lead to, for every node that has one.

    Large-star and small-star steps in turn; each is a table, minima are partial aggregates."""
    now = written(links.filter("u <> v").select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "region-links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            roots = now.select("image_id", F.col("v").alias("node"), F.col("v").alias("least")).distinct()
            return now.select("image_id", F.col("u").alias("node"), F.col("v").alias("least")).unionByName(roots)
        seen = state
        both = now.unionByName(now.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hung(both).filter("w > u").select("image_id", F.col("w").alias("u"), "v")
        small = _hung(large.filter("u > v"))
        small = small.select("image_id", F.col("w").alias("u"), "v").unionByName(small.select("image_id", "u", "v"))
        now = written(small.filter("u > v").distinct(), "region-links")


def _hung(links: DataFrame) -> DataFrame:
    """For every link (u, w), v: the least node next to u, itself included."""
    least = links.groupBy("image_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return links.join(least, ["image_id", "u"]).select("image_id", "u", F.col("v").alias("w"), F.col("least").alias("v"))


def strip_objects(cut: DataFrame) -> DataFrame:
    """image_id, num_objects, mean_object_area, largest_object_area of images given as strips(); zeros where there are none."""
    found = written(_labels(cut).withColumn("node", (F.col("strip") * (1 << 40)) + F.col("label")), "region-labels")
    seams = found.filter("n IS NULL").select("image_id", "row", "begin", "node")
    links = seams.groupBy("image_id", "row", "begin").agg(F.min("node").alias("u"), F.max("node").alias("v"))
    least = least_in_reach(links)
    sizes = found.filter("n IS NOT NULL").select("image_id", "node", "n").join(least, ["image_id", "node"], "left")
    regions = sizes.groupBy("image_id", F.coalesce("least", "node").alias("region")).agg(F.sum("n").alias("n"))
    per = regions.groupBy("image_id").agg(F.count("*").alias("objects"), F.avg("n").alias("mean"), F.max("n").cast("double").alias("largest"))
    zero = lambda c, to: F.coalesce(c, F.lit(0).cast(to))
    every = cut.select("image_id").distinct().join(per, "image_id", "left")
    return every.select("image_id", zero("objects", "bigint").alias("num_objects"), zero("mean", "double").alias("mean_object_area"), zero("largest", "double").alias("largest_object_area"))


def objects(bits: DataFrame, rows: int = STRIP) -> DataFrame:
    """strip_objects of whole images (image_id, h, w, bits)."""
    return strip_objects(strips(bits.select("image_id", "h", "w", "bits"), rows))
