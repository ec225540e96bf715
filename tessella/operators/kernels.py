"""Array kernels for images too large for the relational forms, and for what those can't say (connected regions).

One image in, one row out, in Arrow batches; the numbers equal those of `images` on tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .images import DISK, OFFSETS, TEXTURES


def regions(bits: np.ndarray) -> np.ndarray:
    """Sizes of the 8-connected regions of true pixels: runs of rows, joined where runs of neighbouring rows touch."""
    parent: list[int] = []
    sizes: list[int] = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for row in bits:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here, at = [], 0
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            own = len(parent)
            parent.append(own)
            sizes.append(int(b - a))
            while at < len(above) and above[at][1] < a:
                at += 1
            k = at
            while k < len(above) and above[k][0] <= b:
                parent[top(above[k][2])] = top(own)
                k += 1
            here.append((int(a), int(b), own))
        above = here
    total: dict[int, int] = {}
    for i, n in enumerate(sizes):
        total[top(i)] = total.get(top(i), 0) + n
    return np.array(sorted(total.values()), dtype=np.int64)


def texture_of(image: np.ndarray) -> dict[str, float]:
    """texture_<property>_d<distance>_a<angle> of a grey image; empty if it is flat."""
    low, high = image.min(), image.max()
    if high <= low:
        return {}
    q = np.floor((image - low) * 255 / (high - low)).astype(np.int64)
    out = {}
    h, w = q.shape
    for (d, a), (dy, dx) in OFFSETS.items():
        x0, x1 = max(0, -dx), min(w, w - dx)
        i, j = q[: h - dy, x0:x1].ravel(), q[dy:, x0 + dx : x1 + dx].ravel()
        apart = np.abs(i - j).astype(float)
        counts = np.bincount(np.concatenate([i * 256 + j, j * 256 + i]), minlength=65536)
        values = ((apart**2).mean(), apart.mean(), (1 / (1 + apart**2)).mean(), np.sqrt((counts.astype(float) ** 2).sum()) / (2 * len(i)))
        out |= {f"texture_{t}_d{d}_a{a}": float(v) for t, v in zip(TEXTURES, values, strict=True)}
    return out


def bands_of(image: np.ndarray) -> dict[str, float]:
    power = np.abs(np.fft.fftshift(np.fft.fft2(image))) ** 2
    cy, cx = (n // 2 for n in image.shape)
    y, x = np.ogrid[: image.shape[0], : image.shape[1]]
    r, most = np.hypot(y - cy, x - cx), min(cy, cx)
    total = power.sum()
    masks = {"low": r < most / 3, "mid": (r >= most / 3) & (r < 2 * most / 3), "high": r >= 2 * most / 3}
    out = {f"{b}_freq_magnitude": float(np.sqrt(power[m]).mean()) for b, m in masks.items()}
    out |= {f"{b}_freq_energy_ratio": float(power[m].sum() / total) if total else 0.0 for b, m in masks.items()}
    return out | {"total_spectral_energy": float(total)}


def shape_of(image: np.ndarray) -> dict[str, float]:
    low, high = image.min(), image.max()
    level = np.minimum((image - low) / (high - low) * 256 if high > low else np.zeros_like(image), 255).astype(np.int64)
    n = np.bincount(level.ravel(), minlength=256)
    n0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.round(n0 * (n0[-1] - n0) * (s0 / n0 - (s0[-1] - s0) / (n0[-1] - n0)) ** 2, 6)
    bits = level > np.nanargmax(between) if high > low else np.zeros(image.shape, bool)
    grown, worn = np.zeros_like(bits), np.ones_like(bits)
    h, w = bits.shape
    for dy, dx in DISK:
        to = (slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx)))
        of = (slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx)))
        grown[to] |= bits[of]
        worn[to] &= bits[of]
    sizes = regions(bits)
    return {
        "object_area_ratio": float(bits.mean()), "erosion_area_ratio": float(worn.mean()), "dilation_area_ratio": float(grown.mean()), "num_objects": float(len(sizes)),
        "mean_object_area": float(sizes.mean()) if len(sizes) else 0.0, "largest_object_area": float(sizes.max()) if len(sizes) else 0.0,
    }


def image_features(images: DataFrame) -> DataFrame:
    """image_id, feature, value for every grey image (image_id, h, w, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, h, w, v in zip(batch.image_id, batch.h, batch.w, batch.v, strict=True):
                image = np.asarray(v, dtype=float).reshape(h, w)
                found = texture_of(image) | {f"freq_{k}": x for k, x in bands_of(image).items()} | {f"morph_{k}": x for k, x in shape_of(image).items()}
                rows += [(i, k, x) for k, x in found.items()]
            yield pd.DataFrame(rows, columns=["image_id", "feature", "value"])

    return images.select("image_id", "h", "w", "v").mapInPandas(run, "image_id long, feature string, value double")


def decoded(images: DataFrame, column: str = "image") -> DataFrame:
    """image_id, h, w, r, g, b (doubles) from Spark's image struct, whose bytes are blue, green, red; one channel counts for all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, im in zip(batch.image_id, batch[column], strict=True):
                h, w, n = im["height"], im["width"], im["nChannels"]
                px = np.frombuffer(im["data"], np.uint8).reshape(h * w, n).astype(float)
                b, g, r = (px[:, min(k, n - 1)] for k in (0, 1, 2)) if n >= 3 else (px[:, 0],) * 3
                out.append((i, h, w, r, g, b))
            yield pd.DataFrame(out, columns=["image_id", "h", "w", "r", "g", "b"])

    kind = "image_id long, h int, w int, r array<double>, g array<double>, b array<double>"
    return images.select("image_id", column).mapInPandas(run, kind)
