"""Image operators: the relational forms against array kernels, and properties that must hold."""

import struct
import zlib

import numpy as np
import pytest

from tessella.operators import images, kernels, regions
from tessella.sources import tables

KIND = "image_id long, h int, w int, v array<double>"


def frame(spark, arrays):
    return spark.createDataFrame([(i, *a.shape, [float(x) for x in a.ravel()]) for i, a in enumerate(arrays)], KIND)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(0)
    blobs = np.zeros((8, 8))
    blobs[1:3, 1:3] = blobs[3:5, 3:5] = 1.0  # touching at a corner: one region
    blobs[7, 0] = 1.0
    return [rng.normal(size=(8, 8)), rng.normal(size=(9, 12)), np.indices((8, 8)).sum(0) % 2.0, np.eye(8) + 0.0, blobs]


def test_relational_forms_equal_kernels(spark, arrays):
    df = frame(spark, arrays)
    wanted = {}
    for r in kernels.image_features(df).collect():
        wanted[(r.image_id, r.feature)] = r.value
    bits = images.foreground(df)
    parts = [(images.texture_wide(images.texture(df)), ""), (images.bands(images.spectrum(df)), "freq_"), (images.morphology(bits).join(regions.objects(bits), "image_id"), "morph_")]
    seen = 0
    for part, prefix in parts:
        for r in part.collect():
            for c in part.columns[1:]:
                assert r[c] == pytest.approx(wanted[(r.image_id, prefix + c)], abs=1e-8), (r.image_id, c)
                seen += 1
    assert seen == len(wanted) == 45 * len(arrays)


def test_flat_image(spark):
    df = frame(spark, [np.full((8, 8), 3.0)])
    assert images.texture(df).count() == 0
    assert images.quantised(df).first().q is None
    bits = images.foreground(df)
    assert sum(bits.first().bits) == 0 and regions.objects(bits).first().num_objects == 0
    stats = images.basic_stats(df).first()
    assert (stats.brightness, stats.contrast, stats.entropy) == (3.0, 0.0, 0.0)


def test_spectrum_keeps_energy(spark, arrays):
    total = {r.image_id: r.total_spectral_energy for r in images.bands(images.spectrum(frame(spark, arrays))).collect()}
    for i, a in enumerate(arrays):
        assert total[i] == pytest.approx(a.size * (a**2).sum())


def test_morphology_is_ordered_and_regions_add_up(spark, arrays):
    bits = images.foreground(frame(spark, arrays))
    for r in images.morphology(bits).collect():
        assert r.erosion_area_ratio <= r.object_area_ratio <= r.dilation_area_ratio
    of = {r.image_id: r for r in regions.objects(bits).collect()}
    for r in bits.collect():
        assert of[r.image_id].num_objects * of[r.image_id].mean_object_area == pytest.approx(sum(r.bits))
    assert of[4].num_objects == 2 and of[4].largest_object_area == 8


def test_regions_against_flood_fill():
    rng = np.random.default_rng(7)
    for _ in range(60):
        bits = rng.random((9, 11)) < rng.random()
        todo, sizes = {tuple(p) for p in np.argwhere(bits)}, []
        while todo:
            stack, n = [todo.pop()], 0
            while stack:
                y, x = stack.pop()
                n += 1
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & todo
                todo -= near
                stack += near
            sizes.append(n)
        assert kernels.regions(bits).tolist() == sorted(sizes)


def test_similarity(spark, arrays):
    a = frame(spark, arrays)
    assert all(r.ssim == pytest.approx(1) for r in images.similarity(a, a).collect())
    big = np.pad(arrays[0], ((0, 3), (0, 2)))
    got = images.similarity(frame(spark, [arrays[0]]), frame(spark, [big])).first().ssim
    assert 0.5 < got <= 1  # cropped to the common part


def test_features_have_91_columns_and_skip_halves(spark, arrays):
    a, b = frame(spark, arrays[:1] + arrays[2:4]), frame(spark, arrays[:1] + arrays[2:3])
    out = images.features(a, b)
    assert len(out.columns) == 92 and {r.image_id for r in out.collect()} == {0, 1}


def png(a):
    """A PNG file of an RGB array."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = a.shape
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(9)
    pictures = {}
    for n in (1, 2):
        for kind in ("Image", "SEM"):
            if (n, kind) == (2, "SEM"):
                continue
            pictures[n, kind] = a = rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
            folder = tmp_path / "condition_A"
            folder.mkdir(exist_ok=True)
            (folder / f"{kind}_{n}.png").write_bytes(png(a))
    found = tables.image_files(spark, str(tmp_path), "*.png")
    assert found.count() == 3
    pairs = tables.image_pairs(found, "image", "sem")
    assert [(r.condition, r.image_id) for r in pairs.select("condition", "image_id").collect()] == [("condition_A", 1)]
    r = kernels.decoded(pairs.select("image_id", "image")).first()
    assert np.array_equal(np.stack([r.r, r.g, r.b], -1).reshape(6, 5, 3), pictures[1, "Image"])


def test_equalisation_and_smoothing_equal_plain_versions(spark):
    rng = np.random.default_rng(12)
    pictures = [rng.random((h, w)) * 255 for h, w in [(24, 17), (3, 5), (1, 1)]] + [np.full((9, 9), 7.0)]
    df = spark.createDataFrame([(i, *p.shape, p.ravel().tolist()) for i, p in enumerate(pictures)], "image_id long, h int, w int, v array<double>")
    equal = {r.image_id: np.array(r.v).reshape(r.h, r.w) for r in images.equalised(df, 4, 3.0).collect()}
    smooth = {r.image_id: np.array(r.v).reshape(r.h, r.w) for r in images.bilateral(df).collect()}
    for n, p in enumerate(pictures):
        (h, w), q = p.shape, np.floor(p).astype(int)
        th, tw = min(4, h), min(4, w)
        maps = np.zeros((th, tw, 256))
        for a in range(th):
            for b in range(tw):
                inside = [q[y, x] for y in range(h) for x in range(w) if y * th // h == a and x * tw // w == b]
                counts = np.bincount(inside, minlength=256).astype(float)
                limit = 3.0 * counts.sum() / 256
                maps[a, b] = (np.minimum(counts, limit) + np.maximum(counts - limit, 0).sum() / 256).cumsum() / counts.sum() * 255
        for y in range(h):
            for x in range(w):
                fy, fx = (y + 0.5) * th / h - 0.5, (x + 0.5) * tw / w - 0.5
                y0, x0 = int(np.floor(fy)), int(np.floor(fx))
                at = lambda a, b: maps[np.clip(a, 0, th - 1), np.clip(b, 0, tw - 1), q[y, x]]  # noqa: B023, E731
                wy, wx = fy - y0, fx - x0
                plain = (1 - wy) * ((1 - wx) * at(y0, x0) + wx * at(y0, x0 + 1)) + wy * ((1 - wx) * at(y0 + 1, x0) + wx * at(y0 + 1, x0 + 1))
                assert equal[n][y, x] == pytest.approx(plain, abs=1e-9)
                near = [(u, v) for u in range(max(0, y - 2), min(h, y + 3)) for v in range(max(0, x - 2), min(w, x + 3))]
                weights = [np.exp(-((u - y) ** 2 + (v - x) ** 2) / 8) * np.exp(-((p[u, v] - p[y, x]) ** 2) / 1250) for u, v in near]
                assert smooth[n][y, x] == pytest.approx(np.average([p[u, v] for u, v in near], weights=weights), abs=1e-9)
