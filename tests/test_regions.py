import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.operators import images, kernels, regions


def snake(n, step=4):
    """One region that goes back and forth through the whole image."""
    image = np.zeros((n, n), bool)
    image[::step] = True
    for i, y in enumerate(range(0, n - step, step)):
        image[y : y + step, 0 if i % 2 else n - 1] = True
    return image


def frame(spark, pictures):
    rows = [(i, *p.shape, p.astype(int).ravel().tolist()) for i, p in enumerate(pictures)]
    return spark.createDataFrame(rows, "image_id long, h int, w int, bits array<int>")


@pytest.mark.parametrize("rows", [1, 3, 256])
def test_equals_one_pass(spark, rows):
    r = np.random.default_rng(2)
    pictures = [r.random((h, w)) < p for h, w, p in [(13, 9, 0.4), (20, 31, 0.6), (7, 70, 0.3), (5, 5, 0.0), (6, 4, 1.0), (1, 9, 0.5), (9, 1, 0.5)]] + [snake(30, 3)]
    got = {g.image_id: tuple(g)[1:] for g in regions.objects(frame(spark, pictures), rows).collect()}
    for i, p in enumerate(pictures):
        sizes = kernels.regions(p)
        assert got[i] == ((len(sizes), sizes.mean(), sizes.max()) if len(sizes) else (0, 0, 0))


def test_a_snake_through_64_strips_is_one_region(spark):
    """The image, 4,000 by 4,000, is never in one row; strips come from the tasks."""
    n, rows = 4000, 63

    def cut(batches):
        import numpy as np
        import pandas as pd

        image = np.zeros((n, n), bool)
        image[::8] = True
        for i, y in enumerate(range(0, n - 8, 8)):
            image[y : y + 8, 0 if i % 2 else n - 1] = True
        for batch in batches:
            for s in batch.id:
                part = image[s * rows : (s + 1) * rows + 1]
                own = min(rows, n - s * rows)
                yield pd.DataFrame({"image_id": [1], "strip": [int(s)], "first": [int(s * rows)], "own": [own], "w": [n], "bits": [part.astype(np.int32).ravel()]})

    strips = spark.range(0, 64, 1, 8).mapInPandas(cut, "image_id long, strip int, first int, own int, w int, bits array<int>")
    found = regions.strip_objects(strips).first()
    assert (found.num_objects, found.largest_object_area) == (1, snake(n, 8).sum())


def test_morphology_and_likeness_of_wide_images(spark):
    r = np.random.default_rng(3)
    pictures = [r.random((h, w)) < 0.5 for h, w in [(9, 130), (3, 64), (5, 65), (1, 1), (12, 63), (2, 200)]]
    for image in pictures[:2]:
        image[:, 5:60] = True
    got = {g.image_id: tuple(g)[1:] for g in images.morphology(frame(spark, pictures)).collect()}
    for i, p in enumerate(pictures):
        grown, worn = np.zeros_like(p), np.ones_like(p)
        for y in range(p.shape[0]):
            for x in range(p.shape[1]):
                near = [p[y + a, x + b] for a, b in images.DISK if 0 <= y + a < p.shape[0] and 0 <= x + b < p.shape[1]]
                grown[y, x], worn[y, x] = any(near), all(near)
        assert np.allclose(got[i], (p.mean(), worn.mean(), grown.mean()))
    pair = [r.random((9, 12)) for _ in range(2)]
    a, b = (spark.createDataFrame([(1, *p.shape, p.ravel().tolist())], "image_id long, h int, w int, v array<double>") for p in pair)
    s, t = ((p - p.min()) / (np.ptp(p) + 1e-8) for p in pair)
    likes = []
    for y in range(3):
        for x in range(6):
            u, v = (m[y : y + 7, x : x + 7].ravel() for m in (s, t))
            c = np.cov(u, v)
            likes.append((2 * u.mean() * v.mean() + 1e-4) * (2 * c[0, 1] + 9e-4) / ((u.mean() ** 2 + v.mean() ** 2 + 1e-4) * (c[0, 0] + c[1, 1] + 9e-4)))
    assert abs(images.similarity(a, b).select(F.col("ssim")).first()[0] - np.mean(likes)) < 1e-9
