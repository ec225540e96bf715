"""Values of the operators that SQL doesn't express, against numpy and plain Python; numbering and blocks at odd sizes."""

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.functions.special import normal_quantile
from tessella.operators import blocks, clusters, distributions, groups, images, ranks, relations
from tessella.plans import pipeline
from tessella.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = tables.table(spark, DATA, "embeddings").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)


def test_principal_components(spark, vectors):
    ids, x = vectors
    z = (x - x.mean(0)) / x.std(0)
    values, axes = np.linalg.eigh(np.cov(z.T))
    order = values.argsort()[::-1][:2]
    got = {(r.component, r.feature): (r.loading, r.explained) for r in pipeline.all_queries()["pca_loadings"](spark, DATA).collect()}
    for c, at in enumerate(order):
        for j in range(64):
            loading, explained = got[(c, f"e{j}")]
            assert loading == pytest.approx(abs(axes[j, at]), abs=1e-6) and explained == pytest.approx(values[at] / values.sum(), abs=1e-9)
    scores = {r.vec_id: (r.pc1, r.pc2) for r in pipeline.all_queries()["pca_scores"](spark, DATA).collect()}
    want = z @ axes[:, order]
    for i, w in zip(ids, want, strict=True):
        assert np.abs(scores[i]) == pytest.approx(np.abs(w), abs=1e-6)


def test_kmeans_is_a_fixed_point(spark, vectors):
    ids, x = vectors
    z = (x - x.mean(0)) / x.std(0)
    got = {r.vec_id: r.cluster for r in pipeline.all_queries()["kmeans_three"](spark, DATA).collect()}
    label = np.array([got[i] for i in ids])
    centers = np.array([z[label == k].mean(0) for k in range(3)])
    nearest = ((z[:, None] - centers) ** 2).sum(-1).argmin(1)
    assert set(label) == {0, 1, 2} and (nearest == label).mean() > 0.95


@pytest.mark.parametrize("how", ["complete", "ward"])
def test_linkage_of_all_components(spark, vectors, how):
    _, x = vectors
    r = np.corrcoef(x.T)
    rows = r if how == "complete" else 1 - r
    names_ = sorted(f"e{i}" for i in range(64))
    at = [int(n[1:]) for n in names_]
    rows = rows[np.ix_(at, at)]
    live = {i: [i] for i in range(64)}
    got = sorted(pipeline.all_queries()[f"linkage_{how}"](spark, DATA).collect(), key=lambda m: m.step)
    assert len(got) == 63
    for new, m in enumerate(got, 64):
        a, b = rows[live.pop(m.left_node)], rows[live.pop(m.right_node)] if m.right_node != m.left_node else None
        if how == "complete":
            apart = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).max()
        else:  # the growth of the squared sum
            apart = np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum())
        assert m.distance == pytest.approx(apart, rel=1e-6)
        live[new] = [i for node in (m.left_node, m.right_node) for i in members(got, node)]
        assert m["size"] == len(live[new])
    assert [m.distance for m in got] == sorted(m.distance for m in got)


def members(merges, node):
    if node < 64:
        return [node]
    return members(merges, merges[node - 64].left_node) + members(merges, merges[node - 64].right_node)


def test_matrix_in_leaf_order(spark):
    cells = pipeline.all_queries()["matrix_in_leaf_order"](spark, DATA).collect()
    merges = sorted(pipeline.all_queries()["linkage_complete"](spark, DATA).collect(), key=lambda m: m.step)
    order = [sorted(f"e{i}" for i in range(64))[leaf] for leaf in members(merges, 126)]
    assert len(cells) == 64 * 64 and all((order[c.row_place], order[c.col_place]) == (c.a, c.b) for c in cells)


def test_normal_quantile(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.02, 0.0749, 0.075, 0.3, 0.5, 0.7, 0.925, 0.9251, 0.999999]
    got = [r.q for r in spark.createDataFrame([(x,) for x in p], "p double").select(normal_quantile(F.col("p")).alias("q")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-12, abs=1e-15)
    none = spark.createDataFrame([(0.0,), (1.0,), (None,), (-1.0,)], "p double").select(normal_quantile(F.col("p")).alias("q")).collect()
    assert [r.q for r in none] == [None] * 4


def test_large_means_do_not_cancel(spark):
    r = random.Random(1)
    rows = [(g, 1e9 + g + r.gauss(0, 1)) for g in range(3) for _ in range(200)]
    a = relations.anova(spark.createDataFrame(rows, "g int, v double"), "g", "v").first()
    x = np.array([v for _, v in rows]).reshape(3, 200) - 1e9
    between, within = 200 * ((x.mean(1) - x.mean()) ** 2).sum(), ((x - x.mean(1, keepdims=True)) ** 2).sum()
    assert a.f == pytest.approx((between / 2) / (within / 597), rel=1e-4)
    image = [1e9 + r.gauss(0, 1) for _ in range(64)]
    s = images.basic_stats(spark.createDataFrame([(1, 8, 8, image)], "image_id long, h int, w int, v array<double>")).first()
    assert s.contrast == pytest.approx(np.std(np.array(image) - 1e9), rel=1e-5)


def test_numbering(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = {x.id: (x.i, x["_n"]) for x in ranks.numbered(df, ["v", "id"], ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((v, i) for h, v, i in rows if h == g)
        assert all(got[i] == (n, len(own)) for n, (_, i) in enumerate(own, 1))
    assert ranks.numbered(df.limit(0), ["v"]).count() == 0


def test_blocks_meet_once(spark):
    left, right = spark.range(37).toDF("x"), spark.range(23).toDF("y")

    def pairs(a, b):
        return a.merge(b, how="cross")

    got = [(r.x, r.y) for r in blocks.meet(left, right, pairs, "x long, y long", size=5).collect()]
    assert sorted(got) == [(x, y) for x in range(37) for y in range(23)]


def test_density_3d_matches_its_formula(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(80, 3)), 1)
    x = np.vstack([x, x[:15]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(999, None, 1.0, 1.0)], "k long, p double, q double, s double")
    cov = 0.15**2 * np.cov(x.T)
    d = x[:, None] - x[None]
    want = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(cov), d)).sum(1) / (len(x) * np.sqrt((2 * np.pi) ** 3 * np.linalg.det(cov)))
    got = {r.k: r.density for r in distributions.density_3d(df, "k", ["p", "q", "s"]).collect()}
    assert got == pytest.approx(dict(enumerate(want)), rel=1e-9)
    flat = distributions.density_3d(df.withColumn("s", F.lit(1.0)), "k", ["p", "q", "s"]).collect()
    assert {r.density for r in flat} == {1.0}


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3.0, 4.0)], "id int, normal_a double, normal_b string, sem_a double, sem_c double")
    assert names.matching(df, "^normal_|_c$") == ["normal_a", "sem_c"] and names.matching(df, "^normal_", numeric=False) == ["normal_a", "normal_b"]
    assert names.existing(df, ["sem_a", "gone", "id", "id"]).columns == ["sem_a", "id"]
    assert names.pairs(df, "normal_", "sem_") == [("normal_a", "sem_a")]
    cut = spark.createDataFrame([("normal_texture_dissimilarity_d1",)], "c string").select(names.abbreviated(F.col("c"))).first()[0]
    assert cut == "normal_tex_dissim_d1"


def test_places_by_mean(spark):
    means = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None), ("d", 3.0)], "g string, m double")
    assert {r.g: r.place for r in groups.by_mean(means, "m", "g").collect()} == {"b": 1, "d": 2, "a": 3, "c": 4}


def test_element_maps_and_fallback_paths(spark, tmp_path):
    from struct import pack
    from zlib import compress, crc32

    def png(value):
        def part(kind, data):
            return pack(">I", len(data)) + kind + data + pack(">I", crc32(kind + data))

        body = compress(b"".join(b"\0" + bytes([value] * 4) for _ in range(4)))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", pack(">IIBBBBB", 4, 4, 8, 0, 0, 0, 0)) + part(b"IDAT", body) + part(b"IEND", b"")

    for c, n, e in (("A", 1, "Mg"), ("A", 2, "Mg"), ("B", 1, "Si")):
        at = tmp_path / "eds" / c / str(n)
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{e}.png").write_bytes(png(10 * n))
    conditions, elements = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("condition", "AB"), ("element", ["Mg", "Si"])))
    got = {(r.condition, r.replicate, r.element): r.image for r in tables.element_files(spark, str(tmp_path / "eds"), conditions, elements, 2).collect()}
    assert len(got) == 8 and {k for k, v in got.items() if v} == {("A", 1, "Mg"), ("A", 2, "Mg"), ("B", 1, "Si")}
    assert got[("A", 2, "Mg")].height == 4 and set(got[("A", 2, "Mg")].data) == {20}
    (tmp_path / "b.csv").write_text("x\n1\nNaN\n")
    assert [r.x for r in tables.csv_or(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "x double").collect()] == [1.0, None]


def test_reindexed_keeps_the_order_and_shows_what_is_absent(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("a", 3.0), (None, 4.0), ("z", 5.0)], "k string, place double")
    got = groups.reindexed(df, "k", ["a", "c", "b", "a"], "at").collect()
    assert sorted((r.at, r.k, r.place) for r in got if r.place) == [(0, "a", 2.0), (0, "a", 3.0), (2, "b", 1.0)]
    assert [(r.at, r.k) for r in got if r.place is None] == [(1, "c")]
    assert groups.reindexed(df.limit(0), "k", ["a"], "at").count() == 1


def test_display_names_follow_the_order_of_rewritings(spark):
    asked = {"cross_modal_ssim": "Cross Modal SSIM", "sem_freq__energy": "SEM Frequency Energy", "texture_contrast_d1_a0": "Texture Contrast Distance 1 Angle 0°", "morph_a45_d2": "Morphological Angle 45° Distance 2", "_sem_": "Sem", "a135": "Angle 135°", "": ""}
    got = spark.createDataFrame([(k,) for k in asked] + [(None,)], "k string").select("k", names.display(F.col("k")).alias("d")).collect()
    assert {r.k: r.d for r in got} == {**asked, None: None}
