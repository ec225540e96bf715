"""Goldens of the experiment's own tables, and the statistics on edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import safe, special
from tessella.operators import clusters, distributions as dist, groups, relations
from tessella.sources import dimensions as dims


def test_ionic_strength(spark):
    got = {r["sample"]: r for r in dims.ionic_strength(spark).collect()}
    want = {"A": 7.61396, "B": 5.76396, "C": 3.71396, "D": 10.51396, "E": 12.01396}
    assert {s: round(r.weighted, 5) for s, r in got.items()} == want
    assert round(got["A"].total, 5) == 2.88824


def test_design_and_transitions(spark):
    design = dims.design(spark)
    assert design.count() == 225 and design.select("condition", "image_id").distinct().count() == 225
    assert {r.letter: (r.temp_mean, r.humidity_mean) for r in design.select("letter", "temp_mean", "humidity_mean").distinct().collect()}["F"] == (24.5, 47.5)
    blocks = design.select("water_sample", safe.sample_block("image_id").alias("b"), safe.replicate("image_id").alias("r"), "replicate").distinct().collect()
    assert {(r.water_sample, r.b) for r in blocks} == set(zip("ABCDE", range(1, 6), strict=True)) and all(r.r == r.replicate for r in blocks)
    assert dims.transitions(spark).count() == 24


def test_tails_against_published_values():
    assert special.f_tail(6.254, 2, 222) == pytest.approx(0.0023, abs=5e-5)
    assert special.f_tail(1.113, 2, 222) == pytest.approx(0.3302, abs=5e-4)
    assert special.t_tails(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.t_tails(0, 5) == pytest.approx(1)


def test_anova_identity_and_p(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), float(rng.normal(i % 3 * 0.1))) for i in range(225)]
    r = relations.anova(spark.createDataFrame(rows, "g int, v double"), "g", "v", p_value=True).first()
    assert r.eta_squared == pytest.approx(r.f * 2 / (r.f * 2 + 222)) and r.p == pytest.approx(special.f_tail(r.f, 2, 222))
    groups_ = [np.array([v for g, v in rows if g == k]) for k in range(3)]
    grand = np.concatenate(groups_).mean()
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups_)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups_)
    assert r.f == pytest.approx(between / 2 / (within / 222))


def test_constant_missing_and_single_rows(spark):
    df = safe.clean_numbers(spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (2, math.nan, 5.0), (3, None, 5.0), (1, 4.0, 5.0)], "g int, x double, c double"))
    assert relations.correlation(df, "x", "c").first().r is None
    assert {(r.a, r.b): r.r for r in relations.matrix(df, ["x", "c"]).collect()} == {("x", "x"): 1.0, ("c", "c"): None, ("x", "c"): None, ("c", "x"): None}
    cv = {r.g: r for r in groups.variation(df, ["g"], "x").collect()}
    assert cv[2].cv_pop is None and cv[1].cv_pop == pytest.approx(np.std([1, 2, 4]) / np.mean([1, 2, 4]) * 100)
    z = [r.c for r in dist.zscores(df, ["c"]).collect()]
    assert z == [0.0] * 5
    assert [r.bin_c for r in dist.histogram(df, ["c"], 10).collect()] == [0]
    one = spark.createDataFrame([(1, 1.0)], "g int, x double")
    assert relations.anova(one, "g", "x").first().f is None
    assert relations.anova(one.limit(0), "g", "x", p_value=True).first().n in (0, None)


def test_ties_stay_together_in_terciles(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1] * 7 + [2] * 2 + [3])], "i int, v double")
    got = {r.v: r.t for r in dist.terciles(df, "v", "t").collect()}
    assert got == {1.0: "Low", 2.0: "High", 3.0: "High"}


def test_matrix_is_symmetric_with_unit_diagonal(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(80, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double, d double")
    got = {(r.a, r.b): r.r for r in relations.matrix(df, list("abcd")).collect()}
    want = np.corrcoef(m.T)
    assert all(got[("abcd"[i], "abcd"[j])] == pytest.approx(want[i, j]) for i in range(4) for j in range(4))


def test_linkage_on_a_line():
    rows = np.array([[0.0], [1.0], [10.0], [12.0]])
    merges = clusters.linkage(rows, "complete")
    assert [(a, b, d) for a, b, d, _ in merges] == [(0, 1, 1.0), (2, 3, 2.0), (4, 5, 12.0)]
    assert clusters.leaves(merges, 4) == [0, 1, 2, 3]
    ward = clusters.linkage(rows, "ward")
    assert ward[-1][2] == pytest.approx(math.sqrt(2 * 2 * 2 / 4) * 10.5)


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(8 * (i % 3))), float(rng.normal(8 * (i % 2)))) for i in range(150)]
    got = clusters.kmeans(spark.createDataFrame([(i, 8.0 * (i % 3) + x / 20, 0.0) for i, x, _ in rows], "k int, x double, y double"), "k", ["x", "y"], starts=3).collect()
    assert len({(r.k % 3, r.cluster) for r in got}) == 3


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("a", float(x)) for x in rng.normal(50, 5, 300)] + [("b", 1.0)], "g string, v double")
    got = [r for r in dist.density_1d(df, "g", "v", 0, 100, 401).collect()]
    assert {r.g for r in got if isinstance(r.g, str)} <= {"a"} and sum(r.density for r in got) * 0.25 == pytest.approx(1, abs=0.01)


def test_normal_plot_of_normal_data_is_straight(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, "g", float(x)) for i, x in enumerate(rng.normal(3, 2, 400))], "i int, g string, v double")
    fit = dist.normal_fit(dist.normal_plot(df, "g", "v", "i"), "g").first()
    assert fit.r2 > 0.98 and fit.slope == pytest.approx(2, rel=0.1) and fit.intercept == pytest.approx(3, rel=0.1)


def test_bootstrap_interval_covers_the_mean(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, i % 2, float(x)) for i, x in enumerate(rng.normal(10, 1, 120))] + [(999, 7, 1.0)], "i int, g int, v double")
    got = {r.g: r for r in dist.bootstrap(df, "g", "v", "i", 200).collect()}
    assert got[7].low is None and all(got[g].low < got[g].mean < got[g].high for g in (0, 1))


def test_resampling_weights_are_poisson_and_unrelated(spark):
    w = np.array([r.w for r in spark.range(1000).select(dist.draw_weights(F.col("id"), 60).alias("w")).collect()])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    r = np.corrcoef(w.T)[~np.eye(60, dtype=bool)]
    assert abs(r.mean()) < 0.01 and np.abs(r).max() < 0.2


@pytest.mark.parametrize("factor", [0.01, 0.4, None])
def test_density_by_buckets_equals_the_sum_over_values(spark, factor):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(30, 5, 150), rng.normal(70, 1, 50), [-400.0, 900.0, 50.0, 50.0]])
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0), ("b", 2.0), ("c", 5.0)] + [("c", 5.0)] * 3 + [("a", None)], "g string, v double")
    got = {(r.g, r.i): r.density for r in dist.density_1d(df.withColumnRenamed("g", "k"), "k", "v", 0.0, 100.0, 101, factor).withColumnsRenamed({"g": "i", "k": "g"}).collect()}
    h = v.std(ddof=1) * (factor or len(v) ** -0.2)
    plain = np.exp(-0.5 * ((np.arange(101)[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert len(got) == 101 and np.abs(np.array([got["a", i] for i in range(101)]) - plain).max() < 1e-9


def test_p_labels(spark):
    df = spark.createDataFrame([(0.0005,), (0.003,), (0.04,), (0.3,), (None,)], "p double")
    got = [(r.a, r.b) for r in df.select(safe.p_value_text(F.col("p")).alias("a"), safe.p_value_stars(F.col("p")).alias("b")).collect()]
    assert got == [("<0.001", "***"), ("0.0030", "**"), ("0.0400", "*"), ("0.3000", "ns"), (None, "ns")]
