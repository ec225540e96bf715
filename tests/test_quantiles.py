import numpy as np
import pytest

from tessella.operators import groups, quantiles


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    return [("a", float(x)) for x in rng.normal(size=700)] + [("b", float(x)) for x in rng.integers(0, 4, 300)] + [("c", 5.0), ("b", None)]


def test_both_ways_agree_with_numpy(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    for few in (0, 10**6):
        got = {r.g: r["quantiles"] for r in quantiles.quantiles(df, "v", shares, ["g"], few).collect()}
        for g in "abc":
            assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], shares))
        whole = quantiles.quantiles(df, "v", shares, few=few).first()["quantiles"]
        assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], shares))


def test_describe_by_sorting(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "g string, v double")
    for by in (["g"], None):
        small = {tuple(r) for r in groups.describe(df, ["v"], by).collect()}
        monkeypatch.setattr(groups, "few_values", lambda d, c: dict.fromkeys(c, False))
        large = {tuple(r) for r in groups.describe(df, ["v"], by).collect()}
        monkeypatch.undo()
        flat = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
        assert flat(small) == flat(large)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.quantiles(df, "v", [0.5], ["g"], few=-1).count() == 0
