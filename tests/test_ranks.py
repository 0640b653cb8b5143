import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import bivariate, ranks

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def table(spark, n=40_000):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=n), rng.integers(0, 7, n).astype(float)
    c = np.where(rng.random(n) < 0.3, 2.5, rng.exponential(size=n))
    rows = list(zip(a.tolist(), b.tolist(), c.tolist(), [None] * n, [1.0] + [None] * (n - 1), strict=True))
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(7), (a, b, c)


@pytest.mark.parametrize("small,accuracy", [(100_000, 10_000), (50, 100), (500, 10_000)])
def test_exact_quantiles_equal_numpy(spark, monkeypatch, small, accuracy):
    monkeypatch.setattr(ranks, "SMALL", small)
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    df, arrays = table(spark)
    found = ranks.exact_quantiles(df, [F.col(c) for c in "abcde"], PROBS, [F.max("x").alias("top")])
    for got, x in zip(found, arrays, strict=False):
        assert np.allclose(got["quantiles"], np.quantile(x, PROBS), rtol=1e-12, atol=1e-12) and got["top"] == x.max() and got["n"] == len(x)
    assert found[3]["quantiles"] is None and found[3]["n"] == 0 and found[4]["quantiles"] == [1.0] * len(PROBS)


def test_ranges_do_not_change_cumulative_counts(spark, monkeypatch):
    df, (_, _, c) = table(spark, 5_000)
    whole = {r.c: tuple(r) for r in ranks.cumulative(df, "c", {"n": F.count(F.lit(1))}).collect()}
    monkeypatch.setattr(ranks, "RANGE_ROWS", 300)
    parts = {r.c: tuple(r) for r in ranks.cumulative(df, "c", {"n": F.count(F.lit(1))}).collect()}
    assert whole == parts
    values, n = np.unique(c, return_counts=True)
    assert [parts[v][2] for v in values.tolist()] == np.cumsum(n).tolist()
    assert [parts[v][3] for v in values.tolist()] == values.tolist()[1:] + [None]
    assert ranks.cumulative(df, "d", {"n": F.count(F.lit(1))}).count() == 0


def test_kendall_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 40, 700).astype(float), rng.integers(0, 90, 700).astype(float)
    x[:300], y[100:350] = 7.0, 30.0
    y[400:] += x[400:]
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    tau = (a * b).sum() / np.sqrt((a**2).sum() * (b**2).sum())
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)) + [(None, 1.0)], "x double, y double")
    for rows in (1_000_000, 50, 7):
        monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
        got = bivariate.kendall(df, "x", "y").first()
        assert got["n"] == 700 and np.isclose(got["tau_b"], tau, atol=1e-12)
    assert bivariate.kendall(df.limit(0), "x", "y").first()["tau_b"] is None
