import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import charts, ensemble, ml, quality


def slow_lof(x, k):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = [sorted((far[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))]
    reach = [n[-1][0] for n in near]
    density = [1 / (np.mean([max(d, reach[j]) for d, j in n]) + 1e-10) for n in near]
    return np.array([np.mean([density[j] for _, j in n]) / density[i] for i, n in enumerate(near)])


def test_lof_is_the_plain_definition_on_its_own_sample():
    x = np.random.default_rng(3).normal(size=(150, 3))
    assert np.allclose(ensemble.lof_scorer(x, 7, block=64)(x), slow_lof(x, 7))
    assert (ensemble.lof_scorer(x[:1])(x) == 1).all()


def test_robust_covariance_ignores_a_far_cluster():
    rng = np.random.default_rng(5)
    clean = rng.multivariate_normal([0, 0], [[2, 1], [1, 1]], 800)
    mean, cov = ensemble.robust_covariance(np.vstack([clean, rng.normal(30, 1, (200, 2))]))
    assert np.abs(mean).max() < 0.3 and 1.2 < cov[0, 0] < 3.6 and 0.5 < cov[0, 1] < 1.8
    assert np.allclose(ensemble.robust_covariance(clean[:4])[0], clean[:4].mean(0))


@pytest.mark.parametrize("name", sorted(set(ensemble.SCORERS) - {"copod"}))
def test_each_detector_ranks_planted_rows_first(name):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(600, 1))
    x = np.hstack([base + rng.normal(0, 0.1, (600, 1)) for _ in range(4)])
    x[590:] = rng.choice([-9, 9], (10, 4))
    score = ensemble.SCORERS[name](x)(x)
    assert len(score) == 600 and np.median(score[590:]) > np.quantile(score[:590], 0.99)


def test_copula_tails_by_the_plain_definition():
    # it sums one-sided tails of the columns, so rows of mixed signs among correlated columns are not what it finds
    rng = np.random.default_rng(7)
    x = np.hstack([rng.normal(size=(300, 2)), -rng.exponential(size=(300, 1))])
    x[297:] = [9.0, 9.0, -12.0]
    left = np.array([[-math.log(sum(v <= u for v in x[:, d]) / 300) for d, u in enumerate(row)] for row in x])
    right = np.array([[-math.log(sum(v >= u for v in x[:, d]) / 300) for d, u in enumerate(row)] for row in x])
    skewed = np.where(((x - x.mean(0)) ** 3).mean(0) < 0, left, right).sum(1)
    score = ensemble.copula_scorer(x)(x)
    assert np.allclose(score, np.maximum(np.maximum(left.sum(1), right.sum(1)), skewed))
    assert set(np.argsort(-score)[:3]) == {297, 298, 299}


def test_ensemble_over_gaps_constants_and_no_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(k, *map(float, rng.normal(size=3)), 1.0) for k in range(400)]
    rows[5] = (5, 40.0, -40.0, 40.0, 1.0)
    rows[6] = (6, None, float("nan"), float("inf"), 1.0)
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, fixed double")
    top = ensemble.ensemble(df, ["a", "b", "c", "fixed"], ["id"], top_k=5).collect()
    assert top[0].id == 5 and top[0].consensus and top[0].votes >= 4 and set(top[0].drivers) == {"a", "b", "c"} and len(top) == 5
    frame, used = ensemble.standardised(df, ["a", "b", "c", "fixed"], ["id"])
    facts = frame.agg(F.avg(F.col("x")[0]).alias("m"), F.stddev_pop(F.col("x")[0]).alias("s")).first()
    assert used == ["a", "b", "c"] and abs(facts.m) < 1e-9 and abs(facts.s - 1) < 1e-9
    assert ensemble.ensemble(df.limit(0), ["a", "b"], ["id"]).count() == 0
    assert ensemble.ensemble(df, ["fixed"], ["id"]).count() == 0


def test_permutation_importance_finds_the_cause(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), "xy"[int(c)], float(3 * a + 0.1 * b)) for a, b, c in zip(rng.normal(size=600), rng.normal(size=600), rng.integers(0, 2, 600), strict=True)]
    df = spark.createDataFrame(rows, "cause double, noise double, kind string, y double")
    found = ml.permutation_importance(df, "y", repeats=2).collect()
    assert found[0].feature == "cause" and found[0].importance > 0.5 and all(r.importance < 0.2 for r in found[1:]) and len(found) == 3


def test_tfidf_top_matches_plain_vectors(spark):
    texts = {1: "red apple pie", 2: "green apple", 3: "apple apple pie crust", 4: "", 5: None, 6: "blue sky"}
    df = spark.createDataFrame(list(texts.items()), "path long, text string")
    found = {r.path: r.cosine for r in charts.tfidf_top(df, "Apple pie!", 10, features=1 << 40).collect()}

    def grams(t):
        w = (t or "").split()
        return Counter(w + [" ".join(p) for p in zip(w, w[1:], strict=False)])

    bags = {k: grams(t) for k, t in texts.items()}
    idf = {g: math.log((1 + len(texts)) / (1 + sum(g in b for b in bags.values()))) + 1 for b in bags.values() for g in b}
    q = {g: n * idf[g] for g, n in grams("apple pie").items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for k, b in bags.items():
        v = {g: n * idf[g] for g, n in b.items()}
        dot = sum(v[g] * q.get(g, 0) for g in v)
        assert (k in found) == (dot > 0) and (not dot or math.isclose(found[k], dot / norm(v) / norm(q), abs_tol=2e-6))
    assert charts.tfidf_top(df, "", 3).count() == 0 and charts.tfidf_top(df.limit(0), "apple", 3).count() == 0


def test_mixed_types_of_variants(spark):
    df = spark.createDataFrame([("1",), ('"a"',), (None,), ("2",)], "j string").select(F.parse_json("j").alias("v"), F.parse_json(F.lit("1")).alias("w"), F.lit(1).alias("n"))
    found = quality.mixed_types(df).collect()
    assert [(r.column, r.rows) for r in found] == [("v", 3)] and len(found[0].types) == 2
    assert quality.mixed_types(df.select("n")).count() == 0
