"""The anomaly ensemble: models fitted on a bounded deterministic sample, every row scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from .ranks import exact_quantiles
from .sketches import reservoir

#: Rows that a model is fitted on at most, and columns that take part at most.
SAMPLE, COLUMNS = 4_096, 30
Scorer = Callable[[np.ndarray], np.ndarray]


def standardised(df: DataFrame, names: list[str], keys: list[str], max_columns: int = COLUMNS) -> tuple[DataFrame, list[str]]:
    """(keys and array `x`; names used): finite values with medians for gaps, shifted and scaled; constant and empty columns are left out."""
    found = exact_quantiles(df, [X.finite(df, n) for n in names], [0.5], [F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")]) if names else []
    facts = [(f["quantiles"] and f["quantiles"][0], f.get("mean"), f.get("spread"), f["n"]) for f in found]
    rows = df.count() if names else 0
    parts, used = [], []
    for (median, mean, spread, filled), n in zip(facts, names, strict=True):
        if filled and spread and len(used) < max_columns:
            # the gaps filled with the median move mean and deviation
            centre = (mean * filled + median * (rows - filled)) / rows
            scale = ((filled * (spread**2 + (mean - centre) ** 2) + (rows - filled) * (median - centre) ** 2) / rows) ** 0.5
            parts.append((F.coalesce(X.finite(df, n), F.lit(median)) - centre) / scale)
            used.append(n)
    return df.select(*keys, F.array(*parts).cast("array<double>").alias("x")), used


def lof_scorer(sample: np.ndarray, neighbours: int | None = None, block: int = 512) -> Scorer:
    """Local outlier factor against the sample; a row of the sample does not count as its own neighbour."""
    n = len(sample)
    k = min(neighbours or min(20, max(5, n // 20)), n - 1)
    if k < 1:
        return lambda x: np.ones(len(x))
    squares = (sample**2).sum(1)

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.sqrt(np.maximum((x**2).sum(1)[:, None] + squares - 2 * x @ sample.T, 0))
        far[far < 1e-7] = 0
        at = np.argpartition(far, k, axis=1)[:, : k + 1]
        near = np.take_along_axis(far, at, 1)
        order = np.argsort(near, axis=1, kind="stable")
        at, near = np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)
        own = near[:, 0] == 0
        return np.where(own[:, None], at[:, 1:], at[:, :k]), np.where(own[:, None], near[:, 1:], near[:, :k])

    def in_blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [nearest(x[lo : lo + block]) for lo in range(0, len(x), block)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    at, near = in_blocks(sample)
    reach = near[:, -1]
    density = 1 / (np.maximum(near, reach[at]).mean(1) + 1e-10)

    def score(x: np.ndarray) -> np.ndarray:
        at, near = in_blocks(x)
        return density[at].mean(1) * (np.maximum(near, reach[at]).mean(1) + 1e-10)

    return score


def robust_covariance(sample: np.ndarray, starts: int = 30, steps: int = 20, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the half of the sample whose covariance has the least determinant found.

    From random starts, each step keeps the rows nearest to the last estimate, which never raises the determinant. The
    covariance is scaled so that the median squared distance is the chi-squared median. Too few rows give the plain one.
    """
    n, p = sample.shape
    half = (n + p + 1) // 2
    plain = sample.mean(0), np.atleast_2d(np.cov(sample, rowvar=False)) if n > 1 else np.eye(p)
    if n <= 2 * p + 1:
        return plain
    rng, best = np.random.default_rng(seed), (np.inf, *plain)

    def far(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        d = sample - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d)

    for _ in range(starts):
        rows = rng.choice(n, p + 1, replace=False)
        mean, cov = sample[rows].mean(0), np.atleast_2d(np.cov(sample[rows], rowvar=False))
        last = np.inf
        for _ in range(steps):
            rows = np.argsort(far(mean, cov), kind="stable")[:half]
            mean, cov = sample[rows].mean(0), np.atleast_2d(np.cov(sample[rows], rowvar=False))
            size = np.linalg.slogdet(cov + 1e-9 * np.eye(p))[1]
            if size >= last - 1e-9:
                break
            last = size
        if last < best[0]:
            best = last, mean, cov
    _, mean, cov = best
    middle = p * (1 - 2 / (9 * p)) ** 3  # the chi-squared median, by the cube-root rule
    ratio = float(np.median(far(mean, cov))) / middle
    return mean, cov * ratio if ratio > 0 else cov


def robust_distance_scorer(sample: np.ndarray) -> Scorer:
    """Mahalanobis distance by the minimum covariance determinant."""
    mean, cov = robust_covariance(sample)
    inverse = np.linalg.pinv(cov)
    return lambda x: np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean), 0))


def copula_scorer(sample: np.ndarray) -> Scorer:
    """Empirical copula tails: the larger of the left, right and skewness-corrected sums of negative log shares."""
    ordered, n = np.sort(sample, axis=0), len(sample)
    skew = ((sample - sample.mean(0)) ** 3).mean(0)

    def score(x: np.ndarray) -> np.ndarray:
        left, right = np.empty_like(x), np.empty_like(x)
        for d in range(x.shape[1]):
            left[:, d] = -np.log(np.maximum(np.searchsorted(ordered[:, d], x[:, d], "right"), 0.5) / n)
            right[:, d] = -np.log(np.maximum(n - np.searchsorted(ordered[:, d], x[:, d], "left"), 0.5) / n)
        fair = np.where(skew < 0, left, right)
        return np.maximum(np.maximum(left.sum(1), right.sum(1)), fair.sum(1))

    return score


def mad_scorer(sample: np.ndarray) -> Scorer:
    middle = np.median(sample, axis=0)
    spread = 1.4826 * np.median(np.abs(sample - middle), axis=0)
    spread = np.where(spread > 0, spread, np.maximum(sample.std(0), 1e-12))
    return lambda x: np.abs((x - middle) / spread).mean(1)


def reconstruction_scorer(sample: np.ndarray, epochs: int = 35, rate: float = 0.01, batch: int = 64, seed: int = 42) -> Scorer:
    """Mean squared error of an autoencoder with one narrow tanh layer, fitted by Adam."""
    n, p = sample.shape
    narrow, rng = max(1, p // 2), np.random.default_rng(seed)
    weights = [rng.normal(0, p**-0.5, (p, narrow)), np.zeros(narrow), rng.normal(0, narrow**-0.5, (narrow, p)), np.zeros(p)]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    clipped = np.clip(sample, -10, 10)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            x = clipped[order[lo : lo + batch]]
            hidden = np.tanh(x @ weights[0] + weights[1])
            error = 2 * (hidden @ weights[2] + weights[3] - x) / x.size
            back = error @ weights[2].T * (1 - hidden**2)
            t += 1
            for k, g in enumerate((x.T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return lambda x: ((np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3] - x) ** 2).mean(1)


SCORERS = {"lof": lof_scorer, "mcd": robust_distance_scorer, "mad": mad_scorer, "copod": copula_scorer, "reconstruction": reconstruction_scorer}


def detector_scores(df: DataFrame, names: list[str], keys: list[str], detectors: tuple[str, ...] = tuple(SCORERS), sample_rows: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """(keys, x, one score a detector; names used) of every row; the models are fitted on at most sample_rows rows."""
    frame, used = standardised(df, names, keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema)
    schema = f"{kinds}, x array<double>, " + ", ".join(f"{n} double" for n in detectors)
    sample = np.array([r[0] for r in reservoir(frame.select("x"), ["x"], sample_rows).collect()], float) if used else np.zeros((0, 0))
    if not len(sample):
        return df.sparkSession.createDataFrame([], schema), used
    scorers = {n: SCORERS[n](sample) for n in detectors}

    def score(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), len(used))
            yield pdf.assign(**{n: f(x) if len(x) else np.zeros(0) for n, f in scorers.items()})

    return frame.mapInPandas(score, schema), used


def ensemble(df: DataFrame, names: list[str], keys: list[str], contamination: float = 0.05, detectors: tuple[str, ...] = tuple(SCORERS), top_k: int = 25, sample_rows: int = SAMPLE) -> DataFrame:
    """(keys, scores, score, votes, consensus, drivers) of the top_k rows by mean score.

    Each detector's score is scaled to 0..1 by its range. A detector votes for the rows at or above its own
    (1 - contamination) quantile; consensus is a majority of votes. drivers are the three columns whose standardised
    values lie farthest out. Missing values count as the median; without a usable column there are no rows.
    """
    scored, used = detector_scores(df, names, keys, detectors, sample_rows)
    aggs = [F.struct(F.min(n), F.max(n), F.percentile_approx(n, 1 - contamination, 10_000)).alias(n) for n in detectors]
    ends = scored.agg(*aggs).first()
    unit, votes = [], F.lit(0)
    for n in detectors:
        low, high, limit = ends[n]
        wide = low is not None and high > low
        unit.append(((F.col(n) - low) / (high - low) if wide else F.lit(0.0)).alias(n))
        votes = votes + (F.col(n) >= F.lit(limit)).cast("int") if wide else votes
    ranked = F.reverse(F.array_sort(F.zip_with(F.transform("x", F.abs), F.array(*map(F.lit, used)).cast("array<string>"), lambda z, n: F.struct(z.alias("z"), n.alias("column")))))
    total = F.lit(0.0)
    for n in detectors:
        total = total + F.col(f"scores.{n}")
    return (
        scored.select(*keys, F.struct(*unit).alias("scores"), votes.alias("votes"), F.transform(F.slice(ranked, 1, 3), lambda r: r.column).alias("drivers"))
        .withColumn("score", F.round(total / len(detectors), 6))
        .withColumn("consensus", F.col("votes") * 2 > len(detectors))
        .select(*keys, "scores", "score", "votes", "consensus", "drivers")
        .orderBy(F.desc("score"), *keys)
        .limit(top_k)
    )
