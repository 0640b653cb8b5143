"""Row anomalies by column algebra; only medians, deviations and thresholds are computed apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from .ranks import cumulative, exact_quantiles


#: Cells of a projection's histogram on either side of its median.
CELLS = 200


def robust_scales(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(median, scale) of each usable column: 1.4826 MAD, else the deviation; constants are left out."""
    columns = [X.finite(df, n) for n in names]
    first = exact_quantiles(df, columns, [0.5], [F.stddev_samp("x").alias("std")]) if names else []
    usable = [k for k, f in enumerate(first) if f["quantiles"] and f["std"]]
    second = exact_quantiles(df, [F.abs(columns[k] - F.lit(first[k]["quantiles"][0])) for k in usable], [0.5]) if usable else []
    return {names[k]: (first[k]["quantiles"][0], 1.4826 * s["quantiles"][0] or first[k]["std"]) for k, s in zip(usable, second, strict=True)}


def robust_z(df: DataFrame, names: list[str]) -> list[Column]:
    """Absolute robust z of each usable column; missing values count as the median."""
    return [F.coalesce(F.abs((X.finite(df, n) - m) / s), F.lit(0.0)) for n, (m, s) in robust_scales(df, names).items()]


def mad_scores(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, score): the mean absolute robust z."""
    z = robust_z(df, names)
    total = z[0]
    for x in z[1:]:
        total = total + x
    return df.select(*keys, F.round(total / len(z), 6).alias("score"))


def top3_scores(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, score): the mean of a row's three largest absolute robust z."""
    z = F.sort_array(F.array(*robust_z(df, names)), False)
    part = F.slice(z, 1, 3)
    return df.select(*keys, F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part), 6).alias("score"))


def fast_scan(df: DataFrame, names: list[str], keys: list[str], contamination: float = 0.05, projections: int = 12, max_columns: int | None = None, top_k: int = 25, seed: int = 42) -> DataFrame:
    """(keys, top3, tail, rarity, score, flagged): an ensemble of the three largest deviations, sparse random projections and rarity.

    Each projection is a literal linear expression over all columns, or the first max_columns; its histogram, in cells of
    half a robust deviation out to CELLS / 2 deviations, is the only thing grouped, and values beyond are as rare as a
    single row. Scores are scaled to 0..1 by their range, and the share `contamination` with the largest scores is
    flagged; the top_k of them are returned.
    """
    scales = robust_scales(df, names[:max_columns])
    if not scales:
        return df.select(*keys, *[F.lit(0.0).alias(c) for c in ("top3", "tail", "rarity", "score")], F.lit(False).alias("flagged")).orderBy(*keys).limit(top_k)
    z = [F.coalesce((X.finite(df, n) - m) / s, F.lit(0.0)) for n, (m, s) in scales.items()]
    rng = np.random.default_rng(seed)
    weights = rng.choice([-1.0, 0.0, 1.0], (projections, len(z)), p=[1 / 6, 2 / 3, 1 / 6])
    weights[np.arange(projections), rng.integers(0, len(z), projections)] = 1.0
    top = F.slice(F.sort_array(F.array(*[F.abs(x) for x in z]), False), 1, 3)
    base = df.select(*keys, (F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).alias("top3"), F.array(*z).alias("z"))
    lines = [F.aggregate(F.zip_with("z", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / float(np.abs(w).sum() ** 0.5) for w in weights]
    projected = base.select(*keys, "top3", F.array(*lines).alias("p"))
    tail = F.aggregate("p", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    cells = projected.select(F.posexplode("p").alias("k", "v")).groupBy("k", F.floor(F.col("v") * 2).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    rows = df.count()
    counts = {(r["k"], r["cell"]): r["n"] for r in cells.where(F.abs("cell") <= CELLS).collect()}
    # one array a projection, so that a row's cell is found by its number; cells that no row fills are never asked for
    far = float(np.log(max(rows, 2)))
    table = ", ".join("array(" + ", ".join(f"{far if (k, c) not in counts else -float(np.log(counts[k, c] / rows))!r}D" for c in range(-CELLS, CELLS + 1)) + ")" for k in range(projections))
    spread = projected.withColumn("table", F.expr(f"array({table})"))
    cell = lambda v: F.floor(v * 2).cast("int") + CELLS
    rarity = F.transform("p", lambda v, k: F.when(F.abs(v) <= CELLS / 2 - 1, F.get(F.get("table", k), cell(v))).otherwise(far))
    projected = spread.select(*keys, "top3", "p", (F.aggregate(rarity, F.lit(0.0), lambda a, x: a + x) / projections).alias("rare"))
    rare = F.col("rare")
    scored = projected.select(*keys, "top3", tail.alias("tail"), rare.alias("rarity"))
    ends = scored.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("top3", "tail", "rarity") for f in (F.min, F.max)]).first()
    unit = lambda c: (F.col(c) - ends[f"min_{c}"]) / (ends[f"max_{c}"] - ends[f"min_{c}"]) if ends[f"max_{c}"] > ends[f"min_{c}"] else F.lit(0.0)
    final = scored.withColumn("score", 0.5 * unit("top3") + 0.35 * unit("tail") + 0.15 * unit("rarity"))
    limit = final.agg(F.percentile_approx("score", 1 - contamination, 10_000)).first()[0]
    return final.withColumn("flagged", F.col("score") >= F.lit(limit)).orderBy(F.desc("score"), *keys).limit(top_k)


def mahalanobis(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, distance) with the covariance of one pass; rows with a missing value take its mean."""
    x = [X.finite(df, n) for n in names]
    k = len(names)
    row = df.agg(*[F.avg(c) for c in x], *[F.covar_samp(x[i], x[j]) for i in range(k) for j in range(i, k)]).first()
    mean, cov, at = row[:k], np.zeros((k, k)), k
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = row[at] or 0.0
            at += 1
    inverse = np.linalg.pinv(cov)
    d = [F.coalesce(c - m, F.lit(0.0)) for c, m in zip(x, mean, strict=True)]
    total = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            total = total + d[i] * d[j] * float(inverse[i, j])
    return df.select(*keys, F.round(F.sqrt(F.greatest(total, F.lit(0.0))), 6).alias("distance"))


def ecod_scores(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, score): over all columns the largest of the left, right and skewness-chosen sums of negative log tail shares.

    A value's left share is that of the values up to it, its right share that of the values from it on, both exact, from
    cumulative counts of distinct values. A row's missing values add nothing.
    """
    x = [X.finite(df, n) for n in names]
    row = df.agg(*[f(c) for c in x for f in (F.count, F.skewness)]).first()
    out = df.select(*keys, *[c.alias(f"_x{k}") for k, c in enumerate(x)])
    left = right = fair = F.lit(0.0)
    for k in range(len(names)):
        n, skew = row[2 * k], row[2 * k + 1]
        if not n:
            continue
        tails = cumulative(out.select(f"_x{k}"), f"_x{k}", {"n": F.count(F.lit(1))})
        below, above = -F.log(F.col("upto_n") / n), -F.log((F.lit(n) - F.col("upto_n") + F.col("n")) / n)
        out = out.join(tails.select(f"_x{k}", below.alias(f"_l{k}"), above.alias(f"_r{k}")), f"_x{k}", "left")
        low, high = F.coalesce(f"_l{k}", F.lit(0.0)), F.coalesce(f"_r{k}", F.lit(0.0))
        left, right = left + low, right + high
        fair = fair + (low if skew is not None and skew < 0 else high)
    return out.select(*keys, F.round(F.greatest(left, right, fair), 6).alias("score"))


def isolation_scores(df: DataFrame, names: list[str], keys: list[str], trees: int = 100, size: int = 256, seed: int = 42) -> DataFrame:
    """(keys, score) of an isolation forest: trees grow on the driver from a bounded reservoir, all rows are scored in Arrow batches."""
    from .sketches import reservoir

    values = df.select(*keys, *[F.coalesce(X.finite(df, n), F.lit(0.0)).alias(f"_x{k}") for k, n in enumerate(names)])
    cols = [f"_x{k}" for k in range(len(names))]
    sample = np.array(reservoir(values.select(*cols), cols, 4_096).collect(), float).reshape(-1, len(cols))
    rng, depth = np.random.default_rng(seed), int(np.ceil(np.log2(max(2, size))))

    def mean_path(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(rows, level):
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(len(cols))
        if level >= depth or len(rows) <= 1 or not spread.any():
            return level + mean_path(len(rows))
        k = rng.choice(np.flatnonzero(spread > 0))
        at = rng.uniform(rows[:, k].min(), rows[:, k].max())
        left = rows[:, k] < at
        return int(k), float(at), grow(rows[left], level + 1), grow(rows[~left], level + 1)

    forest = [grow(sample[rng.choice(len(sample), min(size, len(sample)), replace=False)], 0) for _ in range(trees)] if len(sample) else []
    norm = mean_path(min(size, max(2, len(sample)))) or 1.0

    def walk(node, x, out, at):
        if not isinstance(node, tuple):
            out[at] += node
            return
        k, cut, left, right = node
        low = x[at, k] < cut
        if low.any():
            walk(left, x, out, at[low])
        if not low.all():
            walk(right, x, out, at[~low])

    def score(batches):
        for pdf in batches:
            x, total = pdf[cols].to_numpy(float), np.zeros(len(pdf))
            for tree in forest:
                walk(tree, x, total, np.arange(len(pdf)))
            yield pdf[keys].assign(score=2 ** (-total / max(1, len(forest)) / norm))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return values.mapInPandas(score, f"{kinds}, score double")
