"""Univariate statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import special as S
from . import profile as P
from .ranks import cells, cumulative, exact_quantiles, keyed


def skew_label(x: Column) -> Column:
    return F.when(F.abs(x) < 0.5, "approximately_symmetric").when(F.abs(x) < 1, "moderately_skewed").otherwise("highly_skewed")


def kurtosis_label(x: Column) -> Column:
    return F.when(x > 1, "leptokurtic").when(x < -1, "platykurtic").otherwise("mesokurtic")


def outlier_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n, iqr_outliers, z_outliers, mad_outliers): beyond 1.5 IQR, 3 deviations, 3.5 scaled MADs; 0 below three values."""
    schema = "column string, n long, iqr_outliers long, z_outliers long, mad_outliers long"
    columns = [X.finite(df, n) for n in names]
    first = exact_quantiles(df, columns, [0.25, 0.5, 0.75], [F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")]) if names else []
    far = [F.abs(c - F.lit(f["quantiles"][1])) if f["quantiles"] else F.lit(None).cast("double") for c, f in zip(columns, first, strict=True)]
    second = exact_quantiles(df, far, [0.5]) if names else []
    rows = []
    for k, (f, m) in enumerate(zip(first, second, strict=True)):
        if f["n"] >= 3:
            q, mad = f["quantiles"], m["quantiles"][0]
            gap, deviation = 1.5 * (q[2] - q[0]), f["std"] if f["std"] else None
            rows.append((k, q[0] - gap, q[2] + gap, f["mean"], deviation, q[1], 1.4826 * mad if mad else None))
    counts = {}
    if rows:
        table = keyed(df.sparkSession, rows, "k int, lo double, hi double, mean double, std double, mid double, mad double")
        x = F.col("x")
        hits = lambda test, name: F.sum(F.coalesce(test, F.lit(False)).cast("int")).alias(name)
        tests = ((x < F.col("lo")) | (x > F.col("hi")), F.abs((x - F.col("mean")) / F.col("std")) > 3, F.abs(x - F.col("mid")) / F.col("mad") > 3.5)
        found = cells(df, columns).join(table, "k").groupBy("k").agg(*[hits(t, n) for t, n in zip(tests, ("iqr", "z", "robust"), strict=True)])
        counts = {r["k"]: r for r in found.collect()}
    out = [(n, f["n"], *((counts[k]["iqr"], counts[k]["z"], counts[k]["robust"]) if k in counts else (0, 0, 0))) for k, (n, f) in enumerate(zip(names, first, strict=True))]
    return df.sparkSession.createDataFrame(out, schema)


def mean_interval(df: DataFrame, names: list[str], confidence: float = 0.95) -> DataFrame:
    """(column, n, mean, low, high) by Student's t."""
    row = df.agg(*[F.count(X.finite(df, n)).alias(str(k)) for k, n in enumerate(names)]).first()
    parts = []
    for k, n in enumerate(names):
        x = X.finite(df, n)
        t = S.t_ppf(0.5 + confidence / 2, row[k] - 1) if row[k] > 1 else float("nan")
        half = t * F.stddev_samp(x) / F.sqrt(F.count(x))
        parts.append(F.struct(F.lit(n).alias("column"), F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.avg(x) - half, 4).alias("low"), F.round(F.avg(x) + half, 4).alias("high")))
    return df.agg(F.array(*parts).alias("cells")).select(F.inline("cells"))


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, n, upto): distinct finite values with cumulative counts."""
    return cumulative(df.select(X.finite(df, column).alias("value")), "value", {"n": F.count(F.lit(1))}).select("value", "n", F.col("upto_n").alias("upto"))


def median_interval(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    """(n, median, low, high) by order statistics at binomial ranks."""
    n = df.select(F.count(X.finite(df, column))).first()[0]
    lo = max(S.binomial_ppf((1 - confidence) / 2, n, 0.5), 1) if n else 1
    hi = n - lo + 1
    ranks = value_ranks(df, column)
    at = lambda r: F.min(F.when(F.col("upto") >= r, F.col("value")))
    mid = (at((n + 1) // 2) + at(n // 2 + 1)) / 2
    return ranks.agg(F.lit(n).cast("long").alias("n"), mid.alias("median"), at(lo).alias("low"), at(hi).alias("high"))


def entropy(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, distinct, entropy, entropy_ratio) in bits; null is a category."""
    freq = P.frequencies(df, names)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("column"))
    bits = freq.select("column", "value", share.alias("p"))
    e, k = -F.sum(F.col("p") * F.log2("p")), F.count(F.lit(1))
    return bits.groupBy("column").agg(F.count("value").alias("distinct"), F.round(e, 6).alias("entropy"), F.round(F.when(k > 1, e / F.log2(k)).otherwise(0.0), 6).alias("entropy_ratio"))


def dagostino(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n, statistic, p_value, normal): D'Agostino's K squared from the moments alone; null below 20 values."""
    row = df.agg(*[F.struct(F.count(x), F.skewness(x), F.kurtosis(x)).alias(str(k)) for k, x in enumerate(X.finite(df, n) for n in names)]).first()
    out = []
    for k, name in enumerate(names):
        n, g1, g2 = row[k]
        if n < 20 or g1 is None or math.isnan(g1):
            out.append((name, n, None, None, None))
            continue
        y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
        b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = math.sqrt(2 * (b2 - 1)) - 1
        z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
        mean, var = -6 / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
        x = (g2 - mean) / math.sqrt(var)
        root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
        cube = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
        z2 = (1 - 2 / (9 * a) - math.copysign(abs(cube) ** (1 / 3), cube)) / math.sqrt(2 / (9 * a))
        k2 = z1 * z1 + z2 * z2
        p = S.chi2_sf(k2, 2)
        out.append((name, n, k2, p, p >= 0.05))
    return df.sparkSession.createDataFrame(out, "column string, n long, statistic double, p_value double, normal boolean")


def shapiro(df: DataFrame, names: list[str], most: int = 5_000) -> DataFrame:
    """(column, n, statistic, p_value, normal): Shapiro and Wilk's W by Royston's approximation, for 4 to `most` values; else null."""
    out = []
    sizes = df.agg(*[F.count(X.finite(df, n)) for n in names]).first() if names else []
    for name, n in zip(names, sizes, strict=True):
        if not 4 <= n <= most:
            out.append((name, n, None, None, None))
            continue
        x = np.sort([r[0] for r in df.select(X.finite(df, name).alias("x")).where("x is not null").collect()])
        w, p = shapiro_wilk(x)
        out.append((name, n, w, p, None if p is None else p >= 0.05))
    return df.sparkSession.createDataFrame(out, "column string, n long, statistic double, p_value double, normal boolean")


def shapiro_wilk(x: np.ndarray) -> tuple[float | None, float | None]:
    """(W, p) of sorted values; null without spread."""
    n = len(x)
    spread = ((x - x.mean()) ** 2).sum()
    if spread <= 0:
        return None, None
    m = np.array([S.normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, u = float(m @ m), n**-0.5
    a = m / math.sqrt(total)
    last = a[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
    ends = [last]
    if n > 5:
        ends.append(a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u))
    k = len(ends)
    phi = (total - 2 * sum(v * v for v in m[-k:])) / (1 - 2 * sum(v * v for v in ends))
    a = m / math.sqrt(phi)
    for i, v in enumerate(ends):
        a[-1 - i], a[i] = v, -v
    w = min(1.0, float((a @ x) ** 2 / spread))
    if w >= 1 - 1e-12:
        return w, 1.0
    if n >= 12:
        y, log = math.log(1 - w), math.log(n)
        mean, deviation = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log))
    else:
        edge = 0.459 * n - 2.273
        if math.log(1 - w) >= edge:
            return w, 0.0
        y = -math.log(edge - math.log(1 - w))
        mean, deviation = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    return w, float(1 - S.normal_cdf((y - mean) / deviation))


def triage(facts, names: list[str], most: int) -> list[str]:
    """The `most` columns that deserve deep statistics, in table order: skewed, heavy-tailed, gappy or varied ones first."""

    def interest(n: str) -> float:
        f, c = facts.numeric[n], facts.columns[n]
        if not f["std"]:
            return -1.0
        gaps, varied = c["missing"] / max(1, facts.rows), c["distinct"] / max(1, c["filled"])
        return min(3.0, abs(f["skewness"] or 0.0)) + min(3.0, abs(f["kurtosis"] or 0.0) / 3) + 2 * gaps + varied

    best = set(sorted(names, key=lambda n: (-interest(n), n))[:most])
    return [n for n in names if n in best]


FITS = ("norm", "expon", "lognorm", "gamma", "weibull_min", "beta")


def distribution_fit(df: DataFrame, names: list[str], kinds: tuple[str, ...] = FITS) -> DataFrame:
    """(column, distribution, aic) of maximum-likelihood fits with two parameters each, for 30 values or more.

    All follow from sums over all rows: normal, exponential, log-normal and gamma from one scan, Weibull from one scan a
    Newton step for all columns together, beta (for values strictly between 0 and 1) from mean logarithms.
    """
    schema = "column string, distribution string, aic double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    x = F.col("x")
    at = cells(df, [X.finite(df, n) for n in names])
    log, rest = F.when(x > 0, F.ln(x)), F.when((x > 0) & (x < 1), F.ln(1 - x))
    sums = at.groupBy("k").agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(log).alias("lm"), F.stddev_pop(log).alias("ls"), F.avg(rest).alias("lr"))
    rows = {r["k"]: r for r in sums.collect() if r["n"] >= 30 and r["s"]}
    positive = {k: r for k, r in rows.items() if r["lo"] > 0}
    shapes = _weibull_shapes(at, positive) if "weibull_min" in kinds else {}
    out = []
    for k, r in rows.items():
        n, m, s, lo, lm = (r[c] for c in ("n", "m", "s", "lo", "lm"))
        fits = {"norm": n * math.log(2 * math.pi * s * s) + n + 4}
        if m > lo:
            fits["expon"] = 2 * n * (1 + math.log(m - lo)) + 4
        if k in positive and r["ls"]:
            fits["lognorm"] = n * math.log(2 * math.pi * r["ls"] ** 2) + n + 2 * n * lm + 4
            a = S.inverse_digamma_gap(math.log(m) - lm)
            fits["gamma"] = 4 - 2 * n * ((a - 1) * lm - a - a * math.log(m / a) - math.lgamma(a))
            if k in shapes:
                c, scale = shapes[k]
                fits["weibull_min"] = 4 - 2 * n * (math.log(c) - c * math.log(scale) + (c - 1) * lm - 1)
        if lo > 0 and r["hi"] < 1:
            a, b = S.beta_shapes(lm, r["lr"], m, s * s)
            fits["beta"] = 4 - 2 * n * ((a - 1) * lm + (b - 1) * r["lr"] - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))
        out += [(names[k], d, fits[d]) for d in kinds if d in fits and math.isfinite(fits[d])]
    return df.sparkSession.createDataFrame(out, schema).withColumn("aic", F.round("aic", 4))


def _weibull_shapes(at: DataFrame, rows: dict, steps: int = 12) -> dict[int, tuple[float, float]]:
    """(shape, scale) of each column by Newton steps, one scan a step for all columns that have not settled."""
    shape = {k: 1.2 / r["ls"] for k, r in rows.items() if r["ls"]}
    scale, open_ = dict.fromkeys(shape, 1.0), set(shape)
    for _ in range(steps):
        if not open_:
            break
        table = keyed(at.sparkSession, [(k, shape[k], rows[k]["lm"]) for k in sorted(open_)], "k int, c double, lm double")
        # logarithms are taken about their mean, so that powers neither overflow nor vanish
        z = F.ln("x") - F.col("lm")
        power = F.exp(F.col("c") * z)
        sums = at.where("x > 0").join(table, "k").groupBy("k").agg(F.avg(power).alias("p"), F.avg(power * z).alias("q"), F.avg(power * z * z).alias("r")).collect()
        for row in sums:
            k, c = row["k"], shape[row["k"]]
            gap = row["q"] / row["p"] - 1 / c
            slope = (row["r"] * row["p"] - row["q"] ** 2) / row["p"] ** 2 + 1 / c**2
            new = max(c / 3, min(3 * c, c - gap / slope))
            scale[k] = math.exp(rows[k]["lm"]) * row["p"] ** (1 / c)
            if abs(new - c) <= 1e-9 * c:
                open_.discard(k)
            shape[k] = new
    return {k: (shape[k], scale[k]) for k in shape}


def bootstrap_interval(df: DataFrame, names: list[str], order: list[str], resamples: int = 999, most: int = 2_000, seed: int = 42) -> DataFrame:
    """(column, n, mean, low, high): BCa intervals of the mean on a bounded deterministic sample."""
    from .sampling import sample_rows

    sample = X.unpivot(sample_rows(df, order, most), names, as_text=False).where("value is not null")

    def one(rows):
        import pandas as pd

        x = np.sort(rows["value"].to_numpy())
        n = len(x)
        rng = np.random.default_rng(seed)
        means = np.sort(x[rng.integers(0, n, (resamples, n))].mean(1))
        below = np.clip((means < x.mean()).mean(), 1e-6, 1 - 1e-6)
        z0 = S.normal_ppf(float(below))
        jack = (x.sum() - x) / max(1, n - 1)
        d = jack.mean() - jack
        accel = (d**3).sum() / (6 * ((d**2).sum() ** 1.5 or 1))
        ends = []
        for q in (0.025, 0.975):
            z = z0 + S.normal_ppf(q)
            ends.append(float(np.quantile(means, S.normal_cdf(z0 + z / (1 - accel * z)))))
        return pd.DataFrame([(rows["column"].iloc[0], n, float(x.mean()), *ends)], columns=["column", "n", "mean", "low", "high"])

    return sample.groupBy("column").applyInPandas(one, "column string, n long, mean double, low double, high double")


def anderson_normal(df: DataFrame, column: str) -> DataFrame:
    """(n, statistic, normal): Anderson-Darling distance to the fitted normal, from distinct values and their ranks."""
    row = df.agg(F.count(X.finite(df, column)), F.avg(X.finite(df, column)), F.stddev_samp(X.finite(df, column))).first()
    n, mean, std = row
    ranks = value_ranks(df, column)
    z = (F.col("value") - mean) / F.lit(std)
    # the normal distribution function by a rational approximation of erfc, accurate to 1.2e-7
    t = 1 / (1 + 0.5 * F.abs(z / math.sqrt(2)))
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = c + t * poly
    tail = t * F.exp(-(z * z) / 2 - 1.26551223 + t * poly) / 2
    cdf = F.when(z >= 0, 1 - tail).otherwise(tail)
    upto, from_ = F.col("upto").cast("double"), (F.col("upto") - F.col("n")).cast("double")
    left = (upto * upto - from_ * from_) * F.log(F.greatest(cdf, F.lit(1e-300)))
    back, fore = F.lit(float(n)) - from_, F.lit(float(n)) - upto
    right = (back * back - fore * fore) * F.log(F.greatest(1 - cdf, F.lit(1e-300)))
    return ranks.agg(F.lit(n).cast("long").alias("n"), F.round(-F.lit(float(n)) - F.sum(left + right) / n, 4).alias("statistic")).withColumn("normal", F.col("statistic") * (1 + 0.75 / n + 2.25 / n**2) < 0.752)


def column_statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """numeric_summary with labels of shape."""
    return P.numeric_summary(df, names, digits=6).withColumns({"skew_label": skew_label(F.col("skewness")), "kurtosis_label": kurtosis_label(F.col("kurtosis"))})
