"""Time series and change detection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from .ranks import cumulative, exact_quantiles, places
from .roles import name_tokens

#: A whole-series algorithm gets at most so many points; longer series are averaged into as many tiles.
POINTS = 50_000
FREQUENCIES = ((1.5, "secondly"), (90, "minutely"), (5400, "hourly"), (129_600, "daily"), (864_000, "weekly"), (3_888_000, "monthly"), (10_368_000, "quarterly"), (40_000_000, "yearly"))
PERIODS = {"hourly": (4, 200), "daily": (2, 400), "weekly": (2, 60), "monthly": (2, 36)}


def parse_time(column: str, kind: T.DataType) -> Column:
    """A timestamp of typed dates, of text, or of epoch numbers, whose unit follows from their size."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
        return F.when(x.between(1e8, 1e11), F.timestamp_seconds(x.cast("long"))).when(x.between(1e11, 1e14), F.timestamp_millis(x.cast("long"))).when(x.between(1e14, 1e17), F.timestamp_micros(x.cast("long")))
    return F.expr(f"try_to_timestamp(cast(`{column}` as string))")


def date_scores(df: DataFrame, order: list[str]) -> list[tuple[str, float]]:
    """(column, score) of likely time columns: .6 share parsed, .3 share not falling in the given order, .1 by name."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.BooleanType, T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            continue
        ts = df.select(*[F.col(f"`{o}`").alias(f"_o{k}") for k, o in enumerate(order)], parse_time(f.name, f.dataType).alias("t")).limit(5_000)
        w = Window.orderBy(*[f"_o{k}" for k in range(len(order))])
        row = ts.withColumn("p", F.lag("t").over(w)).agg(F.avg(F.col("t").isNotNull().cast("int")), F.avg((F.col("t") >= F.col("p")).cast("int"))).first()
        if row[0] and row[0] >= 0.7:
            named = bool(name_tokens(f.name) & {"date", "time", "ts", "timestamp", "day", "month", "year", "created"})
            out.append((f.name, round(0.6 * row[0] + 0.3 * (row[1] or 0) + 0.1 * named, 4)))
    return sorted(out, key=lambda r: (-r[1], r[0]))


def gap_summary(df: DataFrame, ts: str) -> DataFrame:
    """(n, median_gap_seconds, frequency) between distinct timestamps, from the frequency table of timestamps."""
    # microseconds of this millennium and the next are exact as doubles
    at = df.select(F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).cast("double").alias("u"))
    gaps = cumulative(at, "u", {"n": F.count(F.lit(1))}).select(((F.col("next") - F.col("u")) / 1e6).alias("g"))
    found = exact_quantiles(gaps, [F.col("g")], [0.5])[0]
    mid = found["quantiles"][0] if found["quantiles"] else None
    label = next((name for bound, name in FREQUENCIES if mid is not None and mid <= bound), "irregular")
    stamps = found["n"] + 1 if found["n"] else int(at.where("u is not null").limit(1).count())
    return df.sparkSession.createDataFrame([(stamps, mid, label)], "n long, median_gap_seconds double, frequency string").withColumn("median_gap_seconds", F.round("median_gap_seconds", 3))


def regular_series(df: DataFrame, ts: str, value: str, grain: str = "day") -> DataFrame:
    """(t, y): means by calendar grain, so later steps see a bounded, ordered series."""
    x = X.finite(df, value)
    return df.select(F.date_trunc(grain, F.col(f"`{ts}`").cast("timestamp")).alias("t"), x.alias("y")).where("t is not null and y is not null").groupBy("t").agg(F.avg("y").alias("y"))


#: Positions of a series in one task's window.
BLOCK = 100_000


def positions(series: DataFrame) -> DataFrame:
    """(i, y) of a series (t, y): places from 1 in the order of t, and the mean of y where a t repeats."""
    # microseconds of this millennium and the next are exact as doubles
    at = series.select(F.unix_micros(F.col("t").cast("timestamp")).cast("double").alias("u"), "y").where("y is not null")
    return places(at, "u", {"y": F.avg("y")}).select(F.col("place").alias("i"), "y")


def autocorrelation(series: DataFrame, lags: int) -> DataFrame:
    """(lag, acf) of an ordered series (t, y): positions are dealt to blocks that also see the `lags` points after them."""
    mean, total = series.agg(F.avg("y"), F.var_pop("y") * F.count("y")).first()
    if not total:
        return series.sparkSession.createDataFrame([], "lag long, acf double")
    width = max(BLOCK, lags)
    place = F.col("i") - 1
    d = positions(series).select("i", (F.col("y") - mean).alias("d"), F.floor(place / width).alias("b"), (place % width < lags).alias("early"))
    near = d.withColumn("own", F.lit(True)).unionByName(d.where("early and b > 0").withColumn("b", F.col("b") - 1).withColumn("own", F.lit(False)))
    order = Window.partitionBy("b").orderBy("i")
    products = near.select("own", *[(F.col("d") * F.lead("d", k).over(order)).alias(f"l{k}") for k in range(1, lags + 1)]).where("own")
    sums = products.agg(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.sum(f"l{k}").alias("c")) for k in range(1, lags + 1)]).alias("cells")).select(F.inline("cells"))
    return sums.where("c is not null").select("lag", F.round(F.col("c") / F.lit(total), 6).alias("acf"))


def partial_autocorrelation(acf: list[float]) -> list[float]:
    """Levinson-Durbin over acf at lags 1, 2, …"""
    out, phi = [], []
    for k in range(1, len(acf) + 1):
        top = acf[k - 1] - sum(p * acf[k - 2 - j] for j, p in enumerate(phi))
        base = 1 - sum(p * acf[j] for j, p in enumerate(phi))
        new = top / base if base else 0.0
        phi = [p - new * q for p, q in zip(phi, phi[::-1], strict=True)] + [new]
        out.append(new)
    return out


def period_by_fft(y: np.ndarray, label: str = "daily") -> int | None:
    lo, hi = PERIODS.get(label, (2, max(2, len(y) // 2)))
    if len(y) < 8:
        return None
    t = np.arange(len(y))
    power = np.abs(np.fft.rfft(y - np.polyval(np.polyfit(t, y, 1), t))) ** 2
    freq = np.fft.rfftfreq(len(y))
    fits = (freq > 0) & (1 / np.maximum(freq, 1e-12) >= lo) & (1 / np.maximum(freq, 1e-12) <= min(hi, len(y) // 2))
    return int(round(1 / freq[fits][np.argmax(power[fits])])) if fits.any() and power[fits].max() > 0 else None


def _regress(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    s2 = e @ e / max(1, len(y) - x.shape[1])
    return b, np.sqrt(np.diag(np.linalg.pinv(x.T @ x)) * s2), e


def stationarity(y: np.ndarray) -> dict:
    """Augmented Dickey-Fuller and KPSS with constant, against the 5 % values of the published tables."""
    n = len(y)
    if n < 30:
        return {"available": False}
    lags = int(12 * (n / 100) ** 0.25)
    lags = min(lags, n // 3)
    d = np.diff(y)
    x = np.column_stack([np.ones(n - 1 - lags), y[lags:-1], *[d[lags - k : n - 1 - k] for k in range(1, lags + 1)]])
    b, se, _ = _regress(x, d[lags:])
    adf = float(b[1] / se[1]) if se[1] else 0.0
    e = y - y.mean()
    width = int(4 * (n / 100) ** 0.25)
    long_run = e @ e / n + 2 * sum((1 - k / (width + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, width + 1))
    kpss = float((np.cumsum(e) ** 2).sum() / n**2 / long_run) if long_run > 0 else 0.0
    root, level = adf < -2.86 - 2.738 / n - 8.36 / n**2, kpss < 0.463
    verdict = {(True, True): "stationary", (False, False): "non_stationary", (True, False): "difference_stationary", (False, True): "trend_stationary"}[(root, level)]
    return {"available": True, "adf": round(adf, 4), "kpss": round(kpss, 4), "verdict": verdict}


def decompose(y: np.ndarray, period: int, rounds: int = 2) -> dict:
    """Trend by local linear smoothing, season by smoothed subseries, with bisquare weights: strengths of both."""
    n, weights = len(y), np.ones(len(y))
    trend, season = np.zeros(n), np.zeros(n)

    def smooth(v: np.ndarray, w: np.ndarray, span: int) -> np.ndarray:
        out, half = np.empty(len(v)), max(2, span // 2)
        for i in range(len(v)):
            lo, hi = max(0, i - half), min(len(v), i + half + 1)
            t = np.arange(lo, hi) - i
            k = w[lo:hi] * (1 - (np.abs(t) / (half + 1)) ** 3) ** 3
            s0, s1, s2 = k.sum(), (k * t).sum(), (k * t * t).sum()
            det = s0 * s2 - s1 * s1
            m0, m1 = (k * v[lo:hi]).sum(), (k * t * v[lo:hi]).sum()
            out[i] = (s2 * m0 - s1 * m1) / det if abs(det) > 1e-12 else m0 / max(s0, 1e-12)
        return out

    for _ in range(rounds):
        trend = smooth(y - season, weights, max(7, int(1.5 * period) | 1))
        free = y - trend
        for k in range(period):
            part = np.arange(k, n, period)
            season[part] = smooth(free[part], weights[part], 7)
        season -= np.convolve(np.pad(season, period // 2, mode="edge"), np.ones(period) / period, "same")[period // 2 : period // 2 + n]
        rest = y - trend - season
        scale = 6 * np.median(np.abs(rest)) or 1.0
        weights = np.clip(1 - (rest / scale) ** 2, 0, 1) ** 2
    rest = y - trend - season
    share = lambda part: max(0.0, 1 - rest.var() / max((part + rest).var(), 1e-12))
    return {"trend_strength": round(float(share(trend)), 4), "seasonal_strength": round(float(share(season)), 4), "residual_std": round(float(rest.std()), 6)}


def holt_winters(y: np.ndarray, period: int, ahead: int) -> np.ndarray:
    """Additive forecasts with parameters from a coarse grid refined once."""

    def run(a: float, b: float, g: float, forecast: int) -> tuple[float, np.ndarray]:
        level, slope = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period
        season, loss = list(y[:period] - level), 0.0
        for i in range(period, len(y)):
            guess = level + slope + season[i % period]
            loss += (y[i] - guess) ** 2
            old = level
            level = a * (y[i] - season[i % period]) + (1 - a) * (level + slope)
            slope = b * (level - old) + (1 - b) * slope
            season[i % period] = g * (y[i] - level) + (1 - g) * season[i % period]
        return loss, np.array([level + (h + 1) * slope + season[(len(y) + h) % period] for h in range(forecast)])

    grid = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.01, 0.1, 0.3) for g in (0.05, 0.2, 0.5)]
    best = min(grid, key=lambda p: run(*p, 0)[0])
    near = [tuple(min(0.99, max(0.001, v * f)) for v, f in zip(best, fs, strict=True)) for fs in ((0.6, 1, 1), (1.5, 1, 1), (1, 0.5, 1), (1, 2, 1), (1, 1, 0.5), (1, 1, 2), (1, 1, 1))]
    return run(*min(near, key=lambda p: run(*p, 0)[0]), ahead)[1]


def forecast_errors(y: np.ndarray, period: int) -> dict:
    hold = max(period, len(y) // 5)
    if period < 2 or len(y) - hold < 2 * period + 2:
        return {"available": False}
    train, test = y[:-hold], y[-hold:]
    guess, naive = holt_winters(train, period, hold), np.resize(train[-period:], hold)
    err = lambda f: (round(float(np.abs(test - f).mean()), 6), round(float(np.sqrt(((test - f) ** 2).mean())), 6))
    (mae, rmse), (base_mae, base_rmse) = err(guess), err(naive)
    return {"available": True, "mae": mae, "rmse": rmse, "naive_mae": base_mae, "naive_rmse": base_rmse, "beats_naive": rmse < base_rmse}


def tiled(series: DataFrame, points: int = POINTS) -> DataFrame:
    """(t, y) with t the places of a series: as it is up to `points` points, longer ones averaged into as many tiles of equal size."""
    rows = series.where("y is not null").count()
    at = positions(series)
    if rows <= points:
        return at.select(F.col("i").alias("t"), "y")
    return at.groupBy(F.floor((F.col("i") - 1) * points / rows).alias("t")).agg(F.avg("y").alias("y"))


def whole_series(series: DataFrame, label: str = "daily") -> DataFrame:
    """(n, period, verdict, adf, kpss, trend_strength, seasonal_strength, mae, naive_mae) of one regular series of at most POINTS points, or tiles of a longer one."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("t")["y"].to_numpy()
        period = period_by_fft(y, label)
        s = stationarity(y)
        d = decompose(y, period) if period and len(y) >= 2 * period else {}
        f = forecast_errors(y, period or 0)
        return pd.DataFrame([(len(y), period, s.get("verdict"), s.get("adf"), s.get("kpss"), d.get("trend_strength"), d.get("seasonal_strength"), f.get("mae"), f.get("naive_mae"))], columns=["n", "period", "verdict", "adf", "kpss", "trend_strength", "seasonal_strength", "mae", "naive_mae"])

    return tiled(series).groupBy(F.lit(0).alias("_g")).applyInPandas(one, "n long, period long, verdict string, adf double, kpss double, trend_strength double, seasonal_strength double, mae double, naive_mae double")


def window_means(df: DataFrame, order: list[str], value: str, windows: int = 24) -> DataFrame:
    """(tile, n, mean) of contiguous windows of equal size in the given order, by position arithmetic instead of a global tile window."""
    from .sampling import with_row_number

    kept = df.select(*order, X.finite(df, value).alias("_y")).where("_y is not null")
    rows = with_row_number(kept, order)
    n = kept.agg(F.count(F.lit(1)).alias("total"))
    i, total = F.col("row_number"), F.col("total")
    size, extra = F.floor(total / windows), total % windows
    tile = F.when(i < extra * (size + 1), F.floor(i / (size + 1))).otherwise(extra + F.floor((i - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.crossJoin(F.broadcast(n)).groupBy((tile + 1).cast("long").alias("tile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_y"), 6).alias("mean"))


def page_hinkley(means: DataFrame, delta: float = 0.5, alpha: float = 0.995, threshold: float = 8.0, clip: float = 8.0, warmup: int = 8) -> DataFrame:
    """(updates, up, down, max_score, detected, direction, detected_at, sufficient) of a Page-Hinkley test folded over ordered means.

    Missing and infinite means are passed over. From the warmup-th mean on, its distance to the mean before it, in
    deviations of the means before it and clipped, is added to two sums with the drift delta and the forgetting factor
    alpha, neither of which falls below 0. Without spread so far a millionth of the mean is the scale. The first sum to
    reach the threshold sets direction and detected_at for good.
    """
    finite = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("tile", "mean"))), lambda s: s.mean), lambda y: y.isNotNull() & (F.abs(y) < float("inf")))
    ordered = means.agg(finite.alias("y"))
    zero = F.struct(*[F.lit(v).alias(k) for k, v in (("n", 0.0), ("m", 0.0), ("s", 0.0), ("u", 0.0), ("d", 0.0), ("top", 0.0), ("hit", 0.0), ("at", 0.0))])

    def step(a: Column, y: Column) -> Column:
        n, gap = a.n + 1, y - a.m
        sd = F.sqrt(F.greatest(a.s / F.greatest(a.n - 1, F.lit(1.0)), F.lit(0.0)))
        scale = F.when((a.n >= 2) & (sd > 1e-12), sd).otherwise(F.greatest(F.abs(a.m) * 1e-6, F.lit(1e-9)))
        r = F.greatest(F.lit(-clip), F.least(F.lit(clip), gap / scale))
        ready = n >= warmup
        up = F.when(ready, F.greatest(F.lit(0.0), alpha * a.u + r - delta)).otherwise(0.0)
        down = F.when(ready, F.greatest(F.lit(0.0), alpha * a.d - r - delta)).otherwise(0.0)
        score = F.greatest(up, down)
        new = (a.hit == 0) & ready & (score >= threshold)
        m = F.when(a.n == 0, y).otherwise(a.m + gap / n)
        s = F.when(a.n == 0, 0.0).otherwise(a.s + gap * (y - m))
        parts = (("n", n), ("m", m), ("s", s), ("u", up), ("d", down), ("top", F.greatest(a.top, score)), ("hit", F.when(new, F.when(up >= down, 1.0).otherwise(-1.0)).otherwise(a.hit)), ("at", F.when(new, n).otherwise(a.at)))
        return F.struct(*[v.alias(k) for k, v in parts])

    z = ordered.select(F.aggregate("y", zero, step).alias("z"))
    r = lambda c: F.round(F.col(f"z.{c}"), 6)
    return z.select(
        F.col("z.n").cast("long").alias("updates"), r("u").alias("up"), r("d").alias("down"), r("top").alias("max_score"), (F.col("z.hit") != 0).alias("detected"),
        F.when(F.col("z.hit") > 0, "up").when(F.col("z.hit") < 0, "down").alias("direction"), F.when(F.col("z.hit") != 0, F.col("z.at")).cast("long").alias("detected_at"), (F.col("z.n") >= warmup).alias("sufficient"),
    )


def pick_series(df: DataFrame, target: str | None = None) -> str | None:
    """The target if it is numeric, else the non-id numeric column of the largest variance."""
    names = [n for n in X.numeric_columns(df) if not name_tokens(n) & {"id", "key", "identifier", "uuid"}]
    if target in names or not names:
        return target if target in names else None
    row = df.agg(*[F.var_samp(X.finite(df, n)) for n in names]).first()
    return max(zip(names, row, strict=True), key=lambda p: (p[1] is not None and not math.isnan(p[1]), p[1] or 0.0))[0]
