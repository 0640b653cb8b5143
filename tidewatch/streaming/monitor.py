"""Batch aggregates over streams: mergeable moments, event-time profiles, and a stateful shift detector."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import expressions as X

MOMENTS = "column string, n long, missing long, m1 double, m2 double, m3 double, m4 double, lo double, hi double"


def moment_state(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n, missing, m1..m4, lo, hi): count, mean and central sums of powers 2 to 4, which merge exactly."""
    cells = []
    for name in names:
        x = X.finite(df, name)
        n, sd = F.count(x).cast("double"), F.stddev_pop(x)
        cells.append(
            F.struct(
                F.lit(name).alias("column"), F.count(x).alias("n"), F.sum(F.when(X.missing(df, name), 1).otherwise(0)).cast("long").alias("missing"), F.avg(x).alias("m1"), (F.var_pop(x) * n).alias("m2"),
                F.coalesce(F.skewness(x) * n * sd**3, F.lit(0.0)).alias("m3"), F.coalesce((F.kurtosis(x) + 3) * n * sd**4, F.lit(0.0)).alias("m4"), F.min(x).alias("lo"), F.max(x).alias("hi"),
            )
        )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).na.fill(0.0, ["m1", "m2"])


def merge_moments(states: DataFrame) -> DataFrame:
    """One state a column of several: sums around the common mean by the binomial theorem."""
    total = states.groupBy("column").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("m1")) / F.nullif(F.sum("n"), F.lit(0))).alias("_m"))
    n, d = F.col("n"), F.col("m1") - F.col("_m")
    joined = states.join(F.broadcast(total), "column")
    return joined.groupBy("column").agg(
        F.max("_n").alias("n"), F.sum("missing").alias("missing"), F.coalesce(F.max("_m"), F.lit(0.0)).alias("m1"), F.coalesce(F.sum(F.col("m2") + n * d**2), F.lit(0.0)).alias("m2"),
        F.coalesce(F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d**3), F.lit(0.0)).alias("m3"), F.coalesce(F.sum(F.col("m4") + 4 * d * F.col("m3") + 6 * d**2 * F.col("m2") + n * d**4), F.lit(0.0)).alias("m4"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )


def moments_summary(state: DataFrame) -> DataFrame:
    n, g1, g2 = F.col("n").cast("double"), F.sqrt("n") * F.col("m3") / F.nullif(F.pow("m2", F.lit(1.5)), F.lit(0.0)), F.col("n") * F.col("m4") / F.nullif(F.col("m2") ** 2, F.lit(0.0)) - 3
    return state.select(
        "column", F.col("n").alias("count"), "missing", F.round("m1", 6).alias("mean"), F.round(F.sqrt(F.col("m2") / F.nullif(n - 1, F.lit(0.0))), 6).alias("std"), F.col("lo").alias("min"), F.col("hi").alias("max"),
        F.round(F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))), 6).alias("skewness"), F.round(F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)), 6).alias("kurtosis"),
    )


def stream_profile(stream: DataFrame, names: list[str], path: str, checkpoint: str):
    """A query that writes each micro-batch's state under its batch number, so that a replayed batch replaces its own state."""

    def save(batch: DataFrame, number: int) -> None:
        moment_state(batch, names).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return moments_summary(merge_moments(spark.read.parquet(path).drop("batch")))


def window_profile(stream: DataFrame, ts: str, value: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, n, mean, std, low, high) by event-time window; rows later than the watermark are dropped by the engine."""
    x = X.finite(stream, value)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")).select(F.col("window.start").alias("start"), "n", "mean", "std", "low", "high")


def shift_detector(stream: DataFrame, key: str, order: str, value: str, delta: float = 0.5, alpha: float = 0.995, threshold: float = 8.0, clip: float = 8.0, warmup: int = 8) -> DataFrame:
    """(key, updates, up, down, detected) after each micro-batch: a Page-Hinkley test kept as state of each key."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, m, s, up, down, hit = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, False)
        for y in pd.concat(list(frames)).sort_values("o")["v"].dropna():
            if abs(y) == float("inf"):
                continue
            sd = (max(s, 0.0) / (n - 1)) ** 0.5 if n > 1 else 0.0
            gap = y - m
            if n + 1 >= warmup:
                r = max(-clip, min(clip, gap / (sd if sd > 1e-12 else max(abs(m) * 1e-6, 1e-9))))
                up, down = max(0.0, alpha * up + r - delta), max(0.0, alpha * down - r - delta)
                hit = hit or max(up, down) >= threshold
            n += 1
            if n == 1:
                m = y
                continue
            m += gap / n
            s += gap * (y - m)
        state.update((n, m, s, up, down, hit))
        yield pd.DataFrame([(k[0], n, up, down, hit)], columns=["key", "updates", "up", "down", "detected"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, updates long, up double, down double, detected boolean", "n long, m double, s double, up double, down double, hit boolean", "update", GroupStateTimeout.NoTimeout)
