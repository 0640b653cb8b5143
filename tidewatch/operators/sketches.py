"""Mergeable summaries of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X

ACCURACY, ZERO = 0.01, 1e-12


def log_bins(df: DataFrame, column: str, accuracy: float = ACCURACY) -> DataFrame:
    """(sign, key, n): counts in bins of constant relative width; bins of two tables merge by adding counts."""
    width = math.log((1 + accuracy) / (1 - accuracy))
    x = F.col(f"`{column}`").cast("double")
    sign = F.when(F.abs(x) <= ZERO, 0).when(x > 0, 1).otherwise(-1)
    key = F.when(F.abs(x) > ZERO, F.floor(F.ln(F.abs(x)) / width)).otherwise(0)
    inside = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return inside.select(sign.cast("int").alias("sign"), key.cast("long").alias("key")).groupBy("sign", "key").agg(F.count(F.lit(1)).alias("n"))


def merge_bins(*bins: DataFrame) -> DataFrame:
    out = bins[0]
    for b in bins[1:]:
        out = out.unionByName(b)
    return out.groupBy("sign", "key").agg(F.sum("n").alias("n"))


def bin_quantiles(bins: DataFrame, quantiles: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """(quantile, value): the representative of the bin that holds rank floor(q (n - 1)). The window sees bins only."""
    width = math.log((1 + accuracy) / (1 - accuracy))
    value = F.col("sign") * F.exp((F.col("key") + 0.5) * width)
    ordered = Window.orderBy("sign", F.col("sign") * F.col("key"))
    ranked = bins.select(value.alias("value"), F.sum("n").over(ordered).alias("upto"), "n", F.sum("n").over(Window.partitionBy()).alias("total"))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile")
    wanted = ranked.select("*", asked).withColumn("rank", F.floor(F.col("quantile") * (F.col("total") - 1)))
    return wanted.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("quantile", F.round("value", 6).alias("value"))


def distinct_estimate(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, estimate) by HyperLogLog with a relative error of 2 %."""
    cells = [F.struct(F.lit(n).alias("column"), F.approx_count_distinct(f"`{n}`", 0.02).alias("estimate")) for n in names]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def distinct_sketch(df: DataFrame, column: str) -> DataFrame:
    """A mergeable HyperLogLog state; merge_sketches unites states of several tables."""
    return df.agg(F.hll_sketch_agg(F.col(f"`{column}`").cast("string"), 12).alias("sketch"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def heavy_hitters(df: DataFrame, column: str, k: int = 32) -> DataFrame:
    """(value, n): frequent values with a state of bounded size; rare ones may be missing."""
    return df.agg(F.expr(f"approx_top_k(cast(`{column}` as string), {k}, 10000)").alias("top")).select(F.inline("top")).toDF("value", "n")


def reservoir(df: DataFrame, names: list[str], capacity: int = 256) -> DataFrame:
    """The rows with the smallest hashed priorities: a sample that does not depend on partitioning."""
    priority = F.xxhash64(*[F.col(f"`{n}`") for n in names], F.lit(17))
    return df.withColumn("_p", priority).orderBy("_p", *[F.col(f"`{n}`") for n in names]).limit(capacity).drop("_p")


def numeric_state(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n, missing, mean, std, min, max, q25, q50, q75, distinct): moments and bounded sketches of all columns in one scan; quantiles and distinct counts are estimates."""
    x = F.col("x")
    aggs = [F.count(x).alias("n"), F.sum(x.isNull().cast("int")).cast("long").alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias("q"), F.approx_count_distinct(x).alias("distinct")]
    state = X.unpivot(df, names, "x", as_text=False).groupBy("column").agg(*aggs)
    return state.select("column", "n", "missing", "mean", "std", "min", "max", *[F.col("q")[k].alias(c) for k, c in enumerate(("q25", "q50", "q75"))], "distinct")


def categorical_state(df: DataFrame, names: list[str], k: int = 32, items: int = 10_000) -> DataFrame:
    """(column, n, missing, distinct, top): counts, an estimate of the distinct values and the k most frequent ones, in one scan with bounded state."""
    v = F.col("value")
    aggs = [F.count(v).alias("n"), F.sum(v.isNull().cast("int")).cast("long").alias("missing"), F.approx_count_distinct(v).alias("distinct"), F.expr(f"approx_top_k(value, {k}, {items})").alias("top")]
    return X.unpivot(df, names).groupBy("column").agg(*aggs)
