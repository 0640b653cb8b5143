"""Facts about all columns of a table, each gathered once and shared by profile, roles, scores and quality."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from .ranks import PASS_COLUMNS, exact_quantiles

QUANTILES = (0.25, 0.5, 0.75)
#: Beyond so many columns correlations come from sums of products in numpy, not from one aggregate a pair.
DIRECT_COLUMNS = 8


def column_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """(k, value, n): values as text by column number, null among them; one partial aggregation."""
    out = None
    for lo in range(0, len(names), PASS_COLUMNS):
        part = df.select(F.posexplode(F.array(*[F.col(f"`{n}`").cast("string") for n in names[lo : lo + PASS_COLUMNS]])).alias("k", "value"))
        part = part.withColumn("k", F.col("k") + lo) if lo else part
        out = part if out is None else out.unionByName(part)
    return out.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))


def column_facts(df: DataFrame, names: list[str], ranked: list[str], top: int = 10) -> dict[str, dict]:
    """rows, distinct, filled, missing, duplicated_values, affected_rows, best, best_n, fingerprint and top of each column.

    One frequency table serves all. top lists the most frequent values of the columns in `ranked`, null as `null`, ties
    by value. fingerprint is equal for columns whose values occur equally often.
    """
    if not names:
        return {}
    freq = column_frequencies(df, names)
    given, often = F.col("value").isNotNull(), F.col("n") > 1
    total = lambda test, x: F.coalesce(F.sum(F.when(test, x)), F.lit(0)).cast("long")
    odd = F.lower(F.col("value")) == "nan"
    fractional = [k for k, n in enumerate(names) if X.is_fractional(df.schema[n].dataType)]
    per = freq.groupBy("k").agg(
        F.sum("n").alias("rows"),
        F.count("value").alias("distinct"),
        total(given, F.col("n")).alias("filled"),
        total(~given | (F.col("k").isin(fractional) & odd), F.col("n")).alias("missing"),
        total(given & often, F.lit(1)).alias("duplicated_values"),
        total(given & often, F.col("n")).alias("affected_rows"),
        F.max(F.when(given, F.struct("n", "value"))).alias("best"),
        F.bit_xor(F.xxhash64("value", "n")).alias("fingerprint"),
    )
    empty = {"rows": 0, "distinct": 0, "filled": 0, "missing": 0, "duplicated_values": 0, "affected_rows": 0, "best": None, "fingerprint": None}
    out = {n: dict(empty) for n in names}
    for r in per.collect():
        out[names[r["k"]]] = r.asDict()
    for r in out.values():
        r["best"], r["best_n"], r["top"] = (*(r["best"] or (0, None))[::-1], {})
    if ranked:
        order = Window.partitionBy("k").orderBy(F.desc("n"), "shown")
        shown = column_frequencies(df, ranked).withColumn("shown", F.coalesce("value", F.lit("null")))
        for r in shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).orderBy("k", "rank").collect():
            out[ranked[r["k"]]]["top"][r["shown"]] = r["n"]
    return out


def numeric_facts(df: DataFrame, names: list[str], probs: tuple[float, ...] = QUANTILES) -> dict[str, dict]:
    """n, mean, std, min, max, skewness, kurtosis and exact quantiles of the finite values of each column."""
    x = F.col("x")
    extras = [F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), X.corrected_skewness(x).alias("skewness"), X.corrected_kurtosis(x).alias("kurtosis")]
    none = dict.fromkeys(("mean", "std", "min", "max", "skewness", "kurtosis"))
    found = exact_quantiles(df, [X.finite(df, n) for n in names], list(probs), extras) if names else []
    return {n: none | r for n, r in zip(names, found, strict=True)}


def text_facts(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Lengths, blanks, and shares of numbers, timestamps and semantic shapes of each text column, over all rows in one scan.

    Shapes are judged once for each distinct value and weighed by its rows.
    """
    from .roles import SEMANTIC, semantic_test

    if not names:
        return {}
    v, n = F.col("v"), F.col("n")
    trimmed = F.trim(v)
    given = trimmed != ""
    number = F.expr("try_cast(regexp_replace(trim(v), '[,$€£₹%]', '') as double) is not null")
    stamp = F.expr("try_to_timestamp(trim(v)) is not null")
    share = lambda test, of: F.try_divide(F.sum(F.when(of & test, n).otherwise(0)), F.sum(F.when(of, n)))
    freq = column_frequencies(df, names).withColumnRenamed("value", "v").where("v is not null")
    rows = freq.groupBy("k").agg(
        (F.sum(F.length(v) * n) / F.sum(n)).alias("mean_length"), F.max(F.length(v)).alias("max_length"), F.sum(F.when(trimmed == "", n).otherwise(0)).cast("long").alias("blank_count"),
        share(number, given).alias("numeric_ratio"), share(stamp, given).alias("datetime_ratio"),
        *[F.round(share(semantic_test(kind, trimmed), F.lit(True)), 4).alias(f"is_{kind}") for kind in SEMANTIC],
    )
    none = {"mean_length": 0.0, "max_length": 0, "blank_count": 0, "numeric_ratio": None, "datetime_ratio": None} | {f"is_{k}": None for k in SEMANTIC}
    out = {n: dict(none) for n in names}
    for r in rows.collect():
        out[names[r["k"]]] = r.asDict()
    return out


def correlation_sums(df: DataFrame, names: list[str], centre: list[float], scale: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(n, r): numbers of rows where both columns are finite, and their Pearson correlations, NaN without spread.

    Each task adds up products of the centred and scaled columns and of their presence flags, and hands on four matrices
    of one row a column; a second step adds these by matrix row, so memory does not grow with rows.
    """
    d = len(names)
    mean, unit = np.array(centre, float), np.array(scale, float)

    def sums(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            here = np.isfinite(x)
            z = np.where(here, (x - mean) / unit, 0.0)
            flags = here.astype(float)
            total += np.stack([flags.T @ flags, z.T @ flags, (z * z).T @ flags, z.T @ z])
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *(pa.array(list(t), pa.list_(pa.float64())) for t in total)], names=["i", "n", "s", "q", "p"])

    parts = df.select(*[X.finite(df, n).alias(str(k)) for k, n in enumerate(names)]).mapInArrow(sums, "i int, n array<double>, s array<double>, q array<double>, p array<double>")
    spread = parts.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "p")).alias("j", "c")).groupBy("i", "j")
    table = np.zeros((4, d, d))
    for r in spread.agg(*[F.sum(f"c.{x}").alias(x) for x in "nsqp"]).collect():
        table[:, r["i"], r["j"]] = r["n"], r["s"], r["q"], r["p"]
    n, s, q, p = table
    with np.errstate(all="ignore"):
        top = p - s * s.T / n
        left, right = q - s * s / n, (q - s * s / n).T
        r = top / np.sqrt(left * right)
        r[(left <= 1e-12 * q) | (right <= 1e-12 * q.T)] = np.nan
    return n, np.clip(r, -1.0, 1.0)


#: A table of at most so many bytes by the optimizer's statistics is dealt to all cores and kept while it is analysed.
HELD_BYTES = 256 << 20


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df, kept in memory and on disk for the analyses that scan it many times, if it is small; a larger one as it is."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > HELD_BYTES:
        yield df
        return
    kept = df.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


class Facts:
    """Facts of one table; each part is computed at its first use."""

    def __init__(self, df: DataFrame, top: int = 10) -> None:
        self.df, self.top = df, top
        self.numbers, self.categories = X.numeric_columns(df), X.categorical_columns(df)
        self.texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]

    @cached_property
    def rows(self) -> int:
        return next(iter(self.columns.values()))["rows"] if self.columns else self.df.count()

    @cached_property
    def columns(self) -> dict[str, dict]:
        return column_facts(self.df, self.df.columns, self.categories, self.top)

    @cached_property
    def numeric(self) -> dict[str, dict]:
        return numeric_facts(self.df, self.numbers)

    @cached_property
    def text(self) -> dict[str, dict]:
        return text_facts(self.df, self.texts)

    @cached_property
    def duplicates(self) -> dict:
        from .profile import duplicate_rows

        return duplicate_rows(self.df).first().asDict()

    def missing_percent(self, name: str) -> float:
        return round(100 * self.columns[name]["missing"] / self.rows, 2) if self.rows else 0.0

    def correlations(self, names: list[str]) -> dict[tuple[str, str], float | None]:
        """Pearson correlations of all pairs, over rows where both are finite."""
        facts = [self.numeric[n] for n in names]
        centre = [f["mean"] if f["mean"] is not None else 0.0 for f in facts]
        scale = [f["std"] if f["std"] else 1.0 for f in facts]
        _, r = correlation_sums(self.df, names, centre, scale)
        return {(a, b): None if np.isnan(r[i, j]) else float(r[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
