"""Profiles: shape, types, missing cells, duplicates, summaries, frequencies and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from .facts import DIRECT_COLUMNS, QUANTILES, Facts, correlation_sums, numeric_facts
from .ranks import cells, keyed

CORRELATION_COLUMNS = 100
PREVIEW_ROWS = 15


def missing_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, missing_count, missing_percent) in one pass."""
    names = names or df.columns
    row = df.agg(F.array(*[F.struct(F.lit(n).alias("column"), F.sum(F.when(X.missing(df, n), 1).otherwise(0)).cast("long").alias("missing_count")) for n in names]).alias("cells"), F.count(F.lit(1)).alias("rows"))
    return row.select(F.inline("cells"), "rows").select(
        "column", F.coalesce("missing_count", F.lit(0)).alias("missing_count"), F.coalesce(F.round(100 * F.col("missing_count") / F.nullif("rows", F.lit(0)), 2), F.lit(0.0)).alias("missing_percent")
    )


def duplicate_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(rows, distinct_rows, duplicate_rows, duplicate_percent), exact, by one partial aggregation on all columns."""
    names = names or df.columns
    groups = df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count(F.lit(1)).alias("_n"))
    totals = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
    twice = F.col("rows") - F.col("distinct_rows")
    return totals.select("rows", "distinct_rows", twice.alias("duplicate_rows"), F.coalesce(F.round(100 * twice / F.nullif("rows", F.lit(0)), 2), F.lit(0.0)).alias("duplicate_percent"))


def numeric_summary(df: DataFrame, names: list[str] | None = None, quantiles: str = "exact", digits: int = 3) -> DataFrame:
    """One row for each numeric column: counts, moments, bias-corrected shape and quantiles of the finite values.

    quantiles: `exact` interpolates linearly between order statistics at every size, `approx` reads one bounded sketch.
    """
    names = names or X.numeric_columns(df)
    spark, out = df.sparkSession, "column string, count long, missing long, infinite long, mean double, std double, min double, q25 double, q50 double, q75 double, max double, skewness double, kurtosis double"
    if not names:
        return spark.createDataFrame([], out)
    if quantiles == "exact":
        facts = numeric_facts(df, names)
        middle = {n: facts[n]["quantiles"] or (None,) * len(QUANTILES) for n in names}
    else:
        x = F.col("x")
        aggs = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), X.corrected_skewness(x).alias("skewness"), X.corrected_kurtosis(x).alias("kurtosis"), F.percentile_approx(x, list(QUANTILES), 10_000).alias("quantiles")]
        rows = {r["column"]: r.asDict() for r in X.unpivot(df, names, "x", as_text=False).where("x is not null").groupBy("column").agg(*aggs).collect()}
        none = dict.fromkeys(("mean", "std", "min", "max", "skewness", "kurtosis")) | {"n": 0, "quantiles": (None,) * len(QUANTILES)}
        facts = {n: rows.get(n, none) for n in names}
        middle = {n: facts[n]["quantiles"] for n in names}
    gaps = {r["column"]: r for r in _gaps(df, names).collect()}
    rows = []
    for n in names:
        f, g = facts[n], gaps.get(n)
        rows.append((n, f["n"], g["missing"] if g else 0, g["infinite"] if g else 0, f["mean"], f["std"], f["min"], *middle[n], f["max"], f["skewness"], f["kurtosis"]))
    frame = spark.createDataFrame(rows, out)
    short = [F.round(c, digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    return frame.select("column", "count", "missing", "infinite", *short, F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


def _gaps(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, missing, infinite) in one scan."""
    state = lambda n: F.when(X.missing(df, n), 1).when(F.abs(F.col(f"`{n}`").cast("double")) == float("inf"), 2).otherwise(0)
    count = lambda v: F.sum((F.col("state") == v).cast("int")).cast("long")
    found = cells(df, [state(n) for n in names], "state").groupBy("k").agg(count(1).alias("missing"), count(2).alias("infinite"))
    return found.join(keyed(df.sparkSession, list(enumerate(names)), "k int, column string"), "k").select("column", "missing", "infinite")


def frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n) of the named columns, values as text and null among them: one scan, one partial aggregation.

    Distinct counts, top values, entropy and duplicate keys all follow from it, without one distinct aggregate a column.
    """
    return X.unpivot(df, names).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, names: list[str] | None = None, top: int = 10) -> DataFrame:
    """(column, rank, value, n, unique_values): the most frequent values, null as `null`; ties go to the smaller value."""
    freq = frequencies(df, names or X.categorical_columns(df)).withColumn("shown", F.coalesce("value", F.lit("null")))
    distinct = freq.groupBy("column").agg(F.count("value").alias("unique_values"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "shown")
    ranked = freq.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(distinct), "column").select("column", "rank", F.col("shown").alias("value"), "n", "unique_values")


def distinct_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, distinct_values, non_null) without nulls among the values."""
    freq = frequencies(df, names or df.columns)
    return freq.groupBy("column").agg(F.count("value").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"))


def correlations(df: DataFrame, names: list[str] | None = None, digits: int = 3) -> DataFrame:
    """(left, right, correlation) of every pair over rows where both are finite; all pairs in few passes.

    Beyond CORRELATION_COLUMNS columns those with the most finite values are taken, then by name.
    """
    names = names or X.numeric_columns(df)
    if len(names) > CORRELATION_COLUMNS:
        row = df.agg(*[F.count(X.finite(df, n)).alias(str(k)) for k, n in enumerate(names)]).first()
        names = [n for _, n in sorted((-row[k], n) for k, n in enumerate(names))][:CORRELATION_COLUMNS]
    spark, schema = df.sparkSession, "left string, right string, correlation double"
    if len(names) < 2:
        return spark.createDataFrame([], schema)
    pairs = list(combinations(names, 2))
    if len(names) > DIRECT_COLUMNS:
        row = df.agg(*[f(X.finite(df, n)) for n in names for f in (F.avg, F.stddev_samp)]).first()
        _, r = correlation_sums(df, names, [m or 0.0 for m in row[::2]], [s or 1.0 for s in row[1::2]])
        at = {n: k for k, n in enumerate(names)}
        values = ((a, b, float(r[at[a], at[b]])) for a, b in pairs)
        found = spark.createDataFrame([(a, b, None if v != v else v) for a, b, v in values], schema)
        return found.withColumn("correlation", F.round("correlation", digits))
    cells = []
    for a, b in pairs:
        x, y = X.finite(df, a), X.finite(df, b)
        both = x.isNotNull() & y.isNotNull()
        r = F.corr(F.when(both, x), F.when(both, y))
        cells.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.round(F.when(~F.isnan(r), r), digits).alias("correlation")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def memory_estimate(df: DataFrame) -> int:
    """Bytes by the optimizer's own statistics: an estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _rounded(x: float | None, digits: int) -> float | None:
    return None if x is None or x != x else round(x, digits)


def build_profile(df: DataFrame, top: int = 10, facts: Facts | None = None) -> dict:
    """The whole profile as a dictionary: a fixed number of jobs, whatever the number of columns."""
    facts = facts or Facts(df, top)
    numeric, text, columns = facts.numbers, facts.categories, facts.columns
    twice = facts.duplicates
    summary = {}
    for n, f in facts.numeric.items():
        quarter = dict(zip(("25%", "50%", "75%"), (_rounded(q, 3) for q in f["quantiles"] or (None,) * 3), strict=True))
        plain = {k: _rounded(f[k], 3) for k in ("mean", "std", "min")}
        summary[n] = {"count": f["n"]} | plain | quarter | {"max": _rounded(f["max"], 3), "skewness": _rounded(f["skewness"], 6), "kurtosis": _rounded(f["kurtosis"], 6)}
    related = sorted(numeric, key=lambda n: (-facts.numeric[n]["n"], n))[:CORRELATION_COLUMNS] if len(numeric) > CORRELATION_COLUMNS else numeric
    pairs = facts.correlations(related) if len(related) > 1 else {}
    matrix = {n: {n: 1.0} for n in related} if pairs else {}
    for (a, b), r in pairs.items():
        matrix[a][b] = matrix[b][a] = _rounded(r, 3)
    dates = X.date_columns(df) + [n for n in facts.texts if (facts.text[n]["datetime_ratio"] or 0) >= 0.7 and (facts.text[n]["numeric_ratio"] or 0) < 0.5]
    return {
        "shape": {"rows": facts.rows, "columns": len(df.columns)},
        "columns": df.columns,
        "dtypes": dict(df.dtypes),
        "numeric_columns": numeric,
        "categorical_columns": text,
        "date_columns": dates,
        "missing_counts": {n: columns[n]["missing"] for n in df.columns},
        "missing_percent": {n: facts.missing_percent(n) for n in df.columns},
        "duplicate_rows": twice["duplicate_rows"],
        "duplicate_percent": twice["duplicate_percent"],
        "duplicate_metadata": {"method": "exact", "sampled": False},
        "memory_usage_mb": round(memory_estimate(df) / 1e6, 3),
        "numeric_summary": summary,
        "numeric_summary_metadata": {"quantiles": "exact"},
        "categorical_summary": {n: {"unique_values": columns[n]["distinct"], "top_values": columns[n]["top"]} for n in text},
        "correlations": matrix,
        "correlation_metadata": {"columns": len(related)},
        "preview": [r.asDict() for r in df.limit(PREVIEW_ROWS).collect()],
    }


def duplicate_estimate(df: DataFrame, order: list[str], rows: int = 10_000) -> dict:
    """The share of duplicate rows in a deterministic sample: a lower bound of the table's, as copies may lie outside it."""
    from .sampling import sample_rows

    part = duplicate_rows(sample_rows(df, order, rows), df.columns).first()
    return {"method": "sampled", "rows": part["rows"], "duplicate_rows": part["duplicate_rows"], "duplicate_percent": part["duplicate_percent"]}
