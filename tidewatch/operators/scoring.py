"""Health, readiness and utility scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import profile as P
from .facts import Facts
from .ranks import cells, exact_quantiles, keyed

SENSITIVE = {"gender", "sex", "race", "ethnicity", "religion", "age", "nationality", "disability", "marital", "caste", "orientation"}


def label(score: float, steps: tuple[tuple[float, str], ...], otherwise: str) -> str:
    return next((name for bound, name in steps if score >= bound), otherwise)


HEALTH = ((90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor"))
READINESS = ((85, "Ready"), (70, "Mostly ready"), (50, "Needs work"))


def iqr_bounds(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(low, high) fences at 1.5 interquartile ranges of each column; columns without values are left out."""
    found = exact_quantiles(df, [X.finite(df, n) for n in names], [0.25, 0.75])
    return {n: fences(f["quantiles"]) for n, f in zip(names, found, strict=True) if f["quantiles"]}


def fences(quarters: list[float]) -> tuple[float, float]:
    lo, hi = quarters[0], quarters[-1]
    return lo - 1.5 * (hi - lo), hi + 1.5 * (hi - lo)


def iqr_outliers(df: DataFrame, names: list[str] | None = None, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, values, outliers, outlier_percent) by 1.5 interquartile ranges; the scan takes the fences that are given."""
    bounds = iqr_bounds(df, names or X.numeric_columns(df)) if bounds is None else bounds
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, values long, outliers long, outlier_percent double")
    names = list(bounds)
    table = keyed(df.sparkSession, [(k, n, *map(float, bounds[n])) for k, n in enumerate(names)], "k int, column string, lo double, hi double")
    far = (F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))
    counts = cells(df, [X.finite(df, n) for n in names]).join(table, "k").groupBy("column").agg(F.count("x").alias("values"), F.sum(far.cast("int")).cast("long").alias("outliers"))
    return counts.withColumn("outlier_percent", F.round(100 * F.col("outliers") / F.col("values"), 4))


def health_score(df: DataFrame, profile: dict | None = None, facts: Facts | None = None) -> dict:
    """Weighted completeness, consistency, uniqueness and outlier safety, plus ten points that every table has."""
    facts = facts or Facts(df)
    profile = profile or P.build_profile(df, facts=facts)
    rows, columns = profile["shape"]["rows"], profile["shape"]["columns"]
    cells = rows * columns
    gaps = 100 * sum(profile["missing_counts"].values()) / cells if cells else 0.0
    twice = profile["duplicate_percent"]
    bounds = {n: fences(facts.numeric[n]["quantiles"]) for n in profile["numeric_columns"] if facts.numeric[n]["quantiles"]}
    hits = iqr_outliers(df, bounds=bounds).collect() if bounds else []
    values = sum(r["values"] for r in hits)
    outliers = 100 * sum(r["outliers"] for r in hits) / values if values else 0.0
    distinct = {n: facts.columns[n]["distinct"] for n in profile["columns"]}
    constant = [n for n in profile["columns"] if distinct.get(n, 0) <= 1]
    crowded = [n for n in profile["categorical_columns"] if rows and distinct.get(n, 0) / rows > 0.9]
    consistency = max(0.0, 100 - 100 * (len(constant) + len(crowded)) / columns) if columns else 0.0
    parts = {"completeness": 100 - gaps, "consistency": consistency, "uniqueness": 100 - twice, "outlier_safety": max(0.0, 100 - outliers)}
    total = 0.3 * parts["completeness"] + 0.2 * (parts["consistency"] + parts["uniqueness"] + parts["outlier_safety"]) + 10
    total = round(max(0.0, min(100.0, total)), 2)
    return {
        "overall_score": total,
        "label": label(total, HEALTH, "Critical"),
        "components": {k: round(v, 2) for k, v in parts.items()},
        "details": {"missing_percent": round(gaps, 2), "duplicate_percent": twice, "outlier_percent": round(outliers, 2), "constant_columns": constant, "high_cardinality_columns": crowded, "outlier_details": {r["column"]: r["outliers"] for r in hits}},
    }


def health_frame(df: DataFrame) -> DataFrame:
    score = health_score(df)
    d = score["details"]
    row = (score["overall_score"], score["label"], d["missing_percent"], d["duplicate_percent"], d["outlier_percent"])
    return df.sparkSession.createDataFrame([row], "overall_score double, label string, missing_percent double, duplicate_percent double, outlier_percent double")


def readiness_from(profile: dict) -> dict:
    cells = profile["shape"]["rows"] * profile["shape"]["columns"]
    gaps = 100 * sum(profile["missing_counts"].values()) / cells if cells else 0.0
    text = len(profile["categorical_columns"])
    score = round(max(0.0, 100 - min(30.0, gaps) - min(15.0, profile["duplicate_percent"]) - min(20, 2 * text)), 2)
    advice = []
    if gaps:
        advice.append("Fill or drop missing values.")
    if profile["duplicate_percent"]:
        advice.append("Remove duplicate rows.")
    if text:
        advice.append("Encode categorical columns.")
    return {
        "score": score,
        "label": label(score, READINESS, "Not ready"),
        "numeric_columns": len(profile["numeric_columns"]),
        "categorical_columns": text,
        "issues": {"missing_percent": round(gaps, 2), "duplicate_percent": profile["duplicate_percent"], "encoding_required_count": text},
        "recommendations": advice,
    }


def column_utility(df: DataFrame) -> DataFrame:
    """(column, utility_score, utility_label): less for missing values, constants and crowded text columns."""
    gaps = P.missing_counts(df)
    counts = P.distinct_counts(df)
    numeric = F.col("column").isin(X.numeric_columns(df) or [""])
    share = F.col("distinct_values") / F.nullif("non_null", F.lit(0))
    score = (
        100
        - F.least(F.lit(40.0), F.col("missing_percent"))
        - F.when(F.col("distinct_values") <= 1, 40).otherwise(0)
        - F.when((share > 0.9) & ~numeric & (F.col("distinct_values") > 1), 30).otherwise(0)
    )
    score = F.round(F.greatest(F.lit(0.0), score), 2)
    return gaps.join(F.broadcast(counts), "column").select("column", score.alias("utility_score"), X.ladder(score, [(80, "High"), (50, "Moderate")], "Low").alias("utility_label"))


def anomaly_density(df: DataFrame, names: list[str]) -> tuple[Column, int]:
    """The share of a row's values outside their column's fences, and the number of usable columns."""
    fences = {n: b for n, b in iqr_bounds(df, names).items() if b[0] < b[1]}
    flags = [F.when((X.finite(df, n) < lo) | (X.finite(df, n) > hi), 1).otherwise(0) for n, (lo, hi) in fences.items()]
    total = flags[0] if flags else F.lit(0)
    for f in flags[1:]:
        total = total + f
    return total / F.lit(max(1, len(flags))), len(flags)


def anomalous_rows(df: DataFrame, names: list[str], keys: list[str], top: int = 10) -> DataFrame:
    """The rows with the largest anomaly density."""
    density, _ = anomaly_density(df, names)
    return df.select(*keys, F.round(density, 6).alias("density")).where("density > 0").orderBy(F.desc("density"), *keys).limit(top)


def fairness_review(columns: list[str]) -> dict:
    from .roles import name_tokens

    found = [n for n in columns if name_tokens(n) & SENSITIVE]
    return {"sensitive_columns": found, "review_recommended": bool(found)}


def freshness(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, parsed, oldest, newest) of the columns read as timestamps."""
    cells = []
    for n in names:
        ts = F.expr(f"try_to_timestamp(cast(`{n}` as string))")
        cells.append(F.struct(F.lit(n).alias("column"), F.count(ts).alias("parsed"), F.min(ts).alias("oldest"), F.max(ts).alias("newest")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
