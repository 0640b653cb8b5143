"""Target-aware diagnostics and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import bivariate as B
from . import profile as P
from .roles import infer_roles, name_tokens


def task_type(df: DataFrame, target: str) -> str:
    r = P.distinct_counts(df, [target]).first()
    if r is None or r["distinct_values"] <= 10 or target not in X.numeric_columns(df):
        return "classification"
    return "regression" if r["distinct_values"] / max(1, r["non_null"]) > 0.05 else "classification"


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(class, n, percent, balance): balanced below 60 % in the largest class, severe from 90 %."""
    counts = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.max("n").alias("m"))
    top = 100 * F.col("m") / F.col("t")
    return counts.crossJoin(F.broadcast(total)).select("class", "n", F.round(100 * F.col("n") / F.col("t"), 4).alias("percent"), X.ladder(top, [(90, "severely_imbalanced"), (75, "imbalanced"), (60, "slightly_imbalanced")], "balanced").alias("balance"))


def mapping_purity(df: DataFrame, feature: str, target: str) -> DataFrame:
    """(levels, same_ratio, purity): the share of rows whose target is the most frequent one of their feature value."""
    f, t = F.col(f"`{feature}`").cast("string"), F.col(f"`{target}`").cast("string")
    cells = df.select(f.alias("f"), t.alias("t")).where("f is not null and t is not null").groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy("f").agg(F.max("n").alias("best"), F.sum("n").alias("n"), F.sum(F.when(F.col("f") == F.col("t"), F.col("n")).otherwise(0)).alias("same"))
    return per.agg(F.count(F.lit(1)).alias("levels"), F.round(F.sum("same") / F.sum("n"), 6).alias("same_ratio"), F.round(F.sum("best") / F.sum("n"), 6).alias("purity"))


def leakage(df: DataFrame, target: str, features: list[str] | None = None) -> list[dict]:
    """Features that repeat the target, map onto it, correlate with it, or carry its name."""
    numbers, out = X.numeric_columns(df), []
    for f in features or [n for n in df.columns if n != target]:
        r = mapping_purity(df, f, target).first()
        reasons = []
        if (r["same_ratio"] or 0) >= 0.98:
            reasons.append(("same_values", "critical"))
        if 1 < r["levels"] <= 20 and (r["purity"] or 0) >= 0.98:
            reasons.append(("mapping", "critical" if r["purity"] >= 0.995 else "high"))
        if f in numbers and target in numbers:
            c = P.correlations(df, [f, target], 6).first()["correlation"]
            if c is not None and abs(c) >= 0.9:
                reasons.append(("correlation", "critical" if abs(c) >= 0.98 else "high"))
        if len(name_tokens(target)) and name_tokens(target) <= name_tokens(f):
            reasons.append(("name", "medium"))
        if reasons:
            out.append({"feature": f, "reasons": [x for x, _ in reasons], "severity": min((s for _, s in reasons), key=("critical", "high", "medium").index)})
    return out


def associations(df: DataFrame, target: str, features: list[str] | None = None) -> list[dict]:
    """Features ranked by Spearman, correlation ratio or Cramér's V without correction, as the types ask for."""
    kind, numbers, out = task_type(df, target), X.numeric_columns(df), []
    counts = {r["column"]: r["distinct_values"] for r in P.distinct_counts(df).collect()}
    for f in features or [n for n in df.columns if n != target]:
        if f in numbers:
            if kind == "regression":
                how, v = "spearman", B.spearman(df, f, target).first()["spearman"]
            else:
                how, v = "correlation_ratio", B.correlation_ratio(df, target, f).first()["eta"]
        elif 2 <= counts.get(f, 0) <= 50:
            if kind == "regression":
                how, v = "correlation_ratio", B.correlation_ratio(df, f, target).first()["eta"]
            else:
                how, v = "cramers_v", B.chi_square(df, f, target, yates=False).first()["cramers_v"]
        else:
            continue
        if v is not None:
            out.append({"feature": f, "method": how, "value": v})
    return sorted(out, key=lambda r: (-abs(r["value"]), r["feature"]))


def split_guidance(roles: dict[str, dict], kind: str) -> dict:
    times = [n for n, r in roles.items() if "time_like" in r["roles"]]
    if times:
        return {"strategy": "time_aware", "column": times[0]}
    return {"strategy": "stratified" if kind == "classification" else "random", "column": None}


def target_analysis(df: DataFrame, target: str) -> dict:
    if target not in df.columns:
        return {"available": False, "reason": f"no column {target}"}
    roles, kind = infer_roles(df), task_type(df, target)
    leaks = leakage(df, target)
    info = roles[target]
    profile = {r["class"]: r["n"] for r in class_balance(df, target).collect()} if kind == "classification" else P.numeric_summary(df, [target]).first().asDict()
    warnings = [f"{x['feature']} may leak the target" for x in leaks]
    if "id_like" in info["roles"]:
        warnings.append("the target looks like an identifier")
    if info["missing_percent"] >= 20:
        warnings.append("the target misses many values")
    return {
        "available": True, "target_column": target, "task_type": kind, "target_profile": profile, "target_roles": info["roles"], "split_guidance": split_guidance(roles, kind),
        "leakage": leaks, "top_associations": associations(df, target)[:10], "warning_count": len(warnings), "warnings": warnings,
    }


def segments(df: DataFrame, segment: str, target: str) -> DataFrame:
    """(segment, n, mean, median, std, min, max) of a numeric target; null segments stay a group."""
    x = X.finite(df, target)
    r = lambda v: F.round(v, 4)
    return df.groupBy(F.coalesce(F.col(f"`{segment}`").cast("string"), F.lit("null")).alias("segment")).agg(F.count(x).alias("n"), r(F.avg(x)).alias("mean"), r(F.percentile(x, 0.5)).alias("median"), r(F.stddev_samp(x)).alias("std"), r(F.min(x)).alias("min"), r(F.max(x)).alias("max"))


def segment_shares(df: DataFrame, segment: str, target: str) -> DataFrame:
    """(segment, class, n, percent) of a categorical target."""
    from pyspark.sql import Window

    n = df.groupBy(F.coalesce(F.col(f"`{segment}`").cast("string"), F.lit("null")).alias("segment"), F.col(f"`{target}`").cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("segment")), 4))


def segment_analysis(df: DataFrame, target: str) -> dict:
    counts = {r["column"]: r["distinct_values"] for r in P.distinct_counts(df).collect()}
    names = [n for n in df.columns if n not in X.numeric_columns(df) and n != target and 2 <= counts.get(n, 0) <= 12][:5]
    number = target in X.numeric_columns(df)
    results = [{"segment_column": n, "analysis_type": "numeric" if number else "categorical", "groups": [r.asDict() for r in (segments if number else segment_shares)(df, n, target).collect()]} for n in names]
    return {"available": bool(results), "segment_columns": names, "results": results}


def bounded_target_analysis(df: DataFrame, target: str, columns: int = 200) -> dict:
    """target_analysis over the target and the first columns - 1 others, with the number left out; all rows take part."""
    others = [n for n in df.columns if n != target]
    kept = others[: columns - 1]
    found = target_analysis(df.select(*[F.col(f"`{n}`") for n in [target, *kept] if n in df.columns]), target)
    return found | {"columns_left_out": len(others) - len(kept)}
