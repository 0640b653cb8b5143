"""Cleaning plans: inferred, applied, simulated, exported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from . import profile as P
from .ranks import exact_quantiles

PLAN_VERSION = 1


def infer_plan(df: DataFrame) -> dict:
    """Drop duplicate rows, then fill numbers with the median and other columns with the smallest most frequent value.

    Fill values are those of the table without its duplicates; a column without any value gets `Unknown` if it is text.
    """
    twice = P.duplicate_rows(df).first()["duplicate_rows"]
    clean = df.dropDuplicates() if twice else df
    gaps = {r["column"]: r["missing_count"] for r in P.missing_counts(clean).collect()}
    wanted = [f for f in df.schema if gaps[f.name]]
    numbers = [f.name for f in wanted if isinstance(f.dataType, T.NumericType)]
    others = [f.name for f in wanted if f.name not in numbers]
    middle = exact_quantiles(clean, [X.finite(df, n) for n in numbers], [0.5]) if numbers else []
    fills = {n: str(m["quantiles"][0]) if m["quantiles"] else None for n, m in zip(numbers, middle, strict=True)}
    # among equally frequent values the smallest in the column's own order
    for n in others:
        best = clean.where(F.col(f"`{n}`").isNotNull()).groupBy(F.col(f"`{n}`").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").select(F.col("v").cast("string")).first()
        fills[n] = best[0] if best else None
    row = [fills[f.name] for f in wanted]
    actions = []
    if twice:
        actions.append({"id": "drop_duplicates", "type": "drop_duplicates", "column": None, "strategy": "exact", "fill_value": None, "affected": twice, "risk": "low", "description": f"Remove {twice} duplicate rows."})
    for k, f in enumerate(wanted):
        number = isinstance(f.dataType, T.NumericType)
        value = row[k] if row[k] is not None else ("Unknown" if isinstance(f.dataType, T.StringType) else None)
        if value is None:
            continue
        strategy = "median" if number else "mode" if row[k] is not None else "constant"
        actions.append({"id": f"fill:{f.name}", "type": "fill_missing", "column": f.name, "strategy": strategy, "fill_value": value, "affected": gaps[f.name], "risk": "medium", "description": f"Fill {gaps[f.name]} missing values of {f.name} with the {strategy}."})
    return {"schema_version": PLAN_VERSION, "actions": actions, "duplicates_to_remove": twice, "missing_values_to_fill": sum(a["affected"] for a in actions if a["type"] == "fill_missing")}


def apply_plan(df: DataFrame, plan: dict) -> DataFrame:
    if plan.get("schema_version") != PLAN_VERSION:
        raise ValueError("unknown plan version")
    out = df
    if any(a["type"] == "drop_duplicates" for a in plan["actions"]):
        out = out.dropDuplicates()
    fills = {a["column"]: a["fill_value"] for a in plan["actions"] if a["type"] == "fill_missing"}
    return out.select(*[(F.when(X.missing(df, n), F.lit(fills[n]).cast("double" if isinstance(df.schema[n].dataType, T.NumericType) else "string").cast(df.schema[n].dataType)).otherwise(F.col(f"`{n}`")).alias(n) if n in fills else F.col(f"`{n}`")) for n in df.columns])


def simulate_plan(df: DataFrame, plan: dict) -> dict:
    from .scoring import health_score

    before, after = P.build_profile(df), P.build_profile(apply_plan(df, plan))
    a, b = health_score(df, before), health_score(apply_plan(df, plan), after)
    part = lambda p: {"shape": p["shape"], "missing": sum(p["missing_counts"].values()), "duplicates": p["duplicate_rows"]}
    return {"before": part(before), "after": part(after), "health_delta": round(b["overall_score"] - a["overall_score"], 2)}


def guarded(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return df.select(*[F.when(F.col(f"`{f.name}`").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(f"`{f.name}`"))).otherwise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def write_clean_csv(df: DataFrame, path: str, plan: dict | None = None) -> None:
    guarded(apply_plan(df, plan or infer_plan(df))).write.mode("overwrite").option("header", True).csv(path)
