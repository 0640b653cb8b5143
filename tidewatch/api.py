"""The public functions: each takes any input that sources.readers knows."""

from __future__ import annotations

import json
import os
import platform
from html import escape

from pyspark.sql import DataFrame, SparkSession

from .operators import anomaly, bivariate, checks, cleaning, contracts, drift, ml, quality as quality_, roles as roles_, scoring, statistics as statistics_, target as target_
from .operators import gate as gate_
from .operators.facts import held
from .operators import profile as profile_
from .plans import analyze as analyze_
from .plans.config import resolve_config
from .sources import readers

check, run_checks, discover_checks = checks.check, checks.run_checks, checks.discover_checks


def _frame(data: object, spark: SparkSession | None = None) -> DataFrame:
    if isinstance(data, DataFrame):
        return data
    return readers.resolve_source(spark or SparkSession.builder.getOrCreate(), data).frame


def inspect_source(data: object) -> dict:
    return readers.inspect_source(SparkSession.builder.getOrCreate(), data)


def profile(data: object) -> dict:
    with held(_frame(data)) as df:
        return profile_.build_profile(df)


def roles(data: object) -> dict:
    with held(_frame(data)) as df:
        return roles_.infer_roles(df)


def health(data: object) -> dict:
    with held(_frame(data)) as df:
        return scoring.health_score(df)


def ml_readiness(data: object) -> dict:
    with held(_frame(data)) as df:
        return scoring.readiness_from(profile_.build_profile(df))


def quality(data: object, *, max_columns: int = 100) -> dict:
    with held(_frame(data)) as df:
        return quality_.run_quality(df, max_columns)


def statistics(data: object, *, max_pairs: int = 20) -> dict:
    df = _frame(data)
    r = roles_.infer_roles(df)
    numeric, text = roles_.meaningful_numeric(r), roles_.meaningful_categorical(r)
    listed = lambda frame: [x.asDict() for x in frame.collect()]
    pairs = [(a, b) for i, a in enumerate(text) for b in text[i + 1 :]][:max_pairs]
    return {
        "numeric_statistics": listed(statistics_.column_statistics(df, numeric)) if numeric else [],
        "outliers": listed(statistics_.outlier_counts(df, numeric)) if numeric else [],
        "normality": listed(statistics_.dagostino(df, numeric)) if numeric else [],
        "categorical_statistics": listed(statistics_.entropy(df, text)) if text else [],
        "bivariate": {"numeric_pairs": listed(profile_.correlations(df, numeric, 6))[:max_pairs] if len(numeric) > 1 else [], "categorical_pairs": [bivariate.chi_square(df, a, b).first().asDict() | {"left": a, "right": b} for a, b in pairs]},
    }


def anomalies(data: object, *, keys: list[str] | None = None, contamination: float = 0.05, max_columns: int = 30, top_k: int = 25) -> dict:
    df = _frame(data)
    r = roles_.infer_roles(df)
    names = roles_.meaningful_numeric(r)[:max_columns]
    keys = keys or roles_.columns_with_role(r, "id_like")[:1] or df.columns[:1]
    names = [n for n in names if n not in keys]
    if not names:
        return {"available": False, "reason": "no usable numeric column"}
    return {"available": True, "method": "fast_scan", "used_columns": names, "top_rows": [x.asDict() for x in anomaly.fast_scan(df, names, keys, contamination, top_k=top_k).collect()]}


def relationships(data: object, *, min_abs_correlation: float = 0.8, max_sample_rows: int = 512, projections: int = 64) -> dict:
    df = _frame(data)
    r = roles_.infer_roles(df)
    return bivariate.relationship_graph(df, roles_.meaningful_numeric(r), df.columns[:1], min_abs_correlation, max_sample_rows, projections)


def target_analysis(data: object, *, target: str) -> dict:
    return target_.target_analysis(_frame(data), target)


def analyze(data: object, *, target: str | None = None, mode: str | None = None, preset: str | None = None, config: str | None = None, disabled_modules: list[str] | None = None) -> dict:
    return analyze_.analyze(_frame(data), resolve_config(preset, config, mode=mode, target=target, disabled_modules=disabled_modules))


def plan(data: object, *, target: str | None = None, mode: str | None = None, preset: str | None = None, config: str | None = None, disabled_modules: list[str] | None = None) -> dict:
    return analyze_.plan(_frame(data), resolve_config(preset, config, mode=mode, target=target, disabled_modules=disabled_modules))


def plan_cleaning(data: object) -> dict:
    return cleaning.infer_plan(_frame(data))


def clean(data: object, *, plan: dict | None = None) -> DataFrame:
    df = _frame(data)
    return cleaning.apply_plan(df, plan or cleaning.infer_plan(df))


def compare(reference: object, current: object, *, columns: list[str] | None = None, max_columns: int = 30) -> dict:
    return drift.compare(_frame(reference), _frame(current), columns, max_columns)


def infer_contract(data: object, **options) -> dict:
    return contracts.infer_contract(_frame(data), **options)


def validate(data: object, contract: dict) -> dict:
    return contracts.validate(_frame(data), contract)


def gate(current: object, *, reference: object = None, **options) -> dict:
    return gate_.gate(_frame(current), reference=None if reference is None else _frame(reference), **options)


def model_leaderboard(data: object, *, target: str, folds: int = 5) -> list[dict]:
    return [r.asDict() for r in ml.leaderboard(_frame(data), target, folds).collect()]


def system_info() -> dict:
    spark = SparkSession.getActiveSession()
    return {"python": platform.python_version(), "cpus": os.cpu_count(), "spark": spark.version if spark else None, "master": spark.sparkContext.master if spark else None, "parallelism": spark.sparkContext.defaultParallelism if spark else None, "gpu": False}


def to_json(result: dict) -> str:
    return json.dumps(result, indent=1, sort_keys=True, default=str)


def to_html(result: dict, title: str = "Analysis") -> str:
    """A plain report: one table of paths and values for each section."""
    from .operators.charts import facts

    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for section, value in result.items():
        rows = "".join(f"<tr><td>{escape(p)}</td><td>{escape(v)}</td></tr>" for p, v in facts(value))
        parts.append(f"<h2>{escape(section)}</h2><table>{rows}</table>")
    return "".join(parts) + "</body></html>"
