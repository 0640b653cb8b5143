"""The whole analysis of one table, and its plan."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions import expressions as X
from ..operators.facts import Facts, held
from ..operators import anomaly, cleaning, ensemble, profile, quality, roles, scoring, series, signals, statistics, target, text
from ..result import Result
from .budget import derive_budget
from .config import Config
from .provenance import provenance


def plan(df: DataFrame, config: Config | None = None) -> dict:
    """What an analysis would do, from a head of 5,000 rows and the row count."""
    config = config or Config()
    head = df.limit(5_000)
    rows = df.count()
    facts = Facts(head)
    p, r = profile.build_profile(head, facts=facts), roles.infer_roles(head, facts)
    s = signals.dataset_signals(p, r)
    budget = derive_budget(rows, len(df.columns), config.mode)
    return {"analysis_mode": config.mode, "target": config.target, "shape": {"rows": rows, "columns": len(df.columns)}, "execution_budget": budget.limits, "scale": budget.scale, "signals": s, "selection": signals.select_analyses(s, rows, config.target, config.mode), "planning_data": {"rows": min(rows, 5_000), "sampled": rows > 5_000}}


def _safe(part: Callable[[], object]) -> object:
    """One module's failure is reported in its place."""
    try:
        return part()
    except Exception as e:
        return {"available": False, "error": f"{type(e).__name__}: {e}"}


def analyze(df: DataFrame, config: Config | None = None, name: str = "dataframe") -> dict:
    """Every part that the configuration enables, over all rows; a small table is kept in memory meanwhile."""
    with held(df) as kept:
        return _analyze(kept, config, name)


def _analyze(df: DataFrame, config: Config | None, name: str) -> dict:
    config = config or Config()
    took: dict[str, float] = {}
    out: dict = {"filename": name, "analysis_mode": config.mode, "execution": {"method": "distributed", "sampled": False}}

    def step(key: str, part: Callable[[], object], module: str | None = None) -> None:
        if module is None or config.enabled(module):
            began = time.time()
            out[key] = _safe(part) if module else part()
            took[key] = round(1000 * (time.time() - began), 1)

    facts = Facts(df)
    step("profile", lambda: profile.build_profile(df, facts=facts))
    step("column_roles", lambda: roles.infer_roles(df, facts))
    p, r = out["profile"], out["column_roles"]
    out["roles_summary"] = roles.summarize_roles(r)
    out["dataset_signals"] = signals.dataset_signals(p, r)
    out["analysis_selection"] = signals.select_analyses(out["dataset_signals"], p["shape"]["rows"], config.target, config.mode)
    step("health", lambda: scoring.health_score(df, p, facts))
    step("ml_readiness", lambda: scoring.readiness_from(p))
    step("quality_diagnostics", lambda: quality.run_quality(df, roles=r, facts=facts), "quality")
    budget = derive_budget(p["shape"]["rows"], p["shape"]["columns"], config.mode)
    out["execution"]["budget"] = budget.limits
    numeric = roles.meaningful_numeric(r)[:30]
    deep = statistics.triage(facts, roles.meaningful_numeric(r), budget.limits["deep_columns"])
    step("deep_statistics_v2", lambda: [x.asDict() for x in statistics.column_statistics(df, deep).collect()], "deep_statistics")
    keys = roles.columns_with_role(r, "id_like")[:1] or df.columns[:1]
    judged = [n for n in numeric if n not in keys]
    if config.mode == "research":
        step("anomalies_v2", lambda: [x.asDict(True) for x in ensemble.ensemble(df, judged, keys, sample_rows=budget.limits["fit_rows"]).collect()], "anomaly_detection")
    else:
        step("anomalies_v2", lambda: [x.asDict() for x in anomaly.fast_scan(df, judged, keys).collect()], "anomaly_detection")
    out["execution"]["anomaly_method"] = "ensemble" if config.mode == "research" else "fast_scan"
    dates = X.date_columns(df)
    if dates and numeric:
        step("time_series", lambda: series.whole_series(series.regular_series(df, dates[0], series.pick_series(df, config.target) or numeric[0])).first().asDict(), "time_series")
    step("text_profile", lambda: text.profile_text(df, [n for n in p["categorical_columns"] if dict(df.dtypes)[n] == "string"]), "text_profile")
    if config.target:
        step("target_intelligence", lambda: target.target_analysis(df, config.target), "target_intelligence")
        step("segments", lambda: target.segment_analysis(df, config.target), "segments")
    if config.target and config.enabled("modeling"):
        from ..operators import ml

        step("model_leaderboard", lambda: [x.asDict() for x in ml.leaderboard(df, config.target).collect()], "modeling")
        step("feature_importance", lambda: [x.asDict() for x in ml.feature_importance(df, config.target).collect()], "explainability")
    step("cleaning", lambda: cleaning.infer_plan(df), "cleaning")
    out["display_cards"] = signals.display_cards(p, out["health"], out.get("quality_diagnostics"))
    if config.mode == "research" and deep and 0 < p["shape"]["rows"] <= 2_000:
        step("bootstrap", lambda: [x.asDict() for x in statistics.bootstrap_interval(df, deep, df.columns).collect()], "deep_statistics")
    out["provenance"] = provenance(out, p["shape"]["rows"], budget.limits["fit_rows"])
    found = signals.findings(out["dataset_signals"], out.get("quality_diagnostics"), out.get("target_intelligence"))
    return Result(out | {"findings": found, "recommendations": signals.recommendations(found), "config": {"mode": config.mode, "disabled_modules": list(config.disabled_modules)}, "timings_ms": took, "result_schema_version": 1})
