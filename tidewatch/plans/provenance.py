"""How a part of a result came about."""

from __future__ import annotations

METHODS = ("exact", "approximate", "sampled", "fitted_on_sample", "skipped")
#: The method of each part of an analysis; parts fitted on a sample still judge all rows.
PARTS = {
    "profile": "exact", "column_roles": "exact", "health": "exact", "ml_readiness": "exact", "quality_diagnostics": "exact", "deep_statistics_v2": "exact", "time_series": "exact",
    "text_profile": "exact", "target_intelligence": "exact", "segments": "exact", "cleaning": "exact", "model_leaderboard": "exact", "feature_importance": "exact",
}


def provenance(result: dict, rows: int, fit_rows: int) -> dict[str, dict]:
    """{part: method, rows used, rows of the table} for the parts of a result; failed and absent parts are skipped."""
    out = {}
    for part, method in PARTS.items():
        value = result.get(part)
        absent = value is None or (isinstance(value, dict) and value.get("available") is False)
        out[part] = {"method": "skipped" if absent else method, "rows_used": 0 if absent else rows, "rows": rows}
    ensemble = result.get("execution", {}).get("anomaly_method") == "ensemble"
    if "anomalies_v2" in result:
        out["anomalies_v2"] = {"method": "fitted_on_sample" if ensemble else "exact", "rows_used": min(rows, fit_rows) if ensemble else rows, "rows": rows}
    return out
