"""Signals, findings, recommendations and the choice of analyses."""

from __future__ import annotations

from .roles import SEMANTIC
from .scoring import fairness_review

LISTED_ROLES = ("id_like", "price_like", "quantity_like", "time_like", "long_text", "binary", "low_cardinality", "high_cardinality", "unique_like", "constant", "target_candidate")
SEVERITIES = ("critical", "high", "medium", "low", "info", "none")


def dataset_signals(profile: dict, roles: dict) -> dict:
    """Facts about a table that steer its analysis."""
    rows, columns = profile["shape"]["rows"], profile["shape"]["columns"]
    having = lambda r: [n for n, x in roles.items() if r in x["roles"]]
    strong = sorted({tuple(sorted((a, b))) for a, row in profile["correlations"].items() for b, r in row.items() if a != b and r is not None and abs(r) >= 0.98})
    gaps = [n for n, p in profile["missing_percent"].items() if p >= 20]
    cells = rows * columns
    missing = 100 * sum(profile["missing_counts"].values()) / cells if cells else 0.0
    low = {n.lower() for n in profile["columns"]}
    # one flag and one list a role, under the role's name
    by_role = {role: having(role) for role in (*LISTED_ROLES, *(f"{k}_like" for k in SEMANTIC))}
    lists = {f"{role}_columns": names for role, names in by_role.items()} | {"sensitive_columns": fairness_review(profile["columns"])["sensitive_columns"]}
    flags = {f"has_{role}_columns": bool(names) for role, names in by_role.items()}
    counts = {"row_count": rows, "column_count": columns, "numeric_column_count": len(profile["numeric_columns"]), "categorical_column_count": len(profile["categorical_columns"]), "date_column_count": len(profile["date_columns"]), "missing_percent": round(missing, 2), "duplicate_rows": profile["duplicate_rows"]}
    return counts | flags | lists | {
        "has_numeric_columns": bool(profile["numeric_columns"]), "has_multiple_numeric_columns": len(profile["numeric_columns"]) > 1, "has_categorical_columns": bool(profile["categorical_columns"]), "has_text_columns": bool(profile["categorical_columns"]),
        "has_datetime_columns": bool(profile["date_columns"]), "has_missing_values": missing > 0, "has_high_missingness": missing >= 20, "has_bid_ask_columns": {"bid", "ask"} <= low,
        "has_time_series_structure": bool(having("time_like")) and bool(profile["numeric_columns"]) and rows >= 20, "has_sensitive_column_candidates": bool(lists["sensitive_columns"]), "has_potential_leakage": bool(strong),
        "is_small_dataset": rows < 200, "is_large_dataset": rows >= 100_000, "is_wide_dataset": columns >= 50,
        "is_small": rows < 100, "is_large": rows >= 100_000, "is_wide": columns >= 100, "has_missing": any(profile["missing_counts"].values()), "has_duplicates": profile["duplicate_rows"] > 0,
        "has_numeric": bool(profile["numeric_columns"]), "has_categorical": bool(profile["categorical_columns"]), "has_dates": bool(profile["date_columns"]), "has_text": bool(having("long_text")),
        "has_ids": bool(having("id_like")), "has_constants": bool(having("constant")), "has_target_candidates": bool(having("target_candidate")), "possible_leakage": bool(strong),
        "id_columns": having("id_like"), "constant_columns": having("constant"), "date_columns": profile["date_columns"], "text_columns": having("long_text"), "high_missing_columns": gaps,
        "strong_pairs": [list(p) for p in strong], "target_candidates": having("target_candidate"),
    }


def findings(signals: dict, quality: dict | None = None, target: dict | None = None) -> list[dict]:
    """Findings of all parts with stable codes, merged by code, the most severe first."""
    out: list[dict] = []
    add = lambda code, severity, text, columns=(): out.append({"code": code, "severity": severity, "message": text, "columns": list(columns)})
    if signals["has_duplicates"]:
        add("signal.has_duplicates", "medium", "There are duplicate rows.")
    if signals["high_missing_columns"]:
        add("signal.high_missing", "medium", "Columns miss a fifth of their values or more.", signals["high_missing_columns"])
    if signals["constant_columns"]:
        add("signal.constant_columns", "low", "Columns hold one value.", signals["constant_columns"])
    if signals["possible_leakage"]:
        add("signal.possible_leakage", "high", "Columns are nearly equal.", sorted({c for p in signals["strong_pairs"] for c in p}))
    for key, code, severity in (("identifier_duplicates", "identifier_duplicates", "high"), ("quasi_constant_columns", "quasi_constant", "low"), ("coercion_candidates", "coercion", "medium"), ("category_normalisation", "category_normalisation", "low"), ("blank_strings", "blank_strings", "low"), ("infinite_values", "infinite_values", "high")):
        for r in (quality or {}).get(key, []):
            add(f"quality.{code}.{r['column']}", severity, f"{key.replace('_', ' ')}: {r['column']}", [r["column"]])
    for key, code, severity in (("duplicate_columns", "duplicate_columns", "medium"), ("missingness_relationships", "missingness_relationship", "info")):
        for r in (quality or {}).get(key, []):
            add(f"quality.{code}.{r['left']}.{r['right']}", severity, f"{r['left']} and {r['right']}", [r["left"], r["right"]])
    for r in (target or {}).get("leakage", []):
        add(f"target.leakage.{r['feature']}", r["severity"], f"{r['feature']} may leak the target", [r["feature"]])
    merged: dict[str, dict] = {}
    for f in out:
        old = merged.setdefault(f["code"], f)
        if SEVERITIES.index(f["severity"]) < SEVERITIES.index(old["severity"]):
            merged[f["code"]] = f
    return sorted(merged.values(), key=lambda f: (SEVERITIES.index(f["severity"]), f["code"]))


def recommendations(found: list[dict]) -> list[str]:
    advice = {"signal.has_duplicates": "Remove duplicate rows.", "signal.high_missing": "Fill or drop columns with many missing values.", "signal.constant_columns": "Drop constant columns.", "signal.possible_leakage": "Drop one of each pair of nearly equal columns."}
    return list(dict.fromkeys(advice[f["code"]] for f in found if f["code"] in advice))


#: Analyses with the lightest mode that runs them, the signals they need (all, or one of several), the
#: least rows, and whether a target must be given.
INVENTORY = (
    ("ingestion_analysis", "quick", (), (), 0, False),
    ("structural_profile", "quick", (), (), 0, False),
    ("column_role_analysis", "quick", (), (), 0, False),
    ("missing_value_analysis", "quick", (), (), 0, False),
    ("high_missingness_analysis", "standard", ("has_high_missingness",), (), 0, False),
    ("duplicate_analysis", "quick", (), (), 0, False),
    ("id_column_detection", "standard", ("has_id_like_columns",), (), 0, False),
    ("descriptive_statistics", "quick", ("has_numeric_columns",), (), 0, False),
    ("distribution_analysis", "standard", ("has_numeric_columns",), (), 0, False),
    ("normality_tests", "deep", ("has_numeric_columns",), (), 8, False),
    ("outlier_analysis", "standard", ("has_numeric_columns",), (), 0, False),
    ("correlation_analysis", "standard", ("has_multiple_numeric_columns",), (), 0, False),
    ("categorical_analysis", "standard", ("has_categorical_columns",), (), 0, False),
    ("chi_square_analysis", "deep", ("has_categorical_columns",), (), 0, False),
    ("text_analysis", "deep", ("has_long_text_columns",), (), 0, False),
    ("date_time_analysis", "standard", ("has_datetime_columns",), (), 0, False),
    ("data_quality_scoring", "quick", (), (), 0, False),
    ("cleaning_analysis", "standard", (), (), 0, False),
    ("ml_readiness", "standard", (), (), 0, False),
    ("leakage_detection", "standard", (), (), 0, False),
    ("target_analysis", "standard", (), (), 0, True),
    ("feature_importance", "research", ("has_numeric_columns",), (), 0, True),
    ("baseline_model", "research", ("has_numeric_columns",), (), 0, True),
    ("anomaly_detection", "standard", ("has_numeric_columns",), (), 0, False),
    ("fairness_review", "standard", ("has_sensitive_column_candidates",), (), 0, False),
    ("privacy_analysis", "standard", (), ("has_sensitive_column_candidates", "has_email_like_columns"), 0, False),
    ("time_series_signal", "standard", ("has_time_series_structure",), (), 0, False),
    ("ai_summary", "standard", (), (), 0, False),
)
MODES = ("quick", "standard", "deep", "research")


def select_analyses(signals: dict, rows: int, target: str | None = None, mode: str = "research") -> dict[str, list]:
    """The analyses that a table calls for in a mode, and the others with the first reason against them."""
    chosen, skipped = [], []
    for name, lightest, needs, either, least, wants_target in INVENTORY:
        missing = [n for n in needs if not signals.get(n)]
        reasons = (
            (MODES.index(mode) < MODES.index(lightest), f"needs mode {lightest}"),
            (missing, f"needs {', '.join(missing)}"),
            (either and not any(signals.get(n) for n in either), f"needs one of {', '.join(either)}"),
            (rows < least, f"needs {least} rows"),
            (wants_target and not target, "needs a target"),
        )
        why = next((text for fails, text in reasons if fails), "")
        (skipped if why else chosen).append({"analysis": name, "reason": why} if why else name)
    return {"selected": chosen, "skipped": skipped}


def display_cards(profile: dict, health: dict | None = None, quality: dict | None = None) -> list[dict]:
    """One card a topic with a value, a severity of 30 (act), 10 (look) or 0, and the columns it is about; the most severe first."""
    rows, columns = profile["shape"]["rows"], profile["shape"]["columns"]
    gaps = sum(profile["missing_counts"].values())
    share = round(100 * gaps / (rows * columns), 2) if rows and columns else 0.0
    worst = [n for n, p in profile["missing_percent"].items() if p >= 20]
    strong = sorted({n for a, row in profile["correlations"].items() for b, r in row.items() if a != b and r is not None and abs(r) >= 0.9 for n in (a, b)})
    grade = lambda x, look, act: 30 if x >= act else 10 if x >= look else 0
    cards = [
        ("shape", f"{rows} x {columns}", 30 if not rows or not columns else 0, []),
        ("missing", share, grade(share, 1, 20), worst),
        ("duplicates", profile["duplicate_percent"], grade(profile["duplicate_percent"], 0.01, 5), []),
        ("correlated", len(strong), grade(len(strong), 2, 10), strong),
        ("categorical", len(profile["categorical_columns"]), 0, profile["categorical_columns"]),
        ("dates", len(profile["date_columns"]), 0, profile["date_columns"]),
    ]
    if health:
        score = health["overall_score"]
        cards.append(("health", score, 30 if score < 60 else 10 if score < 75 else 0, []))
    if quality:
        found = sum(quality["summary"].values())
        cards.append(("quality", found, grade(found, 1, 10), []))
    return sorted(({"card": c, "value": v, "severity": s, "columns": n} for c, v, s, n in cards), key=lambda c: -c["severity"])
