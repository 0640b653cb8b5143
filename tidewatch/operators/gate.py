"""One verdict out of a contract, drift and custom checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .checks import DataCheck, run_checks
from .contracts import validate
from .drift import SEVERITIES, at_least, compare


def gate(current: DataFrame, *, reference: DataFrame | None = None, contract: dict | None = None, custom_checks: list[DataCheck] | None = None, columns: list[str] | None = None, max_columns: int = 30, drift_warn_on: str = "moderate", drift_fail_on: str = "severe", fail_on_validation_warning: bool = False) -> dict:
    """pass, warn or fail; a part that cannot be computed fails. Any severity, `stable` too, may be a threshold."""
    if reference is None and contract is None and not custom_checks:
        raise ValueError("a gate needs a reference, a contract or checks")
    if drift_warn_on not in SEVERITIES or drift_fail_on not in SEVERITIES or SEVERITIES.index(drift_warn_on) > SEVERITIES.index(drift_fail_on):
        raise ValueError("the warning threshold must not lie above the failing one")
    parts, reasons = {}, []
    if contract is not None:
        found = validate(current, contract)
        status = "fail" if found["status"] == "warn" and fail_on_validation_warning else found["status"]
        parts["contract"] = found | {"status": status}
        reasons += [f"contract: {f['column']} {f['code']}" for f in found["findings"]]
    if reference is not None:
        found = compare(reference, current, columns, max_columns)
        verdict = found["summary"]["overall_verdict"]
        if not found["summary"]["n_columns_available"]:
            status = "fail"
            reasons.append("drift: no comparable column")
        else:
            status = "fail" if at_least(verdict, drift_fail_on) else "warn" if at_least(verdict, drift_warn_on) else "pass"
            reasons += [f"drift: {r}" for r in found["gate"]["reasons"]] if status != "pass" else []
        parts["drift"] = found | {"status": status}
    if custom_checks:
        found = run_checks(current, custom_checks)
        parts["checks"] = found
        reasons += [f"check: {f['name']} {f['message']}".strip() for f in found["findings"]]
    order = ("pass", "warn", "fail")
    status = max((p["status"] for p in parts.values()), key=order.index)
    return {"status": status, "passed": status != "fail", "checks_run": list(parts), "thresholds": {"drift_warn_on": drift_warn_on, "drift_fail_on": drift_fail_on}, "reasons": reasons, "checks": parts, "execution": {"method": "exact", "sampled": False}}
