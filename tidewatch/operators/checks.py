"""User-defined checks and their plugins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame

GROUP = "tidewatch.checks"


@dataclass(frozen=True)
class DataCheck:
    """A named test of a whole table. The function returns a boolean, a Column that must hold in every row, or a dictionary with `passed`."""

    name: str
    function: Callable[[DataFrame], object]
    severity: str = "error"
    description: str = ""

    def __post_init__(self) -> None:
        if self.severity not in ("error", "warning") or not self.name:
            raise ValueError("a check needs a name and the severity error or warning")


def check(name: str | Callable | None = None, *, severity: str = "error", description: str | None = None):
    """Decorator that makes a DataCheck of a function, with or without arguments."""

    def make(function: Callable) -> DataCheck:
        title = name if isinstance(name, str) else function.__name__
        return DataCheck(title, function, severity, description or (function.__doc__ or "").strip())

    return make(name) if callable(name) else make


def _outcome(df: DataFrame, item: DataCheck) -> dict:
    try:
        got = item.function(df)
        if isinstance(got, Column):
            broken = df.where(~got | got.isNull()).count()
            got = {"passed": broken == 0, "message": f"{broken} rows fail" if broken else "", "details": {"failing_rows": broken}}
        if isinstance(got, dict):
            if "passed" not in got:
                raise ValueError("the result has no `passed`")
            passed, message, details = bool(got["passed"]), str(got.get("message", "")), got.get("details") or {}
        else:
            passed, message, details = bool(got), "", {}
        failure = None
    except Exception as e:  # a broken check is a finding, not a crash
        passed, message, details, failure = False, str(e), {}, type(e).__name__
    return {"name": item.name, "severity": item.severity, "description": item.description, "passed": passed, "message": message, "details": details, "exception": failure}


def run_checks(df: DataFrame, checks: Iterable[DataCheck]) -> dict:
    """Results in order; a failed error check fails the run, a failed warning warns."""
    checks = list(checks)
    names = [c.name for c in checks]
    if len(set(names)) != len(names):
        raise ValueError("check names must be unique")
    results = [_outcome(df, c) for c in checks]
    errors = [r for r in results if not r["passed"] and r["severity"] == "error"]
    warnings = [r for r in results if not r["passed"] and r["severity"] == "warning"]
    return {
        "status": "fail" if errors else "warn" if warnings else "pass", "passed": not errors, "results": results, "findings": errors + warnings,
        "summary": {"checks": len(results), "passed": sum(r["passed"] for r in results), "warnings": len(warnings), "errors": len(errors)}, "execution": {"method": "exact", "sampled": False},
    }


def discover_checks(group: str = GROUP) -> list[DataCheck]:
    """Checks of installed packages by entry point, sorted by name; duplicates are refused."""
    found: list[DataCheck] = []
    for point in sorted(entry_points(group=group), key=lambda p: p.name):
        loaded = point.load()
        found += list(loaded) if isinstance(loaded, (list, tuple)) else [loaded]
    names = [c.name for c in found]
    if len(set(names)) != len(names):
        raise ValueError("two plugins offer a check of the same name")
    return sorted(found, key=lambda c: c.name)
