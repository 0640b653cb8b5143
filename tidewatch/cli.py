"""Command line: python -m tidewatch.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import api
from .operators import snapshots
from .session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewatch")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("inspect", "profile", "plan", "analyze", "snapshot", "infer-contract", "clean"):
        p = sub.add_parser(name)
        p.add_argument("data")
        p.add_argument("--output")
        if name in ("plan", "analyze", "snapshot"):
            p.add_argument("--target")
            p.add_argument("--mode")
            p.add_argument("--preset")
            p.add_argument("--config")
        if name == "analyze":
            p.add_argument("--html")
    p = sub.add_parser("compare")
    p.add_argument("reference")
    p.add_argument("current")
    p.add_argument("--output")
    p = sub.add_parser("validate")
    p.add_argument("data")
    p.add_argument("contract")
    p.add_argument("--output")
    p = sub.add_parser("gate")
    p.add_argument("data")
    p.add_argument("--reference")
    p.add_argument("--contract")
    p.add_argument("--warn-on", default="moderate")
    p.add_argument("--fail-on", default="severe")
    p.add_argument("--output")
    p = sub.add_parser("compare-snapshots")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("--output")
    sub.add_parser("system-info").add_argument("--output")
    return top


def run(argv: list[str]) -> tuple[dict, int]:
    """The result and the exit status: 1 if a validation or a gate fails."""
    a = parser().parse_args(argv)
    if a.command == "compare-snapshots":
        return snapshots.compare_snapshots(snapshots.load_snapshot(a.old), snapshots.load_snapshot(a.new)), 0
    local_session()
    load = lambda path: json.loads(Path(path).read_text()) if path else None
    options = {k: getattr(a, k, None) for k in ("target", "mode", "preset", "config")}
    match a.command:
        case "inspect":
            return api.inspect_source(a.data), 0
        case "profile":
            return api.profile(a.data), 0
        case "plan":
            return api.plan(a.data, **options), 0
        case "analyze":
            result = api.analyze(a.data, **options)
            if a.html:
                Path(a.html).write_text(api.to_html(result))
            return result, 0
        case "snapshot":
            return snapshots.create_snapshot(api.analyze(a.data, **options), a.data), 0
        case "infer-contract":
            return api.infer_contract(a.data), 0
        case "clean":
            plan = api.plan_cleaning(a.data)
            from .operators.cleaning import write_clean_csv

            write_clean_csv(api._frame(a.data), a.output or "cleaned.csv", plan)
            a.output = None
            return plan, 0
        case "compare":
            return api.compare(a.reference, a.current), 0
        case "validate":
            result = api.validate(a.data, load(a.contract))
            return result, int(not result["valid"])
        case "gate":
            result = api.gate(a.data, reference=a.reference, contract=load(a.contract), drift_warn_on=a.warn_on, drift_fail_on=a.fail_on)
            return result, int(not result["passed"])
    return api.system_info(), 0


def main() -> int:
    result, status = run(sys.argv[1:])
    output = getattr(parser().parse_args(sys.argv[1:]), "output", None)
    text = api.to_json(result)
    if output and sys.argv[1] != "clean":
        Path(output).write_text(text)
    else:
        print(text)
    return status


if __name__ == "__main__":
    sys.exit(main())
