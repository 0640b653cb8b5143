"""Results of an analysis: dictionaries that can be asked."""

from __future__ import annotations

import json


class Result(dict):
    """A nested result with look-ups. It is a plain dictionary to all else."""

    def section(self, path: str, default: object = None) -> object:
        """The value at a dotted path; list items by number."""
        here: object = self
        for step in path.split("."):
            if isinstance(here, dict) and step in here:
                here = here[step]
            elif isinstance(here, (list, tuple)) and step.isdigit() and int(step) < len(here):
                here = here[int(step)]
            else:
                return default
        return here

    def columns(self) -> list[str]:
        return list(self.section("profile.columns", []))

    def column(self, name: str) -> dict:
        """All that is known about one column."""
        if name not in self.columns():
            raise KeyError(name)
        p = self["profile"]
        out = {"column": name, "dtype": p["dtypes"][name], "missing_percent": p["missing_percent"][name]}
        out |= {k: v[name] for k, v in (("numeric", p["numeric_summary"]), ("categorical", p["categorical_summary"]), ("roles", self.get("column_roles", {}))) if name in v}
        related = sorted(((n, r) for n, r in p["correlations"].get(name, {}).items() if n != name and r is not None), key=lambda r: (-abs(r[1]), r[0]))
        return out | {"correlated": related[:5], "findings": [f for f in self.get("findings", []) if name in f["columns"]]}

    def summary(self) -> dict:
        """Shape, scores and the number of findings by severity."""
        counts: dict[str, int] = {}
        for f in self.get("findings", []):
            counts[f["severity"]] = counts.get(f["severity"], 0) + 1
        scores = {k: self.section(p) for k, p in (("health", "health.overall_score"), ("ml_readiness", "ml_readiness.score"))}
        return {"shape": self.section("profile.shape"), "mode": self.get("analysis_mode")} | scores | {"findings": counts}

    def top_anomalies(self, k: int = 10) -> list[dict]:
        rows = self.get("anomalies_v2")
        return list(rows[:k]) if isinstance(rows, list) else []

    def search(self, text: str, most: int = 20) -> list[tuple[str, str]]:
        """(path, value) leaves whose path or value holds the text, whatever its case."""
        from .operators.charts import facts

        want = text.lower()
        return [f for f in facts(self) if want in f[0].lower() or want in f[1].lower()][:most]

    def brief(self) -> str:
        s = self.summary()
        shape = s["shape"] or {"rows": 0, "columns": 0}
        lines = [f"{shape['rows']} rows, {shape['columns']} columns; health {s['health']}, readiness {s['ml_readiness']}."]
        return "\n".join(lines + [f"- {f['severity']}: {f['message']}" for f in self.get("findings", [])[:5]])

    def to_json(self) -> str:
        return json.dumps(self, indent=1, sort_keys=True, default=str)

    def to_html(self, title: str = "Analysis") -> str:
        from .api import to_html

        return to_html(self, title)

    def to_snapshot(self) -> dict:
        from .operators.snapshots import create_snapshot

        return create_snapshot(self)
