"""Comparable snapshots of results, and their history."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT_VERSION = 1


def fingerprint(state: dict) -> str:
    return hashlib.sha256(json.dumps(state, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def create_snapshot(result: dict, source: str = "dataframe") -> dict:
    """The comparable part of a result with profile, health, ml_readiness and findings."""
    profile = result.get("profile", {})
    state = {
        "dataset": {"shape": profile.get("shape"), "dtypes": profile.get("dtypes", {}), "missing_percent": profile.get("missing_percent", {})},
        "health": result.get("health", {}).get("overall_score"),
        "ml_readiness": result.get("ml_readiness", {}).get("score"),
        "finding_codes": sorted({f["code"] for f in result.get("findings", [])}),
        "config": result.get("config", {}),
    }
    return {"snapshot_schema_version": SNAPSHOT_VERSION, "created_at": datetime.now(timezone.utc).isoformat(), "source": source, "fingerprint": fingerprint(state), "state": state}


def save_snapshot(snapshot: dict, path: str) -> None:
    Path(path).write_text(json.dumps(snapshot, indent=1, sort_keys=True, default=str))


def load_snapshot(path: str) -> dict:
    found = json.loads(Path(path).read_text())
    if found.get("snapshot_schema_version") != SNAPSHOT_VERSION or fingerprint(found["state"]) != found["fingerprint"]:
        raise ValueError("not a snapshot, or changed since it was written")
    return found


def compare_snapshots(old: dict, new: dict) -> dict:
    a, b = old["state"], new["state"]
    x, y = a["dataset"]["dtypes"], b["dataset"]["dtypes"]
    gap = {n: round(b["dataset"]["missing_percent"].get(n, 0) - a["dataset"]["missing_percent"].get(n, 0), 2) for n in sorted(set(x) & set(y))}
    delta = lambda k: round(b[k] - a[k], 2) if a[k] is not None and b[k] is not None else None
    return {
        "changed": old["fingerprint"] != new["fingerprint"],
        "fingerprints": [old["fingerprint"], new["fingerprint"]],
        "schema": {"added": sorted(set(y) - set(x)), "removed": sorted(set(x) - set(y)), "changed": sorted(n for n in set(x) & set(y) if x[n] != y[n])},
        "missingness_changes": {n: d for n, d in gap.items() if d},
        "health_delta": delta("health"),
        "ml_readiness_delta": delta("ml_readiness"),
        "findings": {"new": sorted(set(b["finding_codes"]) - set(a["finding_codes"])), "resolved": sorted(set(a["finding_codes"]) - set(b["finding_codes"]))},
    }


class SnapshotHistory:
    """An append-only Parquet table of snapshots."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, snapshot: dict) -> None:
        s = snapshot["state"]
        row = (snapshot["created_at"], snapshot["source"], snapshot["fingerprint"], *(None if s[k] is None else float(s[k]) for k in ("health", "ml_readiness")), json.dumps(snapshot, default=str))
        self.spark.createDataFrame([row], "created_at string, source string, fingerprint string, health double, ml_readiness double, snapshot string").write.mode("append").parquet(self.path)

    def frame(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def latest(self, n: int = 1) -> list[dict]:
        return [json.loads(r["snapshot"]) for r in self.frame().orderBy(F.desc("created_at"), "fingerprint").limit(n).collect()]

    def previous(self) -> dict | None:
        found = self.latest(2)
        return found[1] if len(found) > 1 else None

    def compare_latest(self) -> dict | None:
        found = self.latest(2)
        return compare_snapshots(found[1], found[0]) if len(found) > 1 else None

    def timeline(self) -> DataFrame:
        """(created_at, source, fingerprint, health, health_delta, changed), one row a snapshot."""
        w = Window.partitionBy("source").orderBy("created_at")
        return self.frame().select("created_at", "source", "fingerprint", "health", (F.col("health") - F.lag("health").over(w)).alias("health_delta"), (F.col("fingerprint") != F.lag("fingerprint").over(w)).alias("changed"))
