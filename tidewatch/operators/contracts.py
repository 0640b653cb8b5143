"""Data contracts: inferred from one table, validated on another."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from . import profile as P

VERSION = 2
TYPES = ("boolean", "datetime", "integer", "number", "string")


def _bounds(df: DataFrame, names: list[str]) -> dict[str, tuple]:
    if not names:
        return {}
    cells = []
    for k, n in enumerate(names):
        x = X.finite(df, n) if X.family(df.schema[n].dataType) in ("integer", "number") else F.col(f"`{n}`")
        cells += [F.min(x).alias(f"lo{k}"), F.max(x).alias(f"hi{k}")]
    row = df.agg(*cells).first()
    return {n: (row[f"lo{k}"], row[f"hi{k}"]) for k, n in enumerate(names)}


def infer_contract(df: DataFrame, numeric_tolerance: float = 0.05, max_categories: int = 20, null_fraction_tolerance: float = 0.05, infer_unique: bool = True, min_unique_rows: int = 20, allow_extra_columns: bool = False) -> dict:
    """Types, null shares, widened bounds, small value sets and uniqueness, from the whole table."""
    rows = df.count()
    gaps = {r["column"]: r["missing_count"] for r in P.missing_counts(df).collect()}
    counts = {r["column"]: r["distinct_values"] for r in P.distinct_counts(df).collect()}
    families = {f.name: X.family(f.dataType) for f in df.schema}
    numbers = [n for n, f in families.items() if f in ("integer", "number")]
    observed = _bounds(df, numbers)
    small = [n for n, f in families.items() if f == "string" and isinstance(df.schema[n].dataType, T.StringType) and 0 < counts.get(n, 0) <= max_categories]
    values = df.agg(*[F.sort_array(F.collect_set(f"`{n}`")).alias(str(k)) for k, n in enumerate(small)]).first() if small else []
    columns = {}
    for n, family in families.items():
        lo, hi = observed.get(n, (None, None))
        low = high = None
        if lo is not None:
            pad = (hi - lo) * numeric_tolerance
            low, high = (math.floor(lo - pad), math.ceil(hi + pad)) if family == "integer" else (lo - pad, hi + pad)
        share = gaps[n] / rows if rows else 0.0
        columns[n] = {
            "type": family,
            "required": True,
            "nullable": gaps[n] > 0,
            "max_null_fraction": min(1.0, share + null_fraction_tolerance) if gaps[n] else 0.0,
            "minimum": low,
            "maximum": high,
            "observed_minimum": lo,
            "observed_maximum": hi,
            "allowed_values": values[small.index(n)] if n in small else None,
            "allowed_values_severity": "error",
            "unique": bool(infer_unique and rows >= min_unique_rows and not gaps[n] and counts.get(n, 0) == rows),
        }
    return {"version": VERSION, "allow_extra_columns": allow_extra_columns, "extra_columns_severity": "error", "inference": {"rows": rows, "sampled": False}, "columns": columns}


def normalise(contract: dict) -> dict:
    """A checked copy with all fields; versions 1 and 2."""
    if not isinstance(contract, dict) or contract.get("version", 1) not in (1, 2) or not isinstance(contract.get("columns"), dict):
        raise ValueError("a contract is a dictionary of version 1 or 2 with columns")
    columns = {}
    for name, given in contract["columns"].items():
        if not isinstance(name, str) or not isinstance(given, dict) or given.get("type") not in TYPES:
            raise ValueError(f"column {name!r} needs a type among {', '.join(TYPES)}")
        rule = {"required": True, "nullable": True, "max_null_fraction": None, "minimum": None, "maximum": None, "allowed_values": None, "allowed_values_severity": "error", "unique": False} | given
        for field in ("minimum", "maximum", "max_null_fraction"):
            if rule[field] is not None and (isinstance(rule[field], bool) or not isinstance(rule[field], (int, float))):
                raise ValueError(f"{name}.{field} is not a number")
        if rule["allowed_values"] is not None and not isinstance(rule["allowed_values"], list):
            raise ValueError(f"{name}.allowed_values is not a list")
        if rule["allowed_values_severity"] not in ("error", "warning"):
            raise ValueError(f"{name}.allowed_values_severity is neither error nor warning")
        columns[name] = rule
    return {"version": VERSION, "allow_extra_columns": bool(contract.get("allow_extra_columns", False)), "extra_columns_severity": contract.get("extra_columns_severity", "error"), "columns": columns}


def _compatible(declared: str, actual: str) -> bool:
    return declared == actual or (declared == "number" and actual == "integer")


def _tests(df: DataFrame, name: str, rule: dict) -> list[tuple[str, str, Column]]:
    """(code, severity, count of violating rows) of one column, all as aggregates of the same pass."""
    c, gap = F.col(f"`{name}`"), X.missing(df, name)
    hits = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    out = []
    if not rule["nullable"]:
        out.append(("nullability_violation", "error", hits(gap)))
    elif rule["max_null_fraction"] is not None:
        gaps = hits(gap)
        out.append(("null_fraction_violation", "warning", F.when(gaps > rule["max_null_fraction"] * F.count(F.lit(1)), gaps).otherwise(0).cast("long")))
    if rule["allowed_values"] is not None:
        allowed = [str(v) for v in rule["allowed_values"]]
        out.append(("allowed_values_violation", rule["allowed_values_severity"], hits(~gap & ~c.cast("string").isin(allowed)) if allowed else hits(~gap)))
    if rule["type"] in ("integer", "number"):
        x = X.finite(df, name)
        if rule["minimum"] is not None:
            out.append(("minimum_violation", "error", hits(x < rule["minimum"])))
        if rule["maximum"] is not None:
            out.append(("maximum_violation", "error", hits(x > rule["maximum"])))
    return out


def violations(df: DataFrame, contract: dict) -> DataFrame:
    """(column, code, severity, violations) of every broken rule: one pass, and one frequency table for unique columns."""
    contract = normalise(contract)
    spark, fixed, cells, unique = df.sparkSession, [], [], []
    for name, rule in contract["columns"].items():
        if name not in df.columns:
            if rule["required"]:
                fixed.append((name, "missing_column", "error", 1))
            continue
        if not _compatible(rule["type"], X.family(df.schema[name].dataType)):
            fixed.append((name, "incompatible_type", "error", 1))
            continue
        cells += [F.struct(F.lit(name).alias("column"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.alias("violations")) for code, severity, n in _tests(df, name, rule)]
        if rule["unique"]:
            unique.append(name)
    if not contract["allow_extra_columns"]:
        fixed += [(n, "unexpected_column", contract["extra_columns_severity"], 1) for n in df.columns if n not in contract["columns"]]
    out = spark.createDataFrame(fixed, "column string, code string, severity string, violations long")
    for k in range(0, len(cells), 80):
        out = out.unionByName(df.agg(F.array(*cells[k : k + 80]).alias("cells")).select(F.inline("cells")).where("violations > 0"))
    if unique:
        twice = P.frequencies(df, unique).where("value is not null and n > 1").groupBy("column").agg(F.sum(F.col("n") - 1).alias("violations"))
        out = out.unionByName(twice.select("column", F.lit("uniqueness_violation").alias("code"), F.lit("error").alias("severity"), "violations"))
    return out


def unexpected_values(df: DataFrame, column: str, allowed: list, most: int = 10) -> list[str]:
    c = F.col(f"`{column}`").cast("string")
    return [r[0] for r in df.where(c.isNotNull() & ~c.isin([str(a) for a in allowed])).select(c.alias("v")).distinct().orderBy("v").limit(most).collect()]


def validate(df: DataFrame, contract: dict) -> dict:
    """All violations, aggregated, never fail-fast and never sampled; errors fail, warnings warn."""
    checked = normalise(contract)
    findings = [r.asDict() for r in violations(df, contract).orderBy("severity", "column", "code").collect()]
    for f in findings:
        if f["code"] == "allowed_values_violation":
            f["values"] = unexpected_values(df, f["column"], checked["columns"][f["column"]]["allowed_values"])
    errors, warnings = ([f for f in findings if f["severity"] == s] for s in ("error", "warning"))
    codes: dict[str, int] = {}
    for f in findings:
        codes[f["code"]] = codes.get(f["code"], 0) + 1
    return {
        "valid": not errors, "status": "fail" if errors else "warn" if warnings else "pass", "contract_version": checked["version"], "data": {"columns": df.columns},
        "summary": {"columns_checked": len(checked["columns"]), "errors": len(errors), "warnings": len(warnings), "findings": len(findings), "failed_columns": sorted({f["column"] for f in errors}), "warning_columns": sorted({f["column"] for f in warnings}), "code_counts": codes},
        "errors": errors, "warnings": warnings, "findings": findings,
    }
