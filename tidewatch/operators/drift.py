"""Drift between a reference and a current table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from ..functions import special as S
from .bivariate import chi_square
from .ranks import cumulative, exact_quantiles

SEVERITIES = ("unknown", "stable", "minor", "moderate", "severe")
PSI, GAPS, DISTANCE, JENSEN = (0.10, 0.25, 0.50), (2.0, 5.0, 15.0), (0.10, 0.25, 0.50), (0.05, 0.10, 0.25)
SMOOTH = 1e-6


def grade(x: float | None, steps: tuple[float, float, float]) -> str:
    if x is None or math.isnan(x):
        return "unknown"
    return ("stable", "minor", "moderate", "severe")[sum(x >= s for s in steps)]


def worst(*names: str) -> str:
    return max(names, key=SEVERITIES.index, default="unknown")


def at_least(name: str, threshold: str) -> bool:
    return SEVERITIES.index(name) >= SEVERITIES.index(threshold)


def sides(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(side, x) with side 0 for the reference and 1 for the current table; finite values only."""
    part = lambda df, k: df.select(F.lit(k).alias("side"), X.finite(df, column).alias("x"))
    return part(reference, 0).unionByName(part(current, 1)).where("x is not null")


def categories(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(category, ref, cur, ref_total, cur_total): counts of both sides by a full outer join."""
    count = lambda df, name: df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("category")).agg(F.count(F.lit(1)).alias(name))
    both = count(reference, "ref").join(count(current, "cur"), "category", "full_outer").na.fill(0)
    return both.select("*", F.sum("ref").over(Window.partitionBy()).alias("ref_total"), F.sum("cur").over(Window.partitionBy()).alias("cur_total"))


def psi_numeric(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(psi) over the reference's distinct deciles; null below ten values or three edges."""
    x = X.finite(reference, column)
    found = exact_quantiles(reference, [x], [k / 10 for k in range(11)])[0]
    n, q = found["n"], found["quantiles"]
    edges = sorted(set(q or []))
    if n < 10 or len(edges) < 3:
        return reference.sparkSession.createDataFrame([(None,)], "psi double")
    inner = edges[1:-1]
    bin_ = F.lit(0)
    for e in inner:
        bin_ = bin_ + (F.col("x") >= e).cast("int")
    counts = sides(reference, current, column).groupBy(bin_.alias("bin")).agg(F.sum(1 - F.col("side")).alias("ref"), F.sum("side").alias("cur"))
    over = Window.partitionBy()
    share = lambda c: F.greatest(F.try_divide(F.col(c), F.sum(c).over(over)), F.lit(SMOOTH))
    parts = counts.select(share("ref").alias("r"), share("cur").alias("c"))
    return parts.agg(F.round(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))), 6).alias("psi"))


def ecdf_distances(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(n_ref, n_cur, ks, wasserstein) by one pass over the distinct values of both sides."""
    both = sides(reference, current, column)
    total = both.agg(F.sum(1 - F.col("side")), F.sum("side")).first()
    steps = cumulative(both, "x", {"r": F.sum(1 - F.col("side")), "c": F.sum("side")})
    share = lambda c, n: F.col(f"upto_{c}") / F.lit(float(n)) if n else F.lit(None).cast("double")
    steps = steps.select(F.abs(share("r", total[0]) - share("c", total[1])).alias("gap"), (F.col("next") - F.col("x")).alias("width"), "r", "c")
    return steps.agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"), F.round(F.max("gap"), 6).alias("ks"), F.round(F.sum(F.col("gap") * F.col("width")), 6).alias("wasserstein"))


def ks_p(ks: float, n: int, m: int) -> float:
    e = math.sqrt(n * m / (n + m)) if n and m else 0.0
    return S.kolmogorov_sf((e + 0.12 + 0.11 / e) * ks) if e else 1.0


def side_moments(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(ref_mean, cur_mean, ref_std, cur_std, z_shift) with population deviations."""
    s = sides(reference, current, column)
    of = lambda f, k: f(F.when(F.col("side") == k, F.col("x")))
    rm, cm, rs, cs = of(F.avg, 0), of(F.avg, 1), of(F.stddev_pop, 0), of(F.stddev_pop, 1)
    scale = F.when(rs > 0, rs).otherwise(F.greatest(F.abs(rm), F.lit(1.0)))
    return s.agg(*[F.round(v, 6).alias(n) for n, v in (("ref_mean", rm), ("cur_mean", cm), ("ref_std", rs), ("cur_std", cs), ("z_shift", (cm - rm) / scale))])


def shared_histogram(reference: DataFrame, current: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, ref, cur) over the common range; the last bin is closed."""
    s = sides(reference, current, column)
    lo, hi = s.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return s.sparkSession.createDataFrame([], "bin long, ref long, cur long")
    width = (hi - lo) / bins
    bin_ = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
    return s.groupBy(bin_.cast("long").alias("bin")).agg(F.sum(1 - F.col("side")).alias("ref"), F.sum("side").alias("cur"))


def categorical_distances(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(n_categories, psi, jensen_shannon): smoothed PSI (null below two categories) and base-2 distance."""
    both = categories(reference, current, column).select(F.try_divide("ref", "ref_total").alias("r"), F.try_divide("cur", "cur_total").alias("c"))
    rs, cs = F.greatest("r", F.lit(SMOOTH)), F.greatest("c", F.lit(SMOOTH))
    mid = (F.col("r") + F.col("c")) / 2
    part = lambda p: F.when(p > 0, p * F.log2(p / mid)).otherwise(0.0)
    js = F.sqrt(F.greatest(F.sum(part(F.col("r")) + part(F.col("c"))) / 2, F.lit(0.0)))
    return both.agg(F.count(F.lit(1)).alias("n_categories"), F.round(F.when(F.count(F.lit(1)) >= 2, F.sum((cs - rs) * F.log(cs / rs))), 6).alias("psi"), F.round(js, 6).alias("jensen_shannon"))


def category_changes(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(category, change): categories only in the current table are new, those only in the reference missing."""
    both = categories(reference, current, column)
    return both.where("ref = 0 or cur = 0").select("category", F.when(F.col("ref") == 0, "new").otherwise("missing").alias("change"))


def chi_square_drift(reference: DataFrame, current: DataFrame, column: str, top: int = 30) -> dict:
    """Chi-square of side and category over the `top` most frequent categories, corrected where one degree is left."""
    c = F.col(f"`{column}`").cast("string")
    both = reference.select(F.lit("ref").alias("side"), c.alias("category")).unionByName(current.select(F.lit("cur").alias("side"), c.alias("category")))
    best = both.where("category is not null").groupBy("category").count().orderBy(F.desc("count"), "category").limit(top).select("category")
    return chi_square(both.join(F.broadcast(best), "category"), "side", "category").first().asDict()


def missingness_delta(reference: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    """(column, ref_missing_percent, cur_missing_percent, delta, severity) in percentage points."""
    from .profile import missing_counts

    r = missing_counts(reference, names).select("column", F.col("missing_percent").alias("ref_missing_percent"))
    c = missing_counts(current, names).select("column", F.col("missing_percent").alias("cur_missing_percent"))
    delta = F.round(F.col("cur_missing_percent") - F.col("ref_missing_percent"), 2)
    return r.join(F.broadcast(c), "column").withColumn("delta", delta).withColumn("severity", X.ladder(F.abs("delta"), [(15, "severe"), (5, "moderate"), (2, "minor")], "stable"))


def schema_drift(reference: DataFrame, current: DataFrame) -> dict:
    a, b = ({f.name: X.family(f.dataType) for f in df.schema} for df in (reference, current))
    removed, added = [n for n in a if n not in b], [n for n in b if n not in a]
    changed = [{"column": n, "reference": a[n], "current": b[n]} for n in a if n in b and drift_family(reference, n) != drift_family(current, n)]
    severity = "severe" if removed or changed else "moderate" if added else "stable"
    return {"added_columns": added, "removed_columns": removed, "dtype_changes": changed, "severity": severity}


def drift_family(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if X.family(kind) == "datetime":
        return "datetime"
    if isinstance(kind, T.NumericType):
        return "numeric"
    return "categorical" if isinstance(kind, (T.StringType, T.BinaryType)) else "unsupported"


def _as_days(df: DataFrame, column: str) -> DataFrame:
    return df.select((F.unix_micros(F.col(f"`{column}`").cast("timestamp")) / 86_400e6).alias(column))


def numeric_drift(reference: DataFrame, current: DataFrame, column: str, kind: str = "numeric") -> dict:
    psi = psi_numeric(reference, current, column).first()[0]
    d = ecdf_distances(reference, current, column).first()
    m = side_moments(reference, current, column).first()
    quart = exact_quantiles(reference, [X.finite(reference, column)], [0.25, 0.75])[0]["quantiles"]
    iqr = quart[1] - quart[0] if quart else 0.0
    scale = iqr or m["ref_std"] or max(abs(m["ref_mean"] or 0.0), 1.0)
    far = d["wasserstein"] / scale if d["wasserstein"] is not None else None
    n, k = d["n_ref"] or 0, d["n_cur"] or 0
    p = ks_p(d["ks"] or 0.0, n, k)
    found = worst(grade(psi, PSI), grade(far, DISTANCE), "minor" if p < 0.01 else "stable")
    return {
        "column": column, "type": kind, "available": bool(n and k), "n_ref": n, "n_cur": k, "psi": psi, "psi_severity": grade(psi, PSI),
        "wasserstein_normalized": far and round(far, 6), "wasserstein_severity": grade(far, DISTANCE), "ks_statistic": d["ks"], "ks_p_value": p, "ks_significant": p < 0.01,
        "ref_mean": m["ref_mean"], "cur_mean": m["cur_mean"], "ref_std": m["ref_std"], "cur_std": m["cur_std"], "z_shift": m["z_shift"], "drift_severity": found,
    }


def categorical_drift(reference: DataFrame, current: DataFrame, column: str) -> dict:
    d = categorical_distances(reference, current, column).first()
    changes = category_changes(reference, current, column)
    first = lambda change: [r[0] for r in changes.where(F.col("change") == change).orderBy("category").limit(10).collect()]
    chi = chi_square_drift(reference, current, column)
    significant = chi["p_value"] is not None and chi["p_value"] < 0.01
    found = worst(grade(d["psi"], PSI), grade(d["jensen_shannon"], JENSEN), "minor" if significant else "stable")
    return {
        "column": column, "type": "categorical", "available": True, "psi": d["psi"], "jensen_shannon_distance": d["jensen_shannon"], "chi2_statistic": chi["chi2"], "chi2_p_value": chi["p_value"],
        "chi2_dof": chi["dof"], "chi2_significant": significant, "n_categories": d["n_categories"], "new_categories": first("new"),
        "missing_categories": first("missing"), "drift_severity": found,
    }


def compare(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, max_columns: int = 30) -> dict:
    """Schema, missingness and per-column drift, the worst of which is the verdict. Exact over all rows."""
    schema = schema_drift(reference, current)
    shared = [n for n in reference.columns if n in current.columns and (columns is None or n in columns)]
    picked = shared[:max_columns]
    gaps = {r["column"]: r for r in missingness_delta(reference, current, picked).collect()} if picked else {}
    out = []
    for n in picked:
        a, b = drift_family(reference, n), drift_family(current, n)
        if a != b:
            row = {"column": n, "type": "mismatch", "available": False, "psi": None, "drift_severity": "severe"}
        elif a == "numeric":
            row = numeric_drift(reference, current, n)
        elif a == "datetime":
            row = numeric_drift(_as_days(reference, n), _as_days(current, n), n, "datetime")
        elif a in ("categorical", "boolean"):
            row = categorical_drift(reference, current, n)
        else:
            row = {"column": n, "type": a, "available": False, "psi": None, "drift_severity": "unknown"}
        gap = gaps[n]
        row |= {"missing_delta": gap["delta"], "missing_severity": gap["severity"]}
        row["drift_severity"] = worst(row["drift_severity"], gap["severity"])
        out.append(row)
    out.sort(key=lambda r: (-SEVERITIES.index(r["drift_severity"]), -(r["psi"] or 0.0), r["column"]))
    verdict = worst(schema["severity"], *(r["drift_severity"] for r in out))
    n, k = reference.count(), current.count()
    reasons = [f"{r['column']}: {r['drift_severity']} drift" for r in out if at_least(r["drift_severity"], "minor")]
    if schema["severity"] != "stable":
        reasons.insert(0, f"schema: {schema['severity']} change")
    return {
        "available": True, "ref_shape": [n, len(reference.columns)], "cur_shape": [k, len(current.columns)], "row_count_change_percent": round(100 * (k - n) / n, 2) if n else None,
        "shared_columns": shared, "selection": {"columns": picked, "truncated": len(shared) - len(picked)}, "schema": schema,
        "summary": {"n_columns_compared": len(out), "n_columns_available": sum(r["available"] for r in out), "severity_counts": {s: sum(r["drift_severity"] == s for r in out) for s in SEVERITIES}, "overall_verdict": verdict},
        "gate": {"status": "fail" if verdict == "severe" else "warn" if at_least(verdict, "minor") else "pass", "severity": verdict, "reasons": reasons}, "columns": out,
    }
