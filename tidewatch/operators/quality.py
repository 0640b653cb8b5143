"""Quality diagnostics, exact over all rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from . import profile as P
from .facts import Facts
from .ranks import cells, keyed
from .roles import NAME_TOKENS, columns_with_role, infer_roles, name_tokens

MAX_COLUMNS, MISSINGNESS_COLUMNS, TOP_MISSINGNESS = 100, 25, 30


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def primary_keys(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column): complete and unique columns."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    counts = P.distinct_counts(df, names)
    return counts.crossJoin(F.broadcast(rows)).where("rows > 0 and non_null = rows and distinct_values = rows").select("column")


def duplicate_identifiers(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, duplicated_values, affected_rows): non-null values that occur more than once."""
    return (
        P.frequencies(df, names).where("value is not null and n > 1").groupBy("column").agg(F.count(F.lit(1)).alias("duplicated_values"), F.sum("n").alias("affected_rows"))
    )


def quasi_constant(df: DataFrame, names: list[str] | None = None, ratio: float = 0.95, least: int = 10) -> DataFrame:
    """(column, top_value, top_ratio, severity): one value fills at least `ratio` of the non-null cells."""
    freq = P.frequencies(df, names or df.columns).where("value is not null")
    per = freq.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.max(F.struct("n", "value")).alias("best"))
    share = F.col("best.n") / F.col("total")
    return per.where((F.col("total") >= least) & (F.col("distinct") > 1) & (share >= ratio)).select(
        "column", F.col("best.value").alias("top_value"), F.round(share, 6).alias("top_ratio"), F.when(share >= 0.99, "medium").otherwise("low").alias("severity")
    )


def duplicate_columns(df: DataFrame, names: list[str] | None = None, facts: Facts | None = None) -> DataFrame:
    """(left, right): columns equal in every row, nulls included. Fingerprints of their values find candidates, which are confirmed."""
    names, schema = names or df.columns, "left string, right string"
    facts = facts or Facts(df.select(*[F.col(f"`{n}`") for n in names]))
    kinds, like = dict(df.dtypes), {}
    for n in names:
        own = facts.columns[n]
        like.setdefault((kinds[n], own["fingerprint"], own["distinct"], own["missing"]), []).append(n)
    pairs = [p for group in like.values() for p in combinations(group, 2)]
    sure = [df.agg(*[F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(str(k)) for k, (a, b) in enumerate(pairs[lo : lo + 100])]).first() for lo in range(0, len(pairs), 100)]
    order = {n: k for k, n in enumerate(names)}
    found = [p for p, yes in zip(pairs, (y for row in sure for y in row), strict=True) if yes]
    return df.sparkSession.createDataFrame(sorted(found, key=lambda p: (order[p[0]], order[p[1]])), schema)


def coercion_ratios(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, numeric_ratio, datetime_ratio) of the non-blank values of text columns."""
    parts = []
    for n in names or _texts(df):
        v = F.trim(F.col(f"`{n}`"))
        given = v.isNotNull() & (v != "")
        number = F.expr(f"try_cast(regexp_replace(trim(`{n}`), '[,$€£₹%]', '') as double) is not null")
        parts.append(
            F.struct(
                F.lit(n).alias("column"),
                F.round(F.avg(F.when(given, number.cast("int"))), 4).alias("numeric_ratio"),
                F.round(F.avg(F.when(given, F.expr(f"try_to_timestamp(trim(`{n}`)) is not null").cast("int"))), 4).alias("datetime_ratio"),
            )
        )
    return df.agg(F.array(*parts).alias("cells")).select(F.inline("cells"))


def coercion_candidates(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, suggested): text that is nearly all numbers, or nearly all timestamps and mostly no numbers."""
    r = coercion_ratios(df, names)
    kind = F.when(F.col("numeric_ratio") >= 0.95, "numeric").when((F.col("datetime_ratio") >= 0.95) & (F.col("numeric_ratio") < 0.5), "datetime")
    return r.withColumn("suggested", kind).where("suggested is not null").select("column", "suggested")


def category_variants(df: DataFrame, names: list[str], most: int = 200) -> DataFrame:
    """(column, normalised, variants): values equal but for case and outer space, in columns of at most `most` values."""
    freq = P.frequencies(df, names).where("value is not null")
    small = freq.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where((F.col("k") >= 2) & (F.col("k") <= most)).select("column")
    groups = freq.join(F.broadcast(small), "column").groupBy("column", F.lower(F.trim("value")).alias("normalised"))
    return groups.agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def blank_strings(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, blank_count) of text columns with blank values."""
    parts = [F.struct(F.lit(n).alias("column"), F.sum(F.when(F.trim(F.col(f"`{n}`")) == "", 1).otherwise(0)).cast("long").alias("blank_count")) for n in names or _texts(df)]
    return df.agg(F.array(*parts).alias("cells")).select(F.inline("cells")).where("blank_count > 0")


def infinities(df: DataFrame) -> DataFrame:
    """(column, infinite_count) of fractional columns that hold infinities."""
    names = [f.name for f in df.schema if X.is_fractional(f.dataType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, infinite_count long")
    far = cells(df, [F.abs(F.col(f"`{n}`").cast("double")) for n in names]).where(F.col("x") == float("inf")).groupBy("k").agg(F.count(F.lit(1)).alias("infinite_count"))
    return far.join(keyed(df.sparkSession, list(enumerate(names)), "k int, column string"), "k").select("column", "infinite_count")


def mixed_types(df: DataFrame) -> DataFrame:
    """(column, types, rows) of variant columns whose values have several types; other columns have one by their schema."""
    found = None
    for f in df.schema:
        if f.dataType.typeName() == "variant":
            kinds = df.select(F.schema_of_variant(F.col(f"`{f.name}`")).alias("type")).where("type is not null and type <> 'VOID'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
            part = kinds.agg(F.lit(f.name).alias("column"), F.sort_array(F.collect_list("type")).alias("types"), F.sum("n").alias("rows")).where(F.size("types") > 1)
            found = part if found is None else found.unionByName(part)
    return df.sparkSession.createDataFrame([], "column string, types array<string>, rows long") if found is None else found


def co_missing(df: DataFrame, names: list[str] | None = None, jaccard: float = 0.7, least: int = 3) -> DataFrame:
    """(left, right, both, jaccard) of columns that are missing together: each row adds the pairs among its own gaps."""
    names = (names or df.columns)[:MISSINGNESS_COLUMNS]
    gaps = F.filter(F.array(*[F.when(X.missing(df, n), F.lit(k)) for k, n in enumerate(names)]), lambda k: k.isNotNull())
    # rows with the same gaps are one row of this table, of which there are far fewer than rows
    sets = df.select(gaps.alias("gaps")).where("size(gaps) > 0").groupBy("gaps").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("gaps", lambda a: F.transform(F.filter("gaps", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counts = {(r["a"], r["b"]): r["n"] for r in sets.select("n", F.inline(pairs)).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    rows = []
    for (a, b), both in counts.items():
        share = both / (counts[a, a] + counts[b, b] - both)
        if a != b and both >= least and share >= jaccard:
            rows.append((names[a], names[b], both, round(share, 6)))
    rows = sorted(rows, key=lambda r: (-r[3], -r[2], r[0], r[1]))[:TOP_MISSINGNESS]
    return df.sparkSession.createDataFrame(rows, "left string, right string, both long, jaccard double")


def run_quality(df: DataFrame, max_columns: int = MAX_COLUMNS, roles: dict | None = None, facts: Facts | None = None) -> dict:
    """All checks as one dictionary over the first max_columns columns; most follow from the shared facts.

    Mixed types within a column can occur in variant columns only.
    """
    total = len(df.columns)
    names = df.columns[:max_columns]
    if total > max_columns or facts is None:
        df = df.select(*[F.col(f"`{n}`") for n in names])
        facts = Facts(df)
    roles = roles or infer_roles(df, facts)
    ids = [n for n in columns_with_role(roles, "id_like") if n in names]
    columns, rows = facts.columns, facts.rows
    texts = [n for n in facts.texts if "long_text" not in roles[n]["roles"] and 2 <= columns[n]["distinct"] <= 200]
    listed = lambda frame: [r.asDict() for r in frame.collect()]
    constant, coercion = [], []
    for n in names:
        c = columns[n]
        share = c["best_n"] / c["filled"] if c["filled"] else 0.0
        if c["filled"] >= 10 and c["distinct"] > 1 and share >= 0.95:
            constant.append({"column": n, "top_value": c["best"], "top_ratio": round(share, 6), "severity": "medium" if share >= 0.99 else "low"})
    for n in facts.texts:
        number, stamp = (facts.text[n][k] or 0.0 for k in ("numeric_ratio", "datetime_ratio"))
        kind = "numeric" if number >= 0.95 else "datetime" if stamp >= 0.95 and number < 0.5 else None
        if kind and not name_tokens(n) & NAME_TOKENS["id_like"]:
            coercion.append({"column": n, "suggested": kind})
    found = {
        "primary_key_candidates": [{"column": n, "confidence": "high" if n in ids else "medium"} for n in names if rows and columns[n]["filled"] == columns[n]["distinct"] == rows],
        "identifier_duplicates": [{"column": n, "duplicated_values": columns[n]["duplicated_values"], "affected_rows": columns[n]["affected_rows"]} for n in ids if columns[n]["duplicated_values"]],
        "quasi_constant_columns": constant,
        "duplicate_columns": listed(duplicate_columns(df, names, facts)),
        "coercion_candidates": coercion,
        "category_normalisation": listed(category_variants(df, texts)) if texts else [],
        "blank_strings": [{"column": n, "blank_count": facts.text[n]["blank_count"]} for n in facts.texts if facts.text[n]["blank_count"]],
        "infinite_values": listed(infinities(df)),
        "mixed_object_types": listed(mixed_types(df)),
        "missingness_relationships": listed(co_missing(df)) if sum(columns[n]["missing"] > 0 for n in names) > 1 else [],
    }
    return {
        "available": True,
        "rows": rows,
        "columns": len(names),
        "columns_checked": names,
        "truncated_columns": total - len(names),
        "max_sample_rows": None,
        "duplicate_rows": facts.duplicates["duplicate_rows"],
        "summary": {k: len(v) for k, v in found.items()},
        **found,
    }
