"""Semantic types and roles of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from .facts import Facts

#: Shapes of semantic types, portable between regular expression dialects.
SEMANTIC = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^(https?://|www\.)[^\s/]+\S*$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ip_address": r"^(((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])|[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{0,4}){2,7})$",
    "phone": r"^\+?[0-9][0-9 ().-]{6,18}[0-9]$",
    "percentage": r"^[+-]?[0-9]+(\.[0-9]+)?\s*%$",
    "currency": r"^([$€£₹]|[A-Z]{3} )\s*[0-9][0-9,]*(\.[0-9]+)?$",
    "json": r"^\s*[{\[](?s:.*)[}\]]\s*$",
    "boolean_token": r"^(?i)(true|false|yes|no|on|off|y|n|t|f|0|1)$",
}
SEMANTIC_RATIO = 0.7

#: Name tokens of roles.
NAME_TOKENS = {
    "id_like": {"id", "uuid", "guid", "key", "identifier", "pk"},
    "time_like": {"date", "time", "timestamp", "datetime", "year", "month", "day", "ts", "created", "updated"},
    "sequence_like": {"index", "row", "seq", "sequence", "number"},
    "price_like": {"price", "amount", "cost", "revenue", "total", "balance"},
    "quantity_like": {"quantity", "qty", "count", "volume", "size"},
    "rate_like": {"rate", "ratio", "percent", "pct", "discount", "tax"},
    "geo_like": {"country", "city", "state", "region", "nation", "zip", "lat", "lon", "latitude", "longitude"},
    "target_like": {"target", "label", "class", "outcome", "churn", "y"},
}


def semantic_test(kind: str, value: Column) -> Column:
    test = value.rlike(SEMANTIC[kind])
    return test & F.get_json_object(value, "$").isNotNull() if kind == "json" else test


def semantic_ratios(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, type, ratio): the share of non-null values of each text column that has each shape; one scan, all rows."""
    cells = []
    for n in names:
        v = F.col(f"`{n}`")
        for kind in SEMANTIC:
            cells.append(F.struct(F.lit(n).alias("column"), F.lit(kind).alias("type"), F.round(F.avg(F.when(v.isNotNull(), semantic_test(kind, F.trim(v)).cast("int"))), 4).alias("ratio")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def semantic_types(df: DataFrame, names: list[str], facts: Facts | None = None) -> dict[str, tuple[str | None, float]]:
    """The best type of each text column over all its values, if it reaches SEMANTIC_RATIO."""
    facts = facts or Facts(df.select(*[F.col(f"`{n}`") for n in names]))
    out: dict[str, tuple[str | None, float]] = {}
    for n in names:
        ratios = [(facts.text[n][f"is_{kind}"] or 0.0, kind) for kind in SEMANTIC]
        best, kind = max(ratios, key=lambda r: r[0])
        out[n] = (kind, best) if best >= SEMANTIC_RATIO else (None, 0.0)
    return out


def name_tokens(name: str) -> set[str]:
    """Lower-case words of a column name, split at marks and at case changes; no substrings."""
    return set(re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()))


def missingness_label(percent: float) -> str:
    for bound, label in ((90, "severe"), (50, "very_high"), (20, "high"), (5, "moderate")):
        if percent >= bound:
            return label
    return "low" if percent > 0 else "complete"


def infer_roles(df: DataFrame, facts: Facts | None = None) -> dict[str, dict]:
    """Roles of every column from its name, type, cardinality, lengths, missing share and semantic type.

    Two jobs for any number of columns, or none if the facts are at hand: frequencies and text shapes, both over all rows.
    """
    facts = facts or Facts(df)
    texts = facts.texts
    lengths = {n: (facts.text[n]["mean_length"] or 0, facts.text[n]["max_length"] or 0) for n in texts}
    semantics = semantic_types(df, texts, facts) if texts else {}
    out = {}
    for field in df.schema:
        n, kind = field.name, field.dataType
        distinct, filled = facts.columns[n]["distinct"], facts.columns[n]["filled"]
        ratio = distinct / filled if filled else 0.0
        numeric = isinstance(kind, (T.NumericType, T.BooleanType))
        roles, tokens = [], name_tokens(n)
        if numeric:
            roles.append("numeric")
        if isinstance(kind, (T.StringType, T.BooleanType, T.BinaryType)):
            roles.append("categorical")
        if isinstance(kind, T.BooleanType):
            roles.append("boolean")
        if X.family(kind) == "datetime":
            roles.append("datetime")
        roles += [role for role, words in NAME_TOKENS.items() if tokens & words]
        if distinct <= 1:
            roles.append("constant")
        elif distinct == 2:
            roles.append("binary")
        if 2 <= distinct <= 10:
            roles.append("low_cardinality")
        if ratio > 0.8:
            roles.append("high_cardinality")
        if ratio > 0.95:
            roles.append("unique_like")
            if not numeric and X.family(kind) == "string" and "id_like" not in roles:
                roles.append("id_like")
        semantic, confidence = semantics.get(n, (None, 0.0))
        if semantic:
            roles.append(f"{semantic}_like")
        mean_length, longest = lengths.get(n, (0, 0))
        if mean_length > 50 or longest > 200:
            roles.append("long_text")
        if X.family(kind) == "datetime" and "time_like" not in roles:
            roles.append("time_like")
        if not {"id_like", "time_like", "sequence_like", "constant"} & set(roles):
            roles.append("analysis_candidate")
        if {"binary", "low_cardinality"} & set(roles):
            roles.append("target_candidate")
        if numeric and distinct > 10:
            roles.append("regression_target_candidate")
        percent = facts.missing_percent(n)
        out[n] = {
            "roles": roles,
            "dtype": kind.simpleString(),
            "missing_percent": percent,
            "missingness": missingness_label(percent),
            "unique_count": distinct,
            "unique_ratio": round(ratio, 4),
            "non_missing_count": filled,
            "is_numeric": numeric,
            "is_categorical": "categorical" in roles,
            "semantic_type": semantic,
            "semantic_confidence": confidence,
            "semantic_sample_size": filled,
        }
    return out


def columns_with_role(roles: dict[str, dict], role: str) -> list[str]:
    return [n for n, r in roles.items() if role in r["roles"]]


def meaningful_numeric(roles: dict[str, dict]) -> list[str]:
    skip = {"id_like", "time_like", "sequence_like", "constant"}
    return [n for n, r in roles.items() if r["is_numeric"] and not skip & set(r["roles"]) and r["non_missing_count"] >= 10]


def meaningful_categorical(roles: dict[str, dict]) -> list[str]:
    return [n for n, r in roles.items() if r["is_categorical"] and 2 <= r["unique_count"] <= 20]


def summarize_roles(roles: dict[str, dict]) -> dict[str, list[str]]:
    names = sorted({x for r in roles.values() for x in r["roles"]})
    return {x: columns_with_role(roles, x) for x in names}
