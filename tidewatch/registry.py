"""Queries over the sample tables and their DuckDB equivalents.

Defects are planted by SQL that both engines read, since the sample tables have none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anomaly, bivariate, charts, cleaning, contracts, drift, ensemble, profile, quality, roles, sampling, scoring, series, sketches, statistics, target, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

L = "SELECT * FROM lineitem"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIRTY = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 101 = 0 OR l_orderkey % 303 = 1 THEN NULL ELSE l_discount END AS l_discount, l_extendedprice,
  CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus FROM lineitem"""
MESSY = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE 'A' END AS status, CAST(o_orderkey % 1000 AS STRING) AS num_text,
  CASE WHEN o_orderkey % 3 = 0 THEN ' Pune' WHEN o_orderkey % 3 = 1 THEN 'PUNE' ELSE 'Delhi' END AS city,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderpriority END AS note, o_totalprice AS base, o_totalprice AS base_copy,
  CASE WHEN o_orderkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice END AS ratio,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS gap_a, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 331 = 1 THEN NULL ELSE o_custkey END AS gap_b FROM orders"""
OLD = "SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'"
NEW = "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01'"
OLD_SHIFT = "SELECT l_quantity, l_extendedprice AS v, l_returnflag, l_shipdate FROM lineitem WHERE l_linestatus = 'F'"
NEW_SHIFT = "SELECT l_quantity, l_extendedprice * 1.2 + 500 AS v, CASE WHEN l_orderkey % 9 = 0 THEN 'Z' ELSE l_returnflag END AS l_returnflag, l_shipdate FROM lineitem WHERE l_linestatus = 'O'"


def sql(spark: SparkSession, sf_dir: str, text_: str) -> DataFrame:
    """A query of shared SQL over the tables it names."""
    names = set(re.findall(r"\bFROM (\w+)|\bJOIN (\w+)", text_))
    found = sorted({a or b for a, b in names})
    body = text_
    for n in found:
        body = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", body)
    return spark.sql(body, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in found})


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# ---- profile -------------------------------------------------------------------------------------------------------

_FIN = "CASE WHEN NOT isnan({c}) AND abs({c}) < 'Infinity'::DOUBLE THEN {c} END"


def _summary_sql(source: str, names: list[str], digits: int = 3) -> str:
    r = lambda e: f"round({e}, {digits})"
    return _union(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, CAST(0 AS BIGINT) AS infinite, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,"
            f" {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50, {r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'max({c})')} AS max, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM ({source})"
            for c in names
        ]
    )


@query("agg05_numeric_summary", _summary_sql(L, NUMBERS))
def _(s, d):
    return profile.numeric_summary(sql(s, d, L), NUMBERS)


@query("agg01_profile_dirty", _summary_sql(DIRTY, ["l_quantity", "l_discount", "l_extendedprice"]))
def _(s, d):
    return profile.numeric_summary(sql(s, d, DIRTY), ["l_quantity", "l_discount", "l_extendedprice"])


_DIRTY_NAMES = ["l_quantity", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus"]


@query("agg03_missing_counts", _union([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, round(100 * (count(*) - count({c})) / count(*), 2) AS missing_percent FROM ({DIRTY})" for c in _DIRTY_NAMES]))
def _(s, d):
    return profile.missing_counts(sql(s, d, DIRTY), _DIRTY_NAMES)


@query("agg04_duplicate_rows", "WITH g AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, round(100 * (sum(n) - count(*)) / sum(n), 2) AS duplicate_percent FROM g")
def _(s, d):
    return profile.duplicate_rows(sql(s, d, "SELECT event_type, user_id FROM events"))


def _top_sql(source: str, names: list[str], top: int) -> str:
    return _union(
        [
            f"SELECT * FROM (SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY n DESC, value) AS rank, value, n, u AS unique_values FROM (SELECT coalesce(CAST({c} AS VARCHAR), 'null') AS value, count(*) AS n, (SELECT count(DISTINCT {c}) FROM ({source})) AS u FROM ({source}) GROUP BY 1)) WHERE rank <= {top}"
            for c in names
        ]
    )


@query("agg08_top_values", _top_sql(DIRTY, ["l_returnflag", "l_linestatus"], 10))
def _(s, d):
    return profile.top_values(sql(s, d, DIRTY), ["l_returnflag", "l_linestatus"])


@query("agg08_top_values_part", _top_sql("SELECT p_type, p_brand FROM part", ["p_type", "p_brand"], 10))
def _(s, d):
    return profile.top_values(sql(s, d, "SELECT p_type, p_brand FROM part"))


@query("agg08_distinct_counts", _union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, count({c}) AS non_null FROM orders" for c in ["o_custkey", "o_orderstatus", "o_orderpriority"]]))
def _(s, d):
    return profile.distinct_counts(sql(s, d, "SELECT * FROM orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query("agg09_correlations", _union([f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 3) AS correlation FROM lineitem" for a, b in _PAIRS]))
def _(s, d):
    return profile.correlations(sql(s, d, L), NUMBERS)


# ---- samples and sketches ------------------------------------------------------------------------------------------


@query("smp01_stratified_sample")
def _(s, d):
    return sampling.sample_rows(sql(s, d, L), ["l_orderkey", "l_linenumber", "l_partkey"], 1000)


@query("smp04_even_sample", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE i IN (SELECT CAST(floor(k * (SELECT count(*) - 1 FROM orders) / 99.0) AS BIGINT) FROM range(100) t(k))")
def _(s, d):
    return sampling.sample_rows(sql(s, d, "SELECT * FROM orders"), ["o_orderkey"], 100, "even").select("o_orderkey")


@query("smp08_split_by_date", "WITH r AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM events) SELECT CASE WHEN i < n // 2 THEN 'older' ELSE 'newer' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last FROM r GROUP BY 1")
def _(s, d):
    old, new = sampling.split_by_date(sql(s, d, "SELECT * FROM events"), "ts")
    part = lambda df, n: df.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return part(old, "older").unionByName(part(new, "newer"))


_W = "ln(1.01 / 0.99)"


@query(
    "skt02_log_quantiles",
    f"WITH b AS (SELECT floor(ln(l_extendedprice) / {_W}) AS k, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT k, n, sum(n) OVER (ORDER BY k) AS u, sum(n) OVER () AS t FROM b), q(quantile) AS (VALUES (0.01::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) SELECT quantile, round(exp((k + 0.5) * {_W}), 6) AS value FROM c, q WHERE floor(quantile * (t - 1)) < u AND floor(quantile * (t - 1)) >= u - n",
)
def _(s, d):
    return sketches.bin_quantiles(sketches.log_bins(sql(s, d, L), "l_extendedprice"), [0.01, 0.25, 0.5, 0.95])


@query("skt01_distinct_estimates")
def _(s, d):
    return sketches.distinct_estimate(sql(s, d, L), ["l_orderkey", "l_partkey", "l_returnflag"])


@query("skt05_heavy_hitters")
def _(s, d):
    return sketches.heavy_hitters(sql(s, d, "SELECT * FROM events"), "event_type")


@query("skt08_reservoir")
def _(s, d):
    return sketches.reservoir(sql(s, d, "SELECT o_orderkey, o_totalprice FROM orders"), ["o_orderkey"])


# ---- roles and scores ----------------------------------------------------------------------------------------------

_SEM = [(c, k) for c in ("url",) for k in ("url", "email", "uuid", "ip_address")]


@query("sem01_semantic_ratios", _union([f"SELECT '{c}' AS \"column\", '{k}' AS type, round(avg(CAST(regexp_matches(trim({c}), '{roles.SEMANTIC[k]}') AS INT)), 4) AS ratio FROM pages" for c, k in _SEM]))
def _(s, d):
    return roles.semantic_ratios(sql(s, d, "SELECT url FROM pages"), ["url"]).where(F.col("type").isin("url", "email", "uuid", "ip_address"))


@query("sem01_json_ratio", "SELECT 'props' AS \"column\", 'json' AS type, round(avg(CAST(json_valid(props) AND regexp_matches(props, '^\\s*[{\\[]') AS INT)), 4) AS ratio FROM events")
def _(s, d):
    return roles.semantic_ratios(sql(s, d, "SELECT props FROM events"), ["props"]).where("type = 'json'")


@query("rol01_column_roles")
def _(s, d):
    found = roles.infer_roles(sql(s, d, "SELECT * FROM orders"))
    return s.createDataFrame([(n, ",".join(r["roles"]), r["unique_count"], r["missing_percent"]) for n, r in found.items()], "column string, roles string, unique_count long, missing_percent double")


def _fences(c: str, source: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM ({source}))"


@query("scr01_iqr_outliers", _union([f"SELECT '{c}' AS \"column\", count({c}) AS values, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers, round(100 * count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count({c}), 4) AS outlier_percent FROM lineitem, {_fences(c, L)}" for c in NUMBERS]))
def _(s, d):
    return scoring.iqr_outliers(sql(s, d, L), NUMBERS)


_C = ["o_orderkey", "o_custkey", "status", "num_text", "city"]
_MC = f"SELECT o_orderkey, gap_a AS o_custkey, status, num_text, city FROM ({MESSY})"


@query(
    "scr05_column_utility",
    _union(
        [
            f"SELECT '{c}' AS \"column\", s AS utility_score, CASE WHEN s >= 80 THEN 'High' WHEN s >= 50 THEN 'Moderate' ELSE 'Low' END AS utility_label FROM (SELECT round(100 - least(40, round(100 * (count(*) - count({c})) / count(*), 2)) - CASE WHEN count(DISTINCT {c}) <= 1 THEN 40 ELSE 0 END - CASE WHEN {'false' if k < 2 else 'true'} AND count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) / count({c}) > 0.9 THEN 30 ELSE 0 END, 2) AS s FROM ({_MC}))"
            for k, c in enumerate(_C)
        ]
    ),
)
def _(s, d):
    return scoring.column_utility(sql(s, d, _MC))


@query(
    "scr06_row_anomaly",
    "WITH f AS (SELECT * FROM " + ", ".join(f"(SELECT lo AS lo{k}, hi AS hi{k} FROM {_fences(c, L)})" for k, c in enumerate(NUMBERS)) + "), r AS (SELECT l_orderkey, l_linenumber, l_partkey, round((" + " + ".join(f"CASE WHEN {c} < lo{k} OR {c} > hi{k} THEN 1 ELSE 0 END" for k, c in enumerate(NUMBERS)) + ") / 4.0::DOUBLE, 6) AS density FROM lineitem, f) SELECT * FROM r WHERE density > 0 ORDER BY density DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10",
)
def _(s, d):
    return scoring.anomalous_rows(sql(s, d, L), NUMBERS, ["l_orderkey", "l_linenumber", "l_partkey"])


_HN = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"]


@query(
    "scr02_health_score",
    f"WITH t AS ({DIRTY}), g AS (SELECT count(*) AS n, 100.0::DOUBLE * (7 * count(*) - " + " - ".join(f"count({c})" for c in [*_HN, "l_returnflag", "l_linestatus"]) + ") / (7 * count(*)) AS gaps FROM t), u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM t)), "
    + "o AS (SELECT 100.0::DOUBLE * sum(hits) / sum(given) AS far FROM (" + _union([f"SELECT count({c}) AS given, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS hits FROM t, {_fences(c, 'SELECT * FROM t')}" for c in _HN]) + ")), "
    + "s AS (SELECT round(least(100, greatest(0, 0.3::DOUBLE * (100 - gaps) + 0.2::DOUBLE * (100 + 100 - round(100.0 * (n - k) / n, 2) + 100 - far) + 10)), 2) AS score, * FROM g, u, o) "
    + "SELECT score AS overall_score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END AS label, round(gaps, 2) AS missing_percent, round(100.0 * (n - k) / n, 2)::DOUBLE AS duplicate_percent, round(far, 2) AS outlier_percent FROM s",
)
def _(s, d):
    return scoring.health_frame(sql(s, d, DIRTY))


_H = f"WITH t AS ({DIRTY}), g AS (SELECT count(*) AS n, 7 * count(*) - count(l_orderkey) - count(l_linenumber) - count(l_quantity) - count(l_discount) - count(l_extendedprice) - count(l_returnflag) - count(l_linestatus) AS gaps FROM t), u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM t))"


@query("scr04_ml_readiness", _H + " SELECT round(100 - least(30, 100.0 * gaps / (7 * n)) - least(15, round(100.0 * (n - k) / n, 2)) - 4, 2)::DOUBLE AS score, round(100.0 * gaps / (7 * n), 2)::DOUBLE AS missing_percent, CAST(2 AS BIGINT) AS categorical_columns FROM g, u")
def _(s, d):
    r = scoring.readiness_from(profile.build_profile(sql(s, d, DIRTY)))
    return s.createDataFrame([(r["score"], r["issues"]["missing_percent"], r["categorical_columns"])], "score double, missing_percent double, categorical_columns long")


@query("scr08_freshness", "SELECT 'o_orderdate' AS \"column\", count(o_orderdate) AS parsed, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders")
def _(s, d):
    return scoring.freshness(sql(s, d, "SELECT * FROM orders"), ["o_orderdate"])


# ---- quality -------------------------------------------------------------------------------------------------------


@query("qlt01_primary_keys", _union([f"SELECT '{c}' AS \"column\" FROM orders HAVING count(DISTINCT {c}) = count(*)" for c in ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]]))
def _(s, d):
    return quality.primary_keys(sql(s, d, "SELECT * FROM orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])


@query("qlt02_identifier_duplicates", "SELECT 'l_orderkey' AS \"column\", count(*) AS duplicated_values, CAST(sum(n) AS BIGINT) AS affected_rows FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 1")
def _(s, d):
    return quality.duplicate_identifiers(sql(s, d, L), ["l_orderkey"])


@query("qlt03_quasi_constant", f"WITH f AS (SELECT status, count(*) AS n FROM ({MESSY}) GROUP BY 1), m AS (SELECT sum(n) AS t, max(n) AS b, arg_max(status, n) AS v FROM f) SELECT 'status' AS \"column\", v AS top_value, round(b / t, 6) AS top_ratio, CASE WHEN b / t >= 0.99 THEN 'medium' ELSE 'low' END AS severity FROM m WHERE b / t >= 0.95")
def _(s, d):
    return quality.quasi_constant(sql(s, d, MESSY), ["status", "city"])


@query("qlt04_duplicate_columns", f"SELECT 'base' AS \"left\", 'base_copy' AS \"right\" FROM ({MESSY}) HAVING bool_and(base IS NOT DISTINCT FROM base_copy)")
def _(s, d):
    return quality.duplicate_columns(sql(s, d, MESSY))


@query("qlt05_coercion", f"SELECT 'num_text' AS \"column\", 'numeric' AS suggested FROM ({MESSY}) HAVING avg(CAST(try_cast(num_text AS DOUBLE) IS NOT NULL AS INT)) >= 0.95")
def _(s, d):
    return quality.coercion_candidates(sql(s, d, MESSY), ["num_text", "city"])


@query("qlt06_category_variants", f"SELECT 'city' AS \"column\", lower(trim(city)) AS normalised, count(DISTINCT city) AS variants FROM ({MESSY}) GROUP BY 2 HAVING count(DISTINCT city) > 1")
def _(s, d):
    return quality.category_variants(sql(s, d, MESSY), ["city"])


@query("qlt07_blank_strings", f"SELECT 'note' AS \"column\", count(*) AS blank_count FROM ({MESSY}) WHERE trim(note) = ''")
def _(s, d):
    return quality.blank_strings(sql(s, d, MESSY))


@query("qlt08_infinities", f"SELECT 'ratio' AS \"column\", count(*) AS infinite_count FROM ({MESSY}) WHERE isinf(ratio)")
def _(s, d):
    return quality.infinities(sql(s, d, MESSY))


@query("qlt10_co_missing", f"SELECT 'gap_a' AS \"left\", 'gap_b' AS \"right\", count(*) FILTER (WHERE gap_a IS NULL AND gap_b IS NULL) AS \"both\", round(count(*) FILTER (WHERE gap_a IS NULL AND gap_b IS NULL) / count(*) FILTER (WHERE gap_a IS NULL OR gap_b IS NULL), 6) AS jaccard FROM ({MESSY})")
def _(s, d):
    return quality.co_missing(sql(s, d, MESSY))


@query("qlt00_quality_report")
def _(s, d):
    found = quality.run_quality(sql(s, d, MESSY))["summary"]
    return s.createDataFrame(sorted(found.items()), "check string, findings long")


# ---- statistics ----------------------------------------------------------------------------------------------------


def _outlier_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS iqr_outliers, count(*) FILTER (WHERE abs(({c} - m) / s) > 3) AS z_outliers, count(*) FILTER (WHERE mad > 0 AND abs({c} - med) / (1.4826 * mad) > 3.5) AS mad_outliers FROM lineitem, "
        f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem), (SELECT quantile_cont(abs({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem)), 0.5) AS mad FROM lineitem)"
    )


@query("sta05_outliers", _union([_outlier_sql(c) for c in NUMBERS]))
def _(s, d):
    return statistics.outlier_counts(sql(s, d, L), NUMBERS)


@query("sta10_mean_interval")
def _(s, d):
    return statistics.mean_interval(sql(s, d, L), NUMBERS)


@query("sta11_median_interval")
def _(s, d):
    return statistics.median_interval(sql(s, d, L), "l_extendedprice")


def _entropy_sql(c: str, source: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c}) AS \"distinct\", round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS entropy_ratio FROM (SELECT {c}, count(*) / sum(count(*)) OVER () AS p FROM ({source}) GROUP BY 1)"


@query("sta12_entropy", _union([_entropy_sql(c, DIRTY) for c in ("l_returnflag", "l_linestatus")]))
def _(s, d):
    return statistics.entropy(sql(s, d, DIRTY), ["l_returnflag", "l_linestatus"])


def _dagostino_sql(c: str) -> str:
    n = "n::DOUBLE"
    b2 = "3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))"
    root = "6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))"
    return (
        f"SELECT '{c}' AS \"column\", CAST(n AS BIGINT) AS n, round(z1 * z1 + z2 * z2, 2) AS statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value, exp(-(z1 * z1 + z2 * z2) / 2) >= 0.05 AS normal FROM ("
        "SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * a) - sign(cube) * abs(cube) ** (1.0::DOUBLE / 3)) / sqrt(2 / (9 * a)) AS z2 FROM ("
        "SELECT n, y, w2, a, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS cube FROM ("
        f"SELECT n, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * ({b2} - 1)) - 1 AS w2, (g2 + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x, 6 + 8 / ({root}) * (2 / ({root}) + sqrt(1 + 4 / ({root}) ** 2)) AS a FROM ("
        f"SELECT {n} AS n, m3 / m2 ** 1.5 AS g1, m4 / (m2 * m2) - 3 AS g2 FROM (SELECT count({c}) AS n, avg(({c} - m) ** 2) AS m2, avg(({c} - m) ** 3) AS m3, avg(({c} - m) ** 4) AS m4 FROM lineitem, (SELECT avg({c}) AS m FROM lineitem))))))"
    )


@query("sta07_normality", _union([_dagostino_sql(c) for c in NUMBERS]))
def _(s, d):
    return statistics.dagostino(sql(s, d, L), NUMBERS).withColumns({"statistic": F.round("statistic", 2), "p_value": F.round("p_value", 6)})


@query("sta07_anderson")
def _(s, d):
    return statistics.anderson_normal(sql(s, d, "SELECT * FROM customer"), "c_acctbal")


@query(
    "sta08_distribution_fit",
    "WITH m AS (SELECT count(l_extendedprice) AS n, avg(l_extendedprice) AS a, stddev_pop(l_extendedprice) AS s, min(l_extendedprice) AS lo, avg(ln(l_extendedprice)) AS la, stddev_pop(ln(l_extendedprice)) AS ls FROM lineitem) SELECT 'l_extendedprice' AS \"column\", 'norm' AS distribution, round(n * ln(2 * pi() * s * s) + n + 4, 4) AS aic FROM m UNION ALL SELECT 'l_extendedprice', 'expon', round(2 * n * (1 + ln(a - lo)) + 4, 4) FROM m UNION ALL SELECT 'l_extendedprice', 'lognorm', round(n * ln(2 * pi() * ls * ls) + n + 2 * n * la + 4, 4) FROM m",
)
def _(s, d):
    return statistics.distribution_fit(sql(s, d, L), ["l_extendedprice"], ("norm", "expon", "lognorm"))


@query("sta08_shape_fits")
def _(s, d):
    return statistics.distribution_fit(sql(s, d, "SELECT l_extendedprice, (l_quantity - 0.5D) / 50 AS share FROM lineitem"), ["l_extendedprice", "share"])


@query("sta09_bootstrap")
def _(s, d):
    return statistics.bootstrap_interval(sql(s, d, "SELECT * FROM orders"), ["o_totalprice"], ["o_orderkey"])


# ---- bivariate -----------------------------------------------------------------------------------------------------


@query(
    "biv01_spearman",
    "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r",
)
def _(s, d):
    return bivariate.spearman(sql(s, d, L), "l_quantity", "l_extendedprice")


@query("biv01_kendall")
def _(s, d):
    return bivariate.kendall(sql(s, d, L), "l_quantity", "l_extendedprice")


@query(
    "biv01_kendall_discrete",
    "WITH p AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT sum(CASE WHEN a.y < b.y THEN a.n * b.n WHEN a.y > b.y THEN -a.n * b.n ELSE 0 END)::DOUBLE AS s FROM p a JOIN p b ON a.x < b.x), t AS (SELECT sum(n)::DOUBLE AS n FROM p), tx AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT sum(n)::DOUBLE AS k FROM p GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT sum(n)::DOUBLE AS k FROM p GROUP BY y)) SELECT CAST(t.n AS BIGINT) AS n, round(s / sqrt((t.n * (t.n - 1) / 2 - tx.t) * (t.n * (t.n - 1) / 2 - ty.t)), 6) AS tau_b FROM d, t, tx, ty",
)
def _(s, d):
    return bivariate.kendall(sql(s, d, L), "l_quantity", "l_discount").withColumn("tau_b", F.round("tau_b", 6))


@query(
    "biv02_cramers_v",
    "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e, sum(n) OVER () AS t, a, b FROM c) SELECT CAST(max(t) AS BIGINT) AS n, count(DISTINCT a) AS rows, count(DISTINCT b) AS columns, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, round(sum((n - e) ** 2 / e), 4) AS chi2, round(sqrt(sum((n - e) ** 2 / e) / (max(t) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS cramers_v FROM e",
)
def _(s, d):
    return bivariate.chi_square(sql(s, d, "SELECT * FROM orders"), "o_orderstatus", "o_orderpriority").drop("p_value")


@query("biv03_point_biserial", "SELECT count(*) AS n, round(corr(CAST(l_linestatus = 'O' AS INT), l_extendedprice), 6) AS correlation FROM lineitem")
def _(s, d):
    return bivariate.point_biserial(sql(s, d, L), "l_linestatus", "O", "l_extendedprice")


_RANKS = "SELECT g, count(*) AS n, sum(r) AS rs FROM (SELECT {g} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r FROM {t}) GROUP BY 1"
_TIES = "SELECT sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS t FROM {t} GROUP BY {v})"


@query(
    "biv04_kruskal",
    f"WITH r AS ({_RANKS.format(g='o_orderpriority', v='o_totalprice', t='orders')}), s AS ({_TIES.format(v='o_totalprice', t='orders')}), h AS (SELECT count(*) AS k, sum(n)::DOUBLE AS t, sum(rs * rs / n) AS q FROM r) SELECT k AS groups, CAST(t AS BIGINT) AS n, round((12 / (t * (t + 1)) * q - 3 * (t + 1)) / (1 - ties / (t * t * t - t)), 4) AS h, round((12 / (t * (t + 1)) * q - 3 * (t + 1)) / (1 - ties / (t * t * t - t)) / (t - 1), 6) AS epsilon_squared FROM h, s",
)
def _(s, d):
    return bivariate.kruskal(sql(s, d, "SELECT * FROM orders"), "o_orderpriority", "o_totalprice")


@query(
    "biv04_mann_whitney",
    f"WITH r AS ({_RANKS.format(g='l_linestatus', v='l_quantity', t='lineitem')}), p AS (SELECT max(CASE WHEN g = 'F' THEN n END) AS n1, max(CASE WHEN g = 'O' THEN n END) AS n2, max(CASE WHEN g = 'F' THEN rs END) AS r1 FROM r) SELECT round((r1 - n1 * (n1 + 1) / 2)::DOUBLE, 2) AS u, n1, n2, round((2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1)::DOUBLE, 6) AS rank_biserial FROM p",
)
def _(s, d):
    return bivariate.mann_whitney(sql(s, d, L), "l_linestatus", "l_quantity")


@query("biv07_vif")
def _(s, d):
    return bivariate.variance_inflation(sql(s, d, L), NUMBERS)


@query("biv06_relationship_graph")
def _(s, d):
    found = bivariate.relationship_graph(sql(s, d, "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_extendedprice * 2 + 1 AS twice, l_tax FROM lineitem"), ["l_quantity", "l_extendedprice", "twice", "l_tax"], ["l_orderkey", "l_linenumber"])
    return s.createDataFrame(found["edges"], "source string, target string, correlation double")


# ---- drift ---------------------------------------------------------------------------------------------------------


def _both(f, a: str = OLD_SHIFT, b: str = NEW_SHIFT):
    return lambda s, d: f(sql(s, d, a), sql(s, d, b))


_CTE = f"WITH r AS ({OLD_SHIFT}), c AS ({NEW_SHIFT}), "

query(
    "drf04_psi_numeric",
    _CTE
    + "e AS (SELECT DISTINCT unnest(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM r), i AS (SELECT list(e) AS es FROM e WHERE e > (SELECT min(e) FROM e) AND e < (SELECT max(e) FROM e)), b AS (SELECT 0 AS side, len(list_filter(es, lambda x: v >= x)) AS k FROM r, i UNION ALL SELECT 1, len(list_filter(es, lambda x: v >= x)) FROM c, i), n AS (SELECT k, sum(1 - side) AS r, sum(side) AS c FROM b GROUP BY 1), p AS (SELECT greatest(r / sum(r) OVER (), 1e-6::DOUBLE) AS r, greatest(c / sum(c) OVER (), 1e-6::DOUBLE) AS c FROM n) SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM p",
)(_both(lambda r, c: drift.psi_numeric(r, c, "v")))
query(
    "drf06_drf07_distances",
    _CTE
    + "f AS (SELECT v, sum(1 - s) AS r, sum(s) AS c FROM (SELECT 0 AS s, v FROM r UNION ALL SELECT 1, v FROM c) GROUP BY v), g AS (SELECT abs(sum(r) OVER o / sum(r) OVER () - sum(c) OVER o / sum(c) OVER ()) AS gap, lead(v) OVER o - v AS w, r, c FROM f WINDOW o AS (ORDER BY v)) SELECT CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(c) AS BIGINT) AS n_cur, round(max(gap), 6) AS ks, round(sum(gap * w), 6) AS wasserstein FROM g",
)(_both(lambda r, c: drift.ecdf_distances(r, c, "v")))
query("drf08_moments", _CTE + "m AS (SELECT avg(v) AS rm, stddev_pop(v) AS rs FROM r), n AS (SELECT avg(v) AS cm, stddev_pop(v) AS cs FROM c) SELECT round(rm, 6) AS ref_mean, round(cm, 6) AS cur_mean, round(rs, 6) AS ref_std, round(cs, 6) AS cur_std, round((cm - rm) / rs, 6) AS z_shift FROM m, n")(_both(lambda r, c: drift.side_moments(r, c, "v")))
query(
    "drf09_histogram",
    _CTE + "u AS (SELECT 0 AS s, v FROM r UNION ALL SELECT 1, v FROM c), m AS (SELECT min(v) AS lo, max(v) AS hi FROM u) SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, CAST(sum(1 - s) AS BIGINT) AS ref, CAST(sum(s) AS BIGINT) AS cur FROM u, m GROUP BY 1",
)(_both(lambda r, c: drift.shared_histogram(r, c, "v")))
_CATS = "x AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS r, coalesce(b.n, 0) AS c FROM (SELECT l_returnflag AS k, count(*) AS n FROM r GROUP BY 1) a FULL JOIN (SELECT l_returnflag AS k, count(*) AS n FROM c GROUP BY 1) b ON a.k = b.k)"
query(
    "drf05_drf10_categorical",
    _CTE + _CATS + ", p AS (SELECT r / sum(r) OVER () AS r, c / sum(c) OVER () AS c FROM x) SELECT count(*) AS n_categories, round(sum((greatest(c, 1e-6::DOUBLE) - greatest(r, 1e-6::DOUBLE)) * ln(greatest(c, 1e-6::DOUBLE) / greatest(r, 1e-6::DOUBLE))), 6) AS psi, round(sqrt(sum(CASE WHEN r > 0 THEN r * log2(2 * r / (r + c)) ELSE 0 END + CASE WHEN c > 0 THEN c * log2(2 * c / (r + c)) ELSE 0 END) / 2), 6) AS jensen_shannon FROM p",
)(_both(lambda r, c: drift.categorical_distances(r, c, "l_returnflag")))
query("drf12_category_changes", _CTE + _CATS + " SELECT k AS category, CASE WHEN r = 0 THEN 'new' ELSE 'missing' END AS change FROM x WHERE r = 0 OR c = 0")(_both(lambda r, c: drift.category_changes(r, c, "l_returnflag")))
query(
    "drf03_missingness",
    f"WITH r AS ({DIRTY} WHERE l_linestatus = 'F'), c AS ({DIRTY} WHERE l_linestatus = 'O') SELECT *, CASE WHEN abs(delta) >= 15 THEN 'severe' WHEN abs(delta) >= 5 THEN 'moderate' WHEN abs(delta) >= 2 THEN 'minor' ELSE 'stable' END AS severity FROM (SELECT *, round(cur_missing_percent - ref_missing_percent, 2) AS delta FROM ("
    + _union([f"SELECT '{k}' AS \"column\", (SELECT round(100 * (count(*) - count({k})) / count(*), 2) FROM r) AS ref_missing_percent, (SELECT round(100 * (count(*) - count({k})) / count(*), 2) FROM c) AS cur_missing_percent" for k in ("l_quantity", "l_discount", "l_returnflag")])
    + "))",
)(_both(lambda r, c: drift.missingness_delta(r, c, ["l_quantity", "l_discount", "l_returnflag"]), f"{DIRTY} WHERE l_linestatus = 'F'", f"{DIRTY} WHERE l_linestatus = 'O'"))
query(
    "drf13_datetime",
    "WITH u AS (SELECT CAST(o_orderdate >= TIMESTAMP '1998-01-01' AS INT) AS s, epoch_us(o_orderdate) / 86400e6 AS v FROM orders), f AS (SELECT v, sum(1 - s) AS r, sum(s) AS c FROM u GROUP BY v), g AS (SELECT abs(sum(r) OVER o / sum(r) OVER () - sum(c) OVER o / sum(c) OVER ()) AS gap, lead(v) OVER o - v AS w, r, c FROM f WINDOW o AS (ORDER BY v)) SELECT CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(c) AS BIGINT) AS n_cur, round(max(gap), 6) AS ks, round(sum(gap * w), 6) AS wasserstein FROM g",
)(lambda s, d: (lambda o: drift.ecdf_distances(drift._as_days(o.where("o_orderdate < TIMESTAMP '1998-01-01'"), "o_orderdate"), drift._as_days(o.where("o_orderdate >= TIMESTAMP '1998-01-01'"), "o_orderdate"), "o_orderdate"))(sql(s, d, "SELECT * FROM orders")))


@query("drf00_compare")
def _(s, d):
    found = drift.compare(sql(s, d, OLD_SHIFT), sql(s, d, NEW_SHIFT))
    return s.createDataFrame([(c["column"], c["type"], c["psi"], c["drift_severity"]) for c in found["columns"]], "column string, type string, psi double, drift_severity string")


# ---- contracts, gates, cleaning ------------------------------------------------------------------------------------


@query("con01_infer", _union([f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS observed_minimum, max({c})::DOUBLE AS observed_maximum, count(DISTINCT {c}) = count(*) AS is_unique FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice")]))
def _(s, d):
    found = contracts.infer_contract(sql(s, d, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"))["columns"]
    return s.createDataFrame([(n, float(r["observed_minimum"]), float(r["observed_maximum"]), r["unique"]) for n, r in found.items()], "column string, observed_minimum double, observed_maximum double, is_unique boolean")


_CON = {"version": 2, "allow_extra_columns": True, "columns": {"l_quantity": {"type": "number", "nullable": False, "minimum": 5, "maximum": 45}, "l_returnflag": {"type": "string", "allowed_values": ["A", "N"]}, "l_orderkey": {"type": "integer", "unique": True}, "l_discount": {"type": "number", "max_null_fraction": 0.005}, "absent": {"type": "string"}}}


@query(
    "con03_validate",
    f"WITH t AS ({DIRTY}) SELECT * FROM (SELECT 'l_quantity' AS \"column\", 'nullability_violation' AS code, 'error' AS severity, count(*) - count(l_quantity) AS violations FROM t UNION ALL SELECT 'l_quantity', 'minimum_violation', 'error', count(*) FROM t WHERE l_quantity < 5 UNION ALL SELECT 'l_quantity', 'maximum_violation', 'error', count(*) FROM t WHERE l_quantity > 45 UNION ALL SELECT 'l_returnflag', 'allowed_values_violation', 'error', count(*) FROM t WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'l_orderkey', 'uniqueness_violation', 'error', count(*) - count(DISTINCT l_orderkey) FROM t UNION ALL SELECT 'l_discount', 'null_fraction_violation', 'warning', count(*) - count(l_discount) FROM t HAVING count(*) - count(l_discount) > 0.005 * count(*) UNION ALL SELECT 'absent', 'missing_column', 'error', 1) WHERE violations > 0",
)
def _(s, d):
    return contracts.violations(sql(s, d, DIRTY), _CON)


@query("gat01_gate")
def _(s, d):
    from .operators.checks import DataCheck
    from .operators.gate import gate

    found = gate(sql(s, d, "SELECT l_quantity, l_discount FROM lineitem WHERE l_linestatus = 'O'"), reference=sql(s, d, "SELECT l_quantity, l_discount FROM lineitem WHERE l_linestatus = 'F'"), custom_checks=[DataCheck("positive", lambda df: F.col("l_quantity") > 0)])
    return s.createDataFrame([(found["status"], len(found["reasons"]), ",".join(found["checks_run"]))], "status string, reasons long, checks string")


_CUST = "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"
_TWICE = f"{_CUST} UNION ALL {_CUST} WHERE c_custkey % 20 = 1"


@query(
    "cln01_plan",
    f"WITH t AS (SELECT DISTINCT * FROM ({_TWICE})) SELECT 'drop_duplicates' AS id, CAST((SELECT count(*) FROM ({_TWICE})) - count(*) AS BIGINT) AS affected, NULL AS fill FROM t UNION ALL SELECT 'fill:c_acctbal', count(*) - count(c_acctbal), CAST(round(quantile_cont(c_acctbal, 0.5), 4) AS VARCHAR) FROM t UNION ALL SELECT 'fill:c_mktsegment', (SELECT count(*) - count(c_mktsegment) FROM t), (SELECT c_mktsegment FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
)
def _(s, d):
    plan = cleaning.infer_plan(sql(s, d, _TWICE))
    show = lambda a: str(round(float(a["fill_value"]), 4)) if a["strategy"] == "median" else a["fill_value"]
    return s.createDataFrame([(a["id"], a["affected"], show(a)) for a in plan["actions"]], "id string, affected long, fill string")


@query(
    "cln02_apply",
    f"WITH t AS (SELECT DISTINCT * FROM ({_TWICE})), m AS (SELECT quantile_cont(c_acctbal, 0.5) AS a, (SELECT c_mktsegment FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS b FROM t) SELECT c_custkey, round(coalesce(c_acctbal, a), 4) AS c_acctbal, coalesce(c_mktsegment, b) AS c_mktsegment FROM t, m",
)
def _(s, d):
    df = sql(s, d, _TWICE)
    return cleaning.apply_plan(df, cleaning.infer_plan(df)).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("cln04_guarded_text", "SELECT event_id, CASE WHEN regexp_matches(t, '^[=+\\-@]') THEN '''' || t ELSE t END AS t FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '=' || event_type WHEN event_id % 3 = 1 THEN '-' || event_type ELSE event_type END AS t FROM events)")
def _(s, d):
    return cleaning.guarded(sql(s, d, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '=' || event_type WHEN event_id % 3 = 1 THEN '-' || event_type ELSE event_type END AS t FROM events"))


# ---- anomalies -----------------------------------------------------------------------------------------------------

_MADS = " ".join(f", (SELECT m{k}, 1.4826 * quantile_cont(abs({c} - m{k}), 0.5) AS d{k} FROM lineitem, (SELECT quantile_cont({c}, 0.5) AS m{k} FROM lineitem) GROUP BY m{k})" for k, c in enumerate(NUMBERS))


@query("ano06_mad_scores", "SELECT l_orderkey, l_linenumber, l_partkey, round((" + " + ".join(f"abs({c} - m{k}) / d{k}" for k, c in enumerate(NUMBERS)) + f") / 4, 6) AS score FROM lineitem{_MADS}")
def _(s, d):
    return anomaly.mad_scores(sql(s, d, L), NUMBERS, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("ano01_top3_scores", "SELECT l_orderkey, l_linenumber, l_partkey, round(list_sum(list_reverse_sort([" + ", ".join(f"abs({c} - m{k}) / d{k}" for k, c in enumerate(NUMBERS)) + f"])[1:3]) / 3, 6) AS score FROM lineitem{_MADS}")
def _(s, d):
    return anomaly.top3_scores(sql(s, d, L), NUMBERS, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("ano01_fast_scan")
def _(s, d):
    return anomaly.fast_scan(sql(s, d, L), NUMBERS, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("ano03_isolation_forest")
def _(s, d):
    return anomaly.isolation_scores(sql(s, d, "SELECT * FROM orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"])


@query(
    "ano05_mahalanobis",
    "WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS mb, var_samp(l_quantity) AS va, var_samp(l_extendedprice) AS vb, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(greatest(0, (vb * (l_quantity - ma) ** 2 - 2 * c * (l_quantity - ma) * (l_extendedprice - mb) + va * (l_extendedprice - mb) ** 2) / (va * vb - c * c))), 6) AS distance FROM lineitem, m",
)
def _(s, d):
    return anomaly.mahalanobis(sql(s, d, L), ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query("ano04_lof")
def _(s, d):
    return ensemble.detector_scores(sql(s, d, "SELECT * FROM orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"], ("lof",))[0].drop("x")


@query("ano05_robust_distance")
def _(s, d):
    return ensemble.detector_scores(sql(s, d, L), ["l_quantity", "l_extendedprice", "l_discount"], ["l_orderkey", "l_linenumber", "l_partkey"], ("mcd",))[0].drop("x")


@query("ano07_copod")
def _(s, d):
    return ensemble.detector_scores(sql(s, d, "SELECT * FROM orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"], ("copod",))[0].drop("x")


@query("ano08_ensemble")
def _(s, d):
    return ensemble.ensemble(sql(s, d, L), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query("ano09_reconstruction")
def _(s, d):
    return ensemble.detector_scores(sql(s, d, L), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey"], ("reconstruction",))[0].drop("x")


@query("vec02_tfidf_top")
def _(s, d):
    return charts.tfidf_top(sql(s, d, "SELECT doc_id, text FROM documents"), "under the mit license", 10, "doc_id")


@query(
    "ano07_ecod",
    "WITH t AS (SELECT o_orderkey, " + ", ".join(f"-ln(count(*) OVER (ORDER BY {c}) / count(*) OVER ()) AS l{k}, -ln(count(*) OVER (ORDER BY {c} DESC) / count(*) OVER ()) AS r{k}" for k, c in enumerate(("o_totalprice", "o_custkey"))) + " FROM orders), w AS (SELECT skewness(o_totalprice) < 0 AS n0, skewness(o_custkey) < 0 AS n1 FROM orders) SELECT o_orderkey, round(greatest(l0 + l1, r0 + r1, CASE WHEN n0 THEN l0 ELSE r0 END + CASE WHEN n1 THEN l1 ELSE r1 END), 6) AS score FROM t, w",
)
def _(s, d):
    return anomaly.ecod_scores(sql(s, d, "SELECT * FROM orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"])


# ---- series --------------------------------------------------------------------------------------------------------

_DAILY = "SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS t, avg(o_totalprice) AS y FROM orders GROUP BY 1"


@query("tsr02_gaps", "WITH a AS (SELECT DISTINCT epoch_us(ts) AS u FROM events), g AS (SELECT (lead(u) OVER (ORDER BY u) - u) / 1e6 AS g FROM a) SELECT count(*) AS n, round(quantile_cont(g, 0.5), 3) AS median_gap_seconds, CASE WHEN quantile_cont(g, 0.5) <= 1.5 THEN 'secondly' WHEN quantile_cont(g, 0.5) <= 90 THEN 'minutely' WHEN quantile_cont(g, 0.5) <= 5400 THEN 'hourly' ELSE 'daily' END AS frequency FROM g")
def _(s, d):
    return series.gap_summary(sql(s, d, "SELECT * FROM events"), "ts")


def _daily(s, d):
    return series.regular_series(sql(s, d, "SELECT * FROM orders"), "o_orderdate", "o_totalprice")


@query("tsr06_autocorrelation", f"WITH s AS ({_DAILY}), i AS (SELECT row_number() OVER (ORDER BY t) AS i, y - avg(y) OVER () AS d FROM s) SELECT lag, round(sum(a.d * b.d) / (SELECT sum(d * d) FROM i), 6) AS acf FROM i a, range(1, 41) r(lag), i b WHERE b.i = a.i + lag GROUP BY lag")
def _(s, d):
    return series.autocorrelation(_daily(s, d), 40)


@query("tsr00_whole_series")
def _(s, d):
    return series.whole_series(_daily(s, d))


@query("chg02_window_means", "SELECT tile, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, ntile(24) OVER (ORDER BY ts, event_id) AS tile FROM events) GROUP BY 1")
def _(s, d):
    return series.window_means(sql(s, d, "SELECT * FROM events"), ["ts", "event_id"], "value")


_SHIFTED = "SELECT ts, event_id, value + CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 25 ELSE 0 END AS value FROM events"


@query(
    "chg01_page_hinkley",
    f"WITH RECURSIVE w AS (SELECT tile, round(avg(value), 6) AS y FROM (SELECT value, ntile(24) OVER (ORDER BY ts, event_id) AS tile FROM ({_SHIFTED})) GROUP BY 1), "
    "z AS (SELECT 0::BIGINT AS n, 0::DOUBLE AS m, 0::DOUBLE AS s, 0::DOUBLE AS u, 0::DOUBLE AS d, 0::DOUBLE AS top, 0 AS hit, NULL::BIGINT AS hit_at UNION ALL "
    "SELECT n + 1, CASE WHEN n = 0 THEN y ELSE m + (y - m) / (n + 1) END, CASE WHEN n = 0 THEN 0 ELSE s + (y - m) * (y - m - (y - m) / (n + 1)) END, nu, nd, greatest(top, nu, nd), CASE WHEN hit = 0 AND greatest(nu, nd) >= 8 THEN CASE WHEN nu >= nd THEN 1 ELSE -1 END ELSE hit END, CASE WHEN hit = 0 AND greatest(nu, nd) >= 8 THEN n + 1 ELSE hit_at END "
    "FROM (SELECT *, CASE WHEN n + 1 >= 8 THEN greatest(0, 0.995::DOUBLE * u + r - 0.5::DOUBLE) ELSE 0 END AS nu, CASE WHEN n + 1 >= 8 THEN greatest(0, 0.995::DOUBLE * d - r - 0.5::DOUBLE) ELSE 0 END AS nd "
    "FROM (SELECT z.*, y, greatest(-8, least(8, (y - m) / CASE WHEN n >= 2 AND sqrt(s / (n - 1)) > 1e-12 THEN sqrt(s / (n - 1)) ELSE greatest(abs(m) * 1e-6::DOUBLE, 1e-9::DOUBLE) END)) AS r FROM z JOIN w ON w.tile = z.n + 1))) "
    "SELECT n AS updates, round(u, 6) AS up, round(d, 6) AS down, round(top, 6) AS max_score, hit <> 0 AS detected, CASE hit WHEN 1 THEN 'up' WHEN -1 THEN 'down' END AS direction, hit_at AS detected_at, n >= 8 AS sufficient FROM z ORDER BY n DESC LIMIT 1",
)
def _(s, d):
    return series.page_hinkley(series.window_means(sql(s, d, _SHIFTED), ["ts", "event_id"], "value"))


# ---- text ----------------------------------------------------------------------------------------------------------

_TOK = f"SELECT unnest(regexp_extract_all(lower(text), '{text.WORD}')) AS token FROM documents"
_STOPS = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS))
_DOCS = "SELECT * FROM documents"


@query("txt03_lengths", "SELECT count(text) AS n, round(avg(length(text)), 4) AS mean, min(length(text)) AS min, max(length(text)) AS max, round(quantile_cont(length(text), 0.5), 4) AS median, round(quantile_cont(length(text), 0.95), 4) AS p95 FROM documents")
def _(s, d):
    return text.length_stats(sql(s, d, _DOCS), "text")


@query("txt04_vocabulary", f"WITH t AS ({_TOK}) SELECT count(*) AS tokens, count(DISTINCT token) AS vocabulary, round(count(DISTINCT token) / count(*), 6) AS type_token_ratio FROM t")
def _(s, d):
    return text.vocabulary(sql(s, d, _DOCS), "text")


@query("txt05_unigrams", f"WITH t AS ({_TOK}) SELECT token, count(*) AS n FROM t WHERE token NOT IN ({_STOPS}) AND length(token) > 1 GROUP BY 1 ORDER BY n DESC, token LIMIT 15")
def _(s, d):
    return text.top_unigrams(sql(s, d, _DOCS), "text")


@query("txt05_bigrams", f"WITH w AS (SELECT list_filter(regexp_extract_all(lower(text), '{text.WORD}'), lambda x: length(x) > 1 AND x NOT IN ({_STOPS})) AS w FROM documents), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w) SELECT bigram, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, bigram LIMIT 12")
def _(s, d):
    return text.top_bigrams(sql(s, d, _DOCS), "text")


@query("txt06_patterns", _union([f"SELECT '{k}' AS pattern, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS row_count FROM documents" for k, p in text.PATTERNS.items()]))
def _(s, d):
    return text.pattern_rows(sql(s, d, _DOCS), "text")


@query("txt07_ascii_share", r"WITH a AS (SELECT sum(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / sum(length(text)) AS s FROM documents) SELECT round(s, 6) AS ascii_share, CASE WHEN s >= 0.95 THEN 'latin' WHEN s >= 0.6 THEN 'mixed' ELSE 'other' END AS guess FROM a")
def _(s, d):
    return text.ascii_share(sql(s, d, _DOCS), "text")


@query("txt08_sentiment", f"WITH t AS ({_TOK}) SELECT count(*) FILTER (WHERE token IN ({', '.join(repr(w) for w in text.POSITIVE)})) AS positive, count(*) FILTER (WHERE token IN ({', '.join(repr(w) for w in text.NEGATIVE)})) AS negative FROM t")
def _(s, d):
    return text.sentiment(sql(s, d, _DOCS), "text")


@query("txt09_sentences", f"WITH p AS (SELECT unnest(regexp_split_to_array(text, '[.!?]+')) AS s FROM documents), n AS (SELECT len(regexp_extract_all(s, '{text.WORD}')) AS n FROM p) SELECT count(*) AS sentences, round(avg(n), 4) AS mean_words FROM n WHERE n > 0")
def _(s, d):
    return text.sentence_length(sql(s, d, _DOCS), "text")


# ---- target, segments, charts, vectors -----------------------------------------------------------------------------

_LAB = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@query("tgt02_class_balance", "WITH c AS (SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT *, 100 * max(n) OVER () / sum(n) OVER () AS m FROM c) SELECT class, n, round(100 * n / sum(n) OVER (), 4) AS percent, CASE WHEN m >= 90 THEN 'severely_imbalanced' WHEN m >= 75 THEN 'imbalanced' WHEN m >= 60 THEN 'slightly_imbalanced' ELSE 'balanced' END AS balance FROM t")
def _(s, d):
    return target.class_balance(sql(s, d, "SELECT * FROM labels"), "toxic")


@query("tgt03_mapping_purity", f"WITH c AS (SELECT source AS f, CAST(toxic AS VARCHAR) AS t, count(*) AS n FROM ({_LAB}) GROUP BY ALL), p AS (SELECT f, max(n) AS b, sum(n) AS n, sum(CASE WHEN f = t THEN n ELSE 0 END) AS same FROM c GROUP BY 1) SELECT count(*) AS levels, round(sum(same) / sum(n), 6) AS same_ratio, round(sum(b) / sum(n), 6) AS purity FROM p")
def _(s, d):
    return target.mapping_purity(sql(s, d, _LAB), "source", "toxic")


@query("tgt04_correlation_ratio", "WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), t AS (SELECT avg(l_extendedprice) AS a, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem) SELECT round(sqrt(sum(n * (m - a) ** 2) / max(ss)), 6) AS eta FROM g, t")
def _(s, d):
    return bivariate.correlation_ratio(sql(s, d, L), "l_returnflag", "l_extendedprice")


@query("tgt06_target_analysis")
def _(s, d):
    found = target.target_analysis(sql(s, d, _LAB), "toxic")
    return s.createDataFrame([(a["feature"], a["method"], a["value"]) for a in found["top_associations"]], "feature string, method string, value double")


def _segment_sql(source: str, g: str, v: str) -> str:
    return f"SELECT coalesce({g}, 'null') AS segment, count({v}) AS n, round(avg({v}), 4) AS mean, round(quantile_cont({v}, 0.5), 4) AS median, round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, round(max({v}), 4) AS max FROM ({source}) GROUP BY 1"


@query("seg01_segments", _segment_sql(DIRTY, "l_returnflag", "l_extendedprice"))
def _(s, d):
    return target.segments(sql(s, d, DIRTY), "l_returnflag", "l_extendedprice")


@query("seg01_shares", f"WITH c AS (SELECT lang AS segment, CAST(toxic AS VARCHAR) AS class, count(*) AS n FROM ({_LAB}) GROUP BY ALL) SELECT *, round(100 * n / sum(n) OVER (PARTITION BY segment), 4) AS percent FROM c")
def _(s, d):
    return target.segment_shares(sql(s, d, _LAB), "lang", "toxic")


@query("cht04_histogram", "WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 12)), 11) AS BIGINT) AS bin, count(*) AS n FROM orders, m GROUP BY 1")
def _(s, d):
    return charts.histogram(sql(s, d, "SELECT * FROM orders"), "o_totalprice")


@query("cht04_box", _union([f"SELECT '{c}' AS \"column\", min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1)) AS low, q1 AS q25, q2 AS q50, q3 AS q75, max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1)) AS high FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY q1, q2, q3" for c in NUMBERS]))
def _(s, d):
    return charts.box(sql(s, d, L), NUMBERS)


@query("cht03_cardinality", "SELECT * FROM (" + _union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio, count(DISTINCT {c}) / count({c}) >= 0.95 AS crowded FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]) + ")")
def _(s, d):
    return charts.cardinality_strip(sql(s, d, "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"))


@query("cht10_target_classes", "WITH c AS (SELECT o_orderpriority AS class, count(*) AS n FROM orders GROUP BY 1) SELECT class, n, round((SELECT min(n) / max(n) FROM c), 6) AS balance FROM c")
def _(s, d):
    found = charts.target_distribution(sql(s, d, "SELECT * FROM orders"), "o_orderpriority")
    return s.createDataFrame([(c, n, found["balance"]) for c, n in found["classes"]], "class string, n long, balance double")


@query("cht14_highlights")
def _(s, d):
    found = charts.bivariate_highlights(sql(s, d, L), NUMBERS, ["l_returnflag", "l_linestatus"])
    return s.createDataFrame([(f["left"], f["right"], f["method"], float(f["strength"])) for f in found], "left string, right string, method string, strength double")


@query("biv09_matrix_columns", _union([f"SELECT '{c}' AS \"column\" FROM lineitem HAVING stddev_pop({c}) > 0" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMBERS[1:])]))
def _(s, d):
    df = sql(s, d, "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, 1 AS same FROM lineitem")
    return s.createDataFrame([(n,) for n in bivariate.numeric_matrix(df, "l_quantity")], "column string")


@query("skt07_categorical_state")
def _(s, d):
    return sketches.categorical_state(sql(s, d, "SELECT event_type FROM events"), ["event_type"]).select("column", "n", "missing", "distinct")


@query("skt09_numeric_state", _union([f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM ({DIRTY})" for c in ("l_quantity", "l_discount")]))
def _(s, d):
    state = sketches.numeric_state(sql(s, d, DIRTY), ["l_quantity", "l_discount"])
    return state.select("column", "n", "missing", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


@query("sta07_shapiro")
def _(s, d):
    return statistics.shapiro(sql(s, d, "SELECT * FROM supplier"), ["s_acctbal"])


@query("cht05_difference", "SELECT count(l_extendedprice - l_quantity) AS n, round(avg(l_extendedprice - l_quantity), 6) AS mean, round(min(l_extendedprice - l_quantity), 6) AS min, round(max(l_extendedprice - l_quantity), 6) AS max FROM lineitem")
def _(s, d):
    return charts.difference(sql(s, d, L), "l_extendedprice", "l_quantity")


@query("cht07_pareto", "WITH t AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 15) SELECT value, n, round(100 * sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 4) AS cumulative_percent FROM t")
def _(s, d):
    return text.pareto(sql(s, d, "SELECT * FROM part"), "p_type")


@query("cht08_top_pairs", "SELECT * FROM (" + _union([f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in _PAIRS]) + ") ORDER BY abs(correlation) DESC LIMIT 3")
def _(s, d):
    return charts.top_pairs(sql(s, d, L), NUMBERS, 3)


@query("cht11_least_squares", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept FROM lineitem")
def _(s, d):
    return charts.least_squares(sql(s, d, L), "l_quantity", "l_extendedprice")


@query("cht13_rolling_mean", f"WITH s AS ({_DAILY}) SELECT t, round(y, 6) AS y, round(avg(y) OVER (ORDER BY t ROWS 29 PRECEDING), 6) AS rolling FROM s")
def _(s, d):
    return charts.rolling_mean(_daily(s, d), 30)


@query("vec01_cosine_top", "WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q), 6) AS cosine FROM embeddings, q ORDER BY cosine DESC, vec_id LIMIT 10")
def _(s, d):
    v = sql(s, d, "SELECT * FROM embeddings")
    return charts.cosine_top(v, list(v.where("vec_id = 7").first()["embedding"]), 10)


# ---- models --------------------------------------------------------------------------------------------------------


@query("mlp03_leaderboard")
def _(s, d):
    from .operators import ml

    return ml.leaderboard(sql(s, d, "SELECT o_totalprice, o_orderpriority, o_orderstatus FROM orders"), "o_orderstatus")


@query("mlp07_permutation_importance")
def _(s, d):
    from .operators import ml

    return ml.permutation_importance(sql(s, d, "SELECT l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem"), "l_linestatus")


@query(
    "mlp06_mutual_information",
    "WITH e AS (SELECT DISTINCT unnest(quantile_cont(l_extendedprice, [" + ", ".join(f"{k / 20}" for k in range(1, 20)) + "])) AS e FROM lineitem), i AS (SELECT list(e) AS es FROM e), c AS (SELECT len(list_filter(es, lambda q: l_extendedprice > q)) AS f, l_returnflag AS t, count(*) AS n FROM lineitem, i GROUP BY ALL), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY f) / sum(n) OVER () AS a, sum(n) OVER (PARTITION BY t) / sum(n) OVER () AS b FROM c) SELECT round(sum(p * ln(p / (a * b))), 6) AS mutual_information FROM p",
)
def _(s, d):
    from .operators import ml

    return ml.mutual_information(sql(s, d, L), "l_extendedprice", "l_returnflag")


@query("mlp06_feature_importance")
def _(s, d):
    from .operators import ml

    return ml.feature_importance(sql(s, d, "SELECT l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem"), "l_linestatus")


@query("sig03_findings")
def _(s, d):
    from .operators import signals

    df = sql(s, d, MESSY)
    r = roles.infer_roles(df)
    found = signals.findings(signals.dataset_signals(profile.build_profile(df), r), quality.run_quality(df, roles=r))
    return s.createDataFrame([(f["code"], f["severity"]) for f in found], "code string, severity string")
