"""The data behind charts, and vector retrieval."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from .ranks import exact_quantiles


def histogram(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """(bin, n) of equal widths over the finite range, the last bin closed."""
    x = X.finite(df, column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    width = (hi - lo) / bins
    bin_ = F.least(F.floor((x - lo) / width), F.lit(bins - 1)) if width > 0 else F.when(x.isNotNull(), 0)
    return df.where(x.isNotNull()).groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, low, q25, q50, q75, high): five numbers with whiskers at the last values inside 1.5 IQR."""
    found = exact_quantiles(df, [X.finite(df, n) for n in names], [0.25, 0.5, 0.75])
    cells = []
    for n, f in zip(names, found, strict=True):
        if f["quantiles"] is None:
            continue
        a, m, b = f["quantiles"]
        x = X.finite(df, n)
        cells.append(F.struct(F.lit(n).alias("column"), F.min(F.when(x >= a - 1.5 * (b - a), x)).alias("low"), F.lit(a).alias("q25"), F.lit(m).alias("q50"), F.lit(b).alias("q75"), F.max(F.when(x <= b + 1.5 * (b - a), x)).alias("high")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, low double, q25 double, q50 double, q75 double, high double")
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def schema_composition(df: DataFrame) -> DataFrame:
    kinds: dict[str, int] = {}
    for f in df.schema:
        kinds[X.family(f.dataType)] = kinds.get(X.family(f.dataType), 0) + 1
    return df.sparkSession.createDataFrame(sorted(kinds.items()), "family string, n long")


def difference(df: DataFrame, ask: str, bid: str) -> DataFrame:
    """(n, mean, min, max) of the row difference of two columns, nulls dropped."""
    d = X.finite(df, ask) - X.finite(df, bid)
    return df.agg(F.count(d).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.min(d), 6).alias("min"), F.round(F.max(d), 6).alias("max"))


def least_squares(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept) over rows where both are finite."""
    a, b = X.finite(df, x), X.finite(df, y)
    return df.agg(F.round(F.regr_slope(b, a), 6).alias("slope"), F.round(F.regr_intercept(b, a), 6).alias("intercept"))


def rolling_mean(series: DataFrame, width: int) -> DataFrame:
    """(t, y, rolling) of a series (t, y) that is already aggregated to a bounded grain."""
    w = Window.orderBy("t").rowsBetween(1 - width, 0)
    return series.select("t", F.round("y", 6).alias("y"), F.round(F.avg("y").over(w), 6).alias("rolling"))


def rolling_width(n: int) -> int:
    return max(7, n // 30)


def top_pairs(df: DataFrame, names: list[str], top: int = 10) -> DataFrame:
    from .profile import correlations

    return correlations(df, names, 6).where("correlation is not null").orderBy(F.desc(F.abs("correlation")), "left", "right").limit(top)


def cosine_top(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cosine) of the k nearest rows; rows of norm zero score 0. One pass, a bounded heap a task."""
    q = F.array(*[F.lit(float(v)) for v in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = sum(v * v for v in query) ** 0.5
    own = F.sqrt(dot(F.col(column), F.col(column)))
    score = F.when((own > 0) & F.lit(norm > 0), dot(F.col(column), q) / (own * (norm or 1.0))).otherwise(0.0)
    return vectors.select(key, F.round(score, 6).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


def facts(result: object, path: str = "", most: int = 10) -> list[tuple[str, str]]:
    """(path, value) leaves of a nested result, lists cut."""
    if isinstance(result, dict):
        return [f for k, v in result.items() for f in facts(v, f"{path}.{k}" if path else str(k), most)]
    if isinstance(result, (list, tuple)):
        return [f for k, v in enumerate(result[:most]) for f in facts(v, f"{path}[{k}]", most)]
    return [(path, str(result))]


def tfidf_top(texts: DataFrame, question: str, k: int = 5, key: str = "path", column: str = "text", features: int = 4_096) -> DataFrame:
    """(key, cosine) of the k texts nearest to a question, as TF-IDF vectors of words and word pairs hashed to `features` slots.

    Slots that the question lacks add to a text's norm alone, so only (slot, document frequency) pairs, at most `features`
    rows, are joined to the texts' terms. Texts that share no slot with the question are left out; null texts are empty.
    """
    def slots(of):
        words = F.array_remove(F.split(F.lower(F.coalesce(of, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        pairs = F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        return F.transform(F.concat(words, pairs), lambda w: F.pmod(F.xxhash64(w), F.lit(features)))

    def counted(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("tf"))

    rows = texts.count()
    terms = counted(texts.select(key, F.explode(slots(F.col(column).cast("string"))).alias("slot")), [key])
    idf = terms.groupBy("slot").agg((F.log((1 + F.lit(rows)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    asked = counted(texts.sparkSession.range(1).select(F.explode(slots(F.lit(question))).alias("slot")), []).withColumnRenamed("tf", "q")
    asked = asked.join(idf, "slot", "left").na.fill(log(1 + rows) + 1, ["idf"]).select("slot", (F.col("q") * F.col("idf")).alias("q"))
    norm = float(asked.agg(F.sqrt(F.sum(F.col("q") ** 2))).first()[0] or 0.0)
    weighed = terms.join(idf, "slot").join(asked, "slot", "left").withColumn("w", F.col("tf") * F.col("idf"))
    found = weighed.groupBy(key).agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") ** 2)).alias("own"))
    return found.where("dot > 0").select(key, F.round(F.col("dot") / (F.col("own") * (norm or 1.0)), 6).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


def cardinality_strip(df: DataFrame, names: list[str] | None = None, top: int = 18, ratio: float = 0.95) -> DataFrame:
    """(column, distinct_values, unique_ratio, crowded) of the columns with the most distinct values; crowded ones are nearly unique."""
    from .profile import distinct_counts

    counts = distinct_counts(df, names)
    share = F.coalesce(F.col("distinct_values") / F.nullif("non_null", F.lit(0)), F.lit(0.0))
    return counts.select("column", "distinct_values", F.round(share, 6).alias("unique_ratio"), (share >= ratio).alias("crowded")).orderBy(F.desc("distinct_values"), "column").limit(top)


def target_distribution(df: DataFrame, target: str, bins: int = 12) -> dict:
    """A histogram of a target that is numeric in effect (85 % of its values parse and more than ten differ), else its classes and their balance, the least count over the largest."""
    c = F.col(f"`{target}`")
    number = F.expr(f"try_cast(cast(`{target}` as string) as double)")
    row = df.where(c.isNotNull()).agg(F.avg(number.isNotNull().cast("int")), F.count_distinct(c)).first()
    if row[0] is not None and row[0] >= 0.85 and row[1] > 10:
        return {"kind": "numeric", "bins": [tuple(r) for r in histogram(df.select(number.alias(target)), target, bins).orderBy("bin").collect()]}
    classes = df.where(c.isNotNull()).groupBy(c.cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    ends = classes.agg(F.min("n"), F.max("n")).first()
    shown = [tuple(r) for r in classes.orderBy(F.desc("n"), "class").limit(bins).collect()]
    return {"kind": "classes", "classes": shown, "balance": round(ends[0] / ends[1], 6) if ends[1] else None}


def best_rows(rows: list[dict], by: str, top: int) -> list[dict]:
    """The rows with the largest values of `by`: leaderboards (top 8) and importances (top 12)."""
    return sorted((r for r in rows if r.get(by) is not None), key=lambda r: -r[by])[:top]


def bivariate_highlights(df: DataFrame, numbers: list[str], categories: list[str], top: int = 12) -> list[dict]:
    """The strongest relations of all kinds: correlations, correlation ratios and Cramer's V, each within 0..1."""
    from itertools import combinations

    from .bivariate import chi_square, correlation_ratio
    from .profile import correlations

    found = [{"left": r["left"], "right": r["right"], "method": "pearson", "strength": abs(r["correlation"])} for r in correlations(df, numbers, 6).collect() if r["correlation"] is not None]
    for c in categories:
        for n in numbers:
            found.append({"left": c, "right": n, "method": "correlation_ratio", "strength": correlation_ratio(df, c, n).first()[0]})
    for a, b in combinations(categories, 2):
        found.append({"left": a, "right": b, "method": "cramers_v", "strength": chi_square(df, a, b).first()["cramers_v"]})
    found = [f for f in found if f["strength"] is not None and f["strength"] == f["strength"]]
    return sorted(found, key=lambda f: (-f["strength"], f["left"], f["right"]))[:top]
