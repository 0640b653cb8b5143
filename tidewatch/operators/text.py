"""Profiles of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import exact_quantiles

#: Words of letters, digits, underscores and hyphens, the same in all regular expression dialects.
WORD = r"[\p{L}\p{N}_\-]+"
#: Fixed values.
STOPWORDS = frozenset("a an and are as at be by for from has he in is it its of on or that the this to was were will with".split())
POSITIVE = ("good", "great", "excellent", "love", "happy", "best", "amazing", "fast", "nice")
NEGATIVE = ("bad", "poor", "terrible", "hate", "worst", "slow", "broken", "awful", "angry")
PATTERNS = {
    "emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+",
    "urls": r"https?://[^ ]+",
    "phones": r"\+?[0-9][0-9() .-]{6,}[0-9]",
    "mentions": r"(^| )@[A-Za-z0-9_]+",
    "hashtags": r"(^| )#[A-Za-z0-9_]+",
    "monetary": r"[$€£] ?[0-9]",
}


def tokens(df: DataFrame, column: str) -> DataFrame:
    """(token) rows of the lower-case words."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(f"`{column}`"), F.lit(WORD), F.lit(0))).alias("token"))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    n = F.length(f"`{column}`")
    found = exact_quantiles(df, [n], [0.5, 0.95], [F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")])[0]
    q = found["quantiles"] or (None, None)
    whole = lambda k: None if found.get(k) is None else int(found[k])
    row = df.sparkSession.createDataFrame([(found["n"], found.get("mean"), whole("min"), whole("max"), *q)], "n long, mean double, min long, max long, median double, p95 double")
    return row.select("n", F.round("mean", 4).alias("mean"), "min", "max", F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(tokens, vocabulary, type_token_ratio) from the token frequency table."""
    freq = tokens(df, column).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return freq.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("vocabulary"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("type_token_ratio"))


def top_unigrams(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    words = tokens(df, column).where(~F.col("token").isin(list(STOPWORDS)) & (F.length("token") > 1))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(top)


def top_bigrams(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """Pairs of neighbours in a row after stop words and single letters are removed."""
    words = F.regexp_extract_all(F.lower(f"`{column}`"), F.lit(WORD), F.lit(0))
    stops = F.array(*map(F.lit, sorted(STOPWORDS)))
    kept = df.select(F.filter(words, lambda w: ~F.array_contains(stops, w) & (F.length(w) > 1)).alias("w")).where("size(w) >= 2")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return kept.select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bigram").limit(top)


def pattern_rows(df: DataFrame, column: str) -> DataFrame:
    """(pattern, row_count) of rows that hold each pattern; one pass."""
    cells = [F.struct(F.lit(k).alias("pattern"), F.sum(F.when(F.col(f"`{column}`").rlike(p), 1).otherwise(0)).cast("long").alias("row_count")) for k, p in PATTERNS.items()]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def ascii_share(df: DataFrame, column: str) -> DataFrame:
    """(ascii_share, guess): latin script above .95, mixed above .6, else other."""
    t = F.col(f"`{column}`")
    share = F.sum(F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))) / F.sum(F.length(t))
    return df.agg(F.round(share, 6).alias("ascii_share"), F.when(share >= 0.95, "latin").when(share >= 0.6, "mixed").otherwise("other").alias("guess"))


def sentiment(df: DataFrame, column: str) -> DataFrame:
    """(positive, negative) token counts by seed words."""
    t = tokens(df, column)
    return t.agg(F.sum(F.col("token").isin(*POSITIVE).cast("int")).cast("long").alias("positive"), F.sum(F.col("token").isin(*NEGATIVE).cast("int")).cast("long").alias("negative"))


def sentence_length(df: DataFrame, column: str) -> DataFrame:
    """(sentences, mean_words) of pieces between sentence marks that hold a word."""
    piece = df.select(F.explode(F.split(f"`{column}`", r"[.!?]+")).alias("s"))
    n = piece.select(F.size(F.regexp_extract_all("s", F.lit(WORD), F.lit(0))).alias("n")).where("n > 0")
    return n.agg(F.count(F.lit(1)).alias("sentences"), F.round(F.avg("n"), 4).alias("mean_words"))


def is_text_like(df: DataFrame, column: str, leading: int = 500) -> bool:
    head = df.select(F.col(f"`{column}`").alias("t")).where("t is not null").limit(leading)
    row = head.agg(F.avg(F.length("t")), F.avg((F.size(F.split(F.trim("t"), r"\s+")) > 1).cast("int")), F.count_distinct("t"), F.count("t")).first()
    return bool(row[3]) and row[0] >= 8 and row[1] >= 0.3 and not (row[2] / row[3] > 0.95 and row[0] < 20)


def lsa(df: DataFrame, column: str, rows: int = 500, features: int = 1024, order: list[str] | None = None) -> list[tuple[float, float]]:
    """Two latent dimensions of up to `rows` texts by hashed TF-IDF and a singular value decomposition on the driver."""
    import numpy as np

    words = F.regexp_extract_all(F.lower(f"`{column}`"), F.lit(WORD), F.lit(0))
    head = df.where(F.col(f"`{column}`").isNotNull())
    head = head.orderBy(*order) if order else head
    got = head.limit(rows).select(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features))).alias("h")).collect()
    if len(got) < 10:
        return []
    x = np.zeros((len(got), features))
    for k, r in enumerate(got):
        np.add.at(x[k], np.array(r["h"], int), 1)
    x = np.log1p(x) * (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return [(float(a), float(b)) for a, b in u[:, :2] * s[:2]]


def profile_text(df: DataFrame, names: list[str], max_columns: int = 5) -> dict:
    found = [n for n in names if is_text_like(df, n)]
    one = lambda f: f.first().asDict()
    listed = lambda f: [tuple(r) for r in f.collect()]
    out = {}
    for n in found[:max_columns]:
        out[n] = {
            "length_stats": one(length_stats(df, n)), "tokens": one(vocabulary(df, n)), "avg_sentence_length": one(sentence_length(df, n))["mean_words"], "language": one(ascii_share(df, n)),
            "top_unigrams": listed(top_unigrams(df, n)), "top_bigrams": listed(top_bigrams(df, n)), "patterns": dict(listed(pattern_rows(df, n))), "sentiment_lite": one(sentiment(df, n)),
        }
    return {"available": bool(out), "detected_columns": found, "profiled_columns": list(out), "stopwords_source": "built-in", "profiles": out}


def pareto(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """(value, n, cumulative_percent) of the top values, percent of their own total."""
    best = df.groupBy(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
    w = Window.orderBy(F.desc("n"), "value").rowsBetween(Window.unboundedPreceding, 0)
    return best.select("value", "n", F.round(100 * F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 4).alias("cumulative_percent"))
