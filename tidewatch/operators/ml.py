"""Baselines, a leaderboard, importances and diagnostics with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import profile as P
from .ranks import exact_quantiles
from .roles import name_tokens
from .target import task_type

MIN_ROWS, MAX_LEVELS = 20, 50


def prepare(df: DataFrame, target: str) -> tuple[DataFrame, dict]:
    """(frame with label, numeric and text columns; what was kept and why the rest was dropped)."""
    counts = {r["column"]: r for r in P.distinct_counts(df).collect()}
    numbers, numeric, text, dropped = X.numeric_columns(df), [], [], {}
    rows = df.count()
    for f in df.schema:
        n, k = f.name, counts.get(f.name)
        distinct, filled = (k["distinct_values"], k["non_null"]) if k else (0, 0)
        if n == target:
            continue
        if distinct <= 1:
            dropped[n] = "constant"
        elif name_tokens(n) & {"id", "uuid", "guid"} and filled and distinct / filled > 0.95:
            dropped[n] = "identifier"
        elif filled < 0.3 * rows:
            dropped[n] = "mostly missing"
        elif n in numbers:
            numeric.append(n)
        elif X.family(f.dataType) in ("string", "boolean") and distinct <= MAX_LEVELS:
            text.append(n)
        else:
            dropped[n] = "too many levels or unsupported type"
    kind = task_type(df, target)
    label = F.col(f"`{target}`").cast("double") if kind == "regression" else F.col(f"`{target}`").cast("string")
    out = df.where(F.col(f"`{target}`").isNotNull()).select(label.alias("_target"), *[X.finite(df, n).alias(n) for n in numeric], *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("missing")).alias(n) for n in text])
    return out, {"task_type": kind, "numeric": numeric, "categorical": text, "dropped": dropped, "usable": bool(numeric or text) and rows >= MIN_ROWS, "rows": rows}


def preprocessor(info: dict) -> list:
    """Median imputation and scaling of numbers, one-hot encoding of text."""
    stages, parts = [], []
    if info["numeric"]:
        filled = [f"{n}__f" for n in info["numeric"]]
        stages += [Imputer(strategy="median", inputCols=info["numeric"], outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    for n in info["categorical"]:
        stages += [StringIndexer(inputCol=n, outputCol=f"{n}__i", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{n}__i"], outputCols=[f"{n}__v"])]
        parts.append(f"{n}__v")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    if info["task_type"] == "classification":
        stages.append(StringIndexer(inputCol="_target", outputCol="label", stringOrderType="alphabetAsc"))
    return stages


def with_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """A fold by the hash of the row: no sort and no state, the same at any partitioning."""
    return df.withColumn("_fold", F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in df.columns]), F.lit(folds)))


def models(kind: str, classes: int) -> dict:
    if kind == "regression":
        return {"linear": LinearRegression(labelCol="_target"), "ridge": LinearRegression(labelCol="_target", regParam=0.1, elasticNetParam=0.0), "lasso": LinearRegression(labelCol="_target", regParam=0.1, elasticNetParam=1.0), "random_forest": RandomForestRegressor(labelCol="_target", numTrees=50, maxDepth=8, seed=42), "gradient_boosting": GBTRegressor(labelCol="_target", maxIter=30, maxDepth=4, seed=42)}
    out = {"logistic": LogisticRegression(maxIter=50), "random_forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=42)}
    if classes == 2:
        out["gradient_boosting"] = GBTClassifier(maxIter=30, maxDepth=4, seed=42)
    return out


def leaderboard(df: DataFrame, target: str, folds: int = 5, names: list[str] | None = None) -> DataFrame:
    """(model, metric, score, lift): cross-validated scores, with the dummy that predicts the mean or the commonest class."""
    frame, info = prepare(df, target)
    spark = df.sparkSession
    if not info["usable"]:
        return spark.createDataFrame([], "model string, metric string, score double, lift double")
    regression = info["task_type"] == "regression"
    frame = with_folds(frame, folds).persist()
    try:
        metric = "r2" if regression else "accuracy"
        judge = RegressionEvaluator(labelCol="_target", metricName="r2") if regression else MulticlassClassificationEvaluator(metricName="accuracy")
        classes = 0 if regression else frame.select("_target").distinct().count()
        base = 0.0 if regression else frame.groupBy("_target").count().agg(F.max("count") / F.sum("count")).first()[0]
        rows = [("dummy", metric, float(base), 0.0)]
        for name, model in models(info["task_type"], classes).items():
            if names and name not in names:
                continue
            scores = []
            for k in range(folds):
                train, test = frame.where(F.col("_fold") != k), frame.where(F.col("_fold") == k)
                fitted = Pipeline(stages=[*(s if not isinstance(s, StringIndexer) or s.getInputCol() != "_target" else s.copy({s.handleInvalid: "skip"}) for s in preprocessor(info)), model]).fit(train)
                scores.append(judge.evaluate(fitted.transform(test)))
            rows.append((name, metric, sum(scores) / len(scores), sum(scores) / len(scores) - float(base)))
        return spark.createDataFrame(rows, "model string, metric string, score double, lift double").orderBy(F.desc("score"), "model")
    finally:
        frame.unpersist()


def feature_importance(df: DataFrame, target: str) -> DataFrame:
    """(feature, importance) of a random forest, summed over the levels of encoded columns."""
    frame, info = prepare(df, target)
    model = RandomForestRegressor(labelCol="_target", numTrees=50, maxDepth=8, seed=42) if info["task_type"] == "regression" else RandomForestClassifier(numTrees=50, maxDepth=8, seed=42)
    fitted = Pipeline(stages=[*preprocessor(info), model]).fit(frame)
    attrs = fitted.transform(frame).schema["features"].metadata["ml_attr"]["attrs"]
    owner = {}
    for group in attrs.values():
        for a in group:
            name = a.get("name", "")
            if name.startswith("_scaled"):
                owner[a["idx"]] = info["numeric"][int(name.rsplit("_", 1)[1])]
            else:
                owner[a["idx"]] = next((n for n in info["categorical"] if name.startswith(f"{n}__v")), name)
    totals: dict[str, float] = {}
    for k, v in enumerate(fitted.stages[-1].featureImportances.toArray()):
        totals[owner.get(k, str(k))] = totals.get(owner.get(k, str(k)), 0.0) + float(v)
    return df.sparkSession.createDataFrame(sorted(totals.items(), key=lambda r: (-r[1], r[0])), "feature string, importance double")


def mutual_information(df: DataFrame, feature: str, target: str, bins: int = 20) -> DataFrame:
    """(mutual_information) in nats over the contingency of the target and the feature, numbers in equal-frequency bins."""
    c = F.col(f"`{feature}`").cast("string")
    if feature in X.numeric_columns(df):
        edges = exact_quantiles(df, [X.finite(df, feature)], [k / bins for k in range(1, bins)])[0]["quantiles"] or []
        c = F.lit(0)
        for e in sorted(set(edges)):
            c = c + (X.finite(df, feature) > e).cast("int")
        c = c.cast("string")
    cells = df.select(c.alias("f"), F.col(f"`{target}`").cast("string").alias("t")).where("f is not null and t is not null")
    from .bivariate import contingency

    m = contingency(cells, "f", "t")
    p = F.col("n") / F.col("total")
    return m.agg(F.round(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("row_total") * F.col("column_total")))), 6).alias("mutual_information"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def baseline(df: DataFrame, target: str) -> dict:
    """A random forest against the dummy on a hash split of three to one."""
    frame, info = prepare(df, target)
    if not info["usable"]:
        return {"available": False, "dropped": info["dropped"]}
    split = with_folds(frame, 4)
    regression = info["task_type"] == "regression"
    model = RandomForestRegressor(labelCol="_target", numTrees=60, maxDepth=8, seed=42) if regression else RandomForestClassifier(numTrees=60, maxDepth=8, seed=42)
    stages = [s if not isinstance(s, StringIndexer) or s.getInputCol() != "_target" else s.copy({s.handleInvalid: "skip"}) for s in preprocessor(info)]
    fitted = Pipeline(stages=[*stages, model]).fit(split.where("_fold > 0"))
    test = fitted.transform(split.where("_fold = 0"))
    if regression:
        score = RegressionEvaluator(labelCol="_target", metricName="rmse").evaluate(test)
        dummy = test.select(F.sqrt(F.avg((F.col("_target") - split.where("_fold > 0").agg(F.avg("_target")).first()[0]) ** 2))).first()[0]
        return {"available": True, "metric": "rmse", "score": score, "dummy": dummy, "dropped": info["dropped"]}
    score = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(test)
    dummy = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    return {"available": True, "metric": "accuracy", "score": score, "dummy": dummy, "confusion": [tuple(r) for r in confusion(test, "label", "prediction").orderBy("label", "prediction").collect()], "dropped": info["dropped"]}


def permutation_importance(df: DataFrame, target: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance, deviation): how far a random forest's held-out score falls when one column's values are exchanged.

    Rows are numbered once in the order of a hash; a repeat shifts the column by a different offset along these
    numbers, which is an equi-join, and nothing is gathered.
    """
    from .sampling import with_row_number

    frame, info = prepare(df, target)
    spark = df.sparkSession
    if not info["usable"]:
        return spark.createDataFrame([], "feature string, importance double, deviation double")
    split = with_folds(frame, 4)
    regression = info["task_type"] == "regression"
    model = RandomForestRegressor(labelCol="_target", numTrees=50, maxDepth=8, seed=42) if regression else RandomForestClassifier(numTrees=50, maxDepth=8, seed=42)
    judge = RegressionEvaluator(labelCol="_target", metricName="r2") if regression else MulticlassClassificationEvaluator(metricName="accuracy")
    stages = [s if not isinstance(s, StringIndexer) or s.getInputCol() != "_target" else s.copy({s.handleInvalid: "skip"}) for s in preprocessor(info)]
    fitted = Pipeline(stages=[*stages, model]).fit(split.where("_fold > 0"))
    mixed = split.where("_fold = 0").withColumn("_mix", F.xxhash64(*[F.col(f"`{n}`") for n in frame.columns], F.lit(seed)))
    test = with_row_number(mixed, ["_mix"], "_at").persist()
    try:
        rows, out = test.count(), []
        if not rows:
            return spark.createDataFrame([], "feature string, importance double, deviation double")
        whole = judge.evaluate(fitted.transform(test))
        for n in [*info["numeric"], *info["categorical"]]:
            falls = []
            for k in range(repeats):
                step = max(1, rows * (k + 1) // (repeats + 1)) % max(rows, 1)
                moved = test.select(F.pmod(F.col("_at") + step, F.lit(rows)).alias("_at"), F.col(f"`{n}`"))
                falls.append(whole - judge.evaluate(fitted.transform(test.drop(n).join(moved, "_at"))))
            mean = sum(falls) / repeats
            out.append((n, mean, (sum((f - mean) ** 2 for f in falls) / repeats) ** 0.5))
        return spark.createDataFrame(sorted(out, key=lambda r: (-r[1], r[0])), "feature string, importance double, deviation double")
    finally:
        test.unpersist()
