import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch import api
from tidewatch.functions import special as S
from tidewatch.functions.readonly_sql import run_query
from tidewatch.operators import anomaly, bivariate, charts, cleaning, contracts, drift, profile, quality, roles, sampling, series, sketches, snapshots
from tidewatch.plans import budget, config
from tidewatch.sources import readers


def test_special_functions_at_published_values():
    assert math.isclose(S.normal_ppf(0.975), 1.959964, abs_tol=1e-5)
    assert math.isclose(S.chi2_sf(3.841459, 1), 0.05, abs_tol=1e-6) and math.isclose(S.chi2_sf(18.307038, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(S.t_ppf(0.975, 10), 2.228139, abs_tol=1e-5) and math.isclose(S.f_sf(4.964603, 1, 10), 0.05, abs_tol=1e-6)
    assert S.binomial_ppf(0.025, 100, 0.5) == 40 and math.isclose(S.kolmogorov_sf(1.358099), 0.05, abs_tol=1e-5)


def test_moments_match_pandas_with_nan_and_infinity(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 3.0, 9.0, 12.0, float("nan"), float("inf"), None)], "x double")
    r = profile.numeric_summary(df, ["x"], digits=9).first()
    s = pd.Series([1, 2, 2, 3, 9, 12.0])
    assert (r["count"], r["missing"], r["infinite"]) == (6, 2, 1)
    assert math.isclose(r["skewness"], s.skew(), abs_tol=1e-6) and math.isclose(r["kurtosis"], s.kurt(), abs_tol=1e-6) and r["q25"] == s.quantile(0.25)


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    p = profile.build_profile(df)
    assert p["shape"] == {"rows": 0, "columns": 2} and p["duplicate_rows"] == 0


def test_sketch_is_close_and_merges(spark):
    a, b = (spark.range(lo, hi).select(F.col("id").cast("double").alias("x")) for lo, hi in ((1, 5001), (5001, 10001)))
    got = {r[0]: r[1] for r in sketches.bin_quantiles(sketches.merge_bins(sketches.log_bins(a, "x"), sketches.log_bins(b, "x")), [0.5, 0.95]).collect()}
    assert abs(got[0.5] - 5000) < 150 and abs(got[0.95] - 9500) < 285
    signed = spark.createDataFrame([(x,) for x in (-100.0, -10.0, -0.0, 0.0, 10.0, 100.0, float("nan"), float("inf"))], "x double")
    assert sketches.log_bins(signed, "x").agg(F.sum("n")).first()[0] == 6


def test_stratified_positions():
    p = sampling.stratified_positions(10_000, 100)
    assert p == sorted(set(p)) and len(p) == 100 and p[0] == 0 and p[-1] == 9_999
    spikes = sum(x % 51 == 0 for x in sampling.stratified_positions(5_000, 50)) / 50
    assert abs(spikes - 1 / 51) < 0.15 and sampling.stratified_positions(3, 1) == [1] and sampling.stratified_positions(0, 5) == []


def test_row_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"))
    for n in (1, 7):
        assert sampling.with_row_number(df.repartition(n), ["k"]).where("k <> row_number").count() == 0


def test_semantic_types(spark):
    values = {"email": ["a@b.co", "c@d.org", "e@f.net"], "url": ["http://a.b/c", "https://x.y", "http://z.w"], "uuid": ["123e4567-e89b-12d3-a456-426614174000"] * 3, "ip_address": ["1.2.3.4", "10.0.0.1", "255.1.1.1"], "percentage": ["1%", "2.5%", "30 %"], "currency": ["$1", "€2.50", "£3,000"], "json": ['{"a":1}', "[1]", "{}"], "boolean_token": ["yes", "no", "Yes"]}
    df = spark.createDataFrame(list(zip(*values.values(), strict=True)), list(values))
    found = roles.semantic_types(df, list(values))
    assert {n: t for n, (t, _) in found.items()} == {n: n for n in values}


def test_messy_frame_fires_every_check(spark):
    rows = [(f"c{k}", f"o{k // 2}", "a" if k < 38 else "b", k, k, str(k), "2025-01-01", " X" if k % 2 else "x", " " if k == 3 else "note", math.inf if k == 39 else 1.0 * k, None if k < 10 else k, None if k < 10 else k) for k in range(40)]
    df = spark.createDataFrame(rows, "customer_id string, order_id string, status string, base long, base_copy long, numeric_text string, event_text string, city string, notes string, ratio double, missing_a long, missing_b long")
    q = quality.run_quality(df)
    names = lambda k: {r["column"] for r in q[k]}
    assert "customer_id" in names("primary_key_candidates") and "order_id" in names("identifier_duplicates") and "status" in names("quasi_constant_columns")
    assert {"left": "base", "right": "base_copy"} in q["duplicate_columns"] and names("coercion_candidates") >= {"numeric_text", "event_text"}
    assert "city" in names("category_normalisation") and names("blank_strings") == {"notes"} and names("infinite_values") == {"ratio"}
    assert any((r["left"], r["right"]) == ("missing_a", "missing_b") for r in q["missingness_relationships"])


def test_contract_round_trip_and_codes(spark):
    df = spark.createDataFrame([(k, 1.0 * k, "ab"[k % 2]) for k in range(30)], "id long, balance double, plan string")
    c = contracts.infer_contract(df)
    assert contracts.validate(df, c)["status"] == "pass" and c["columns"]["id"]["unique"] and c["columns"]["plan"]["allowed_values"] == ["a", "b"]
    bad = spark.createDataFrame([(1, 500.0, "a", 1), (1, -500.0, "z", 1), (None, 3.0, "a", 1)], "id long, balance double, plan string, extra long")
    codes = set(contracts.validate(bad, c)["summary"]["code_counts"])
    assert codes == {"nullability_violation", "uniqueness_violation", "allowed_values_violation", "minimum_violation", "maximum_violation", "unexpected_column"}
    assert {"missing_column", "incompatible_type"} <= set(contracts.validate(df.select(F.col("id").cast("string"), "balance"), c)["summary"]["code_counts"])
    with pytest.raises(ValueError):
        contracts.normalise({"version": 3, "columns": {}})


def test_drift_verdicts(spark):
    frame = lambda lo, n, words: spark.createDataFrame([(lo + k, words[k % len(words)]) for k in range(n)], "v long, g string")
    same = drift.compare(frame(0, 50, "ab"), frame(0, 50, "ab"))
    assert same["summary"]["overall_verdict"] == "stable" and same["gate"]["status"] == "pass"
    moved = drift.compare(frame(0, 50, "abc"), frame(100, 50, "bcde"))
    by = {c["column"]: c for c in moved["columns"]}
    assert drift.at_least(by["v"]["psi_severity"], "moderate") and by["g"]["new_categories"] == ["d", "e"] and by["g"]["missing_categories"] == ["a"]
    changed = drift.compare(frame(0, 50, "ab"), frame(0, 50, "ab").select(F.col("v").cast("string")))
    assert changed["schema"]["severity"] == "severe" and changed["gate"]["status"] == "fail"


def test_gate_and_checks(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (-1.0,)], "revenue double")

    @api.check(severity="warning")
    def positive(frame):
        return F.col("revenue") > 0

    @api.check("broken")
    def _broken(frame):
        raise RuntimeError("no")

    assert api.run_checks(df, [positive])["status"] == "warn"
    out = api.run_checks(df, [positive, _broken])
    assert out["status"] == "fail" and out["results"][1]["exception"] == "RuntimeError"
    assert api.gate(df, custom_checks=[positive])["status"] == "warn"
    with pytest.raises(ValueError):
        api.gate(df)


def test_cleaning(spark, tmp_path):
    df = spark.createDataFrame([(20.0, "Pune"), (None, "Mumbai"), (30.0, None), (30.0, None)], "age double, city string")
    plan = cleaning.infer_plan(df)
    assert plan["duplicates_to_remove"] == 1 and plan["missing_values_to_fill"] == 2 and [a["type"] for a in plan["actions"]] == ["drop_duplicates", "fill_missing", "fill_missing"]
    done = cleaning.apply_plan(df, plan)
    assert done.count() == 3 and done.where("age is null or city is null").count() == 0
    cleaning.write_clean_csv(spark.createDataFrame([("=1+1",), ("ok",)], "t string"), str(tmp_path / "out"))
    assert {r[0] for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {"'=1+1", "ok"}


def test_snapshots(spark, tmp_path):
    base = {"profile": {"shape": {"rows": 1}, "dtypes": {"a": "int"}, "missing_percent": {"a": 0.0}}, "health": {"overall_score": 80}, "ml_readiness": {"score": 75}, "findings": [{"code": "x"}]}
    a = snapshots.create_snapshot(base)
    b = snapshots.create_snapshot(base | {"health": {"overall_score": 70}, "findings": [{"code": "y"}]})
    diff = snapshots.compare_snapshots(a, b)
    assert diff["changed"] and diff["health_delta"] == -10 and diff["findings"] == {"new": ["y"], "resolved": ["x"]}
    snapshots.save_snapshot(a, str(tmp_path / "s.json"))
    assert snapshots.load_snapshot(str(tmp_path / "s.json")) == a
    h = snapshots.SnapshotHistory(spark, str(tmp_path / "h"))
    h.add(a)
    h.add(b)
    assert h.compare_latest()["changed"] and h.timeline().count() == 2


def test_anomalies_recall(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(2000, 8))
    x[-12:] += 9
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{k}" for k in range(8)]).assign(id=range(2000)))
    names = [f"x{k}" for k in range(8)]
    assert sum(r["id"] >= 1988 for r in anomaly.fast_scan(df, names, ["id"], top_k=20).collect()) >= 8
    top = anomaly.isolation_scores(df, names, ["id"]).orderBy(F.desc("score")).limit(20).collect()
    assert sum(r["id"] >= 1988 for r in top) >= 8


def test_series(spark):
    rng = np.random.default_rng(1)
    y = 10 + np.sin(np.arange(400) * 2 * np.pi / 7) * 3 + rng.normal(0, 0.1, 400)
    assert series.period_by_fft(y) == 7 and series.decompose(y, 7)["seasonal_strength"] > 0.9
    assert series.stationarity(rng.normal(size=500))["verdict"] == "stationary" and series.stationarity(np.cumsum(rng.normal(size=500)))["adf"] > -3.4
    assert series.forecast_errors(y, 7)["available"]
    shift = spark.createDataFrame([(k, float(rng.normal(3.0 if k > 600 else 0.0, 1))) for k in range(1200)], "t long, v double")
    assert series.page_hinkley(series.window_means(shift, ["t"], "v")).first()["direction"] == "up"
    flat = spark.createDataFrame([(k, float(v)) for k, v in enumerate(np.random.default_rng(7).normal(10, 0.15, 240))], "t long, v double")
    assert not series.page_hinkley(series.window_means(flat, ["t"], "v")).first()["detected"]


def test_relationships(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=600)
    frame = pd.DataFrame({f"n{k}": rng.normal(size=600) for k in range(120)}).assign(base=base, copy=base * 2 + 0.01, negative=-base, id=range(600))
    g = bivariate.relationship_graph(spark.createDataFrame(frame), [c for c in frame if c != "id"], ["id"])
    assert ["base", "copy", "negative"] in [sorted(c) for c in g["components"]]
    frame = frame[["base", "copy", "n1"]]
    assert bivariate.redundant_groups(spark.createDataFrame(frame), list(frame)) == [["base", "copy"]]


def test_readonly_sql(spark):
    df = spark.range(5).withColumnRenamed("id", "a")
    assert run_query(df, "SELECT sum(a) AS s FROM data").first()[0] == 10
    for bad in ("DROP TABLE data", "INSERT INTO data VALUES (1)", "SELECT * FROM other", "SELECT java_method('a', 'b') FROM data", "CREATE TABLE x AS SELECT 1"):
        with pytest.raises(Exception):  # noqa: B017
            run_query(df, bad).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "l.csv").write_bytes("a,b\n1,caf\xe9\n".encode("latin-1"))
    assert readers.inspect_source(spark, str(tmp_path / "a.csv"))["rows"] == 2
    assert readers.resolve_source(spark, str(tmp_path / "l.csv")).frame.first()["b"] == "café"
    assert readers.resolve_source(spark, pa.table({"a": [1]})).frame.count() == readers.resolve_source(spark, pd.DataFrame({"a": [1]})).frame.count() == 1
    with pytest.raises(FileNotFoundError):
        readers.resolve_source(spark, str(tmp_path / "none.csv"))
    with pytest.raises(TypeError):
        readers.resolve_source(spark, 7)
    assert readers.safe_filename("../../e t.csv") == "e_t.csv"


def test_budget_and_config():
    assert budget.derive_budget(10**6, 10, "deep").limits["fit_rows"] == 4_096 and budget.column_limit(10**6, 50, 10) == 32 and budget.scale_class(200_000, 3) == "large"
    assert not config.resolve_config(mode="quick").enabled("time_series") and config.resolve_config(preset="modeling").enabled("modeling")
    with pytest.raises(ValueError):
        config.resolve_config(mode="odd")


def test_analyze_and_plan(spark):
    df = spark.createDataFrame([(k, float(k % 7), "ab"[k % 2], k % 2) for k in range(80)], "customer_id long, signal double, segment string, churn long")
    out = api.analyze(df, target="churn", mode="standard")
    assert out["target_intelligence"]["task_type"] == "classification" and "segment" in {x["feature"] for x in out["target_intelligence"]["leakage"]}
    assert out["health"]["overall_score"] > 0 and api.plan(df)["shape"]["rows"] == 80 and "<h2>health</h2>" in api.to_html(out)
    assert charts.facts({"a": [1, {"b": 2}]}) == [("a[0]", "1"), ("a[1].b", "2")]


def test_shapiro_at_published_values():
    from tidewatch.operators.statistics import shapiro_wilk

    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert math.isclose(w, 0.78881, abs_tol=1e-4) and math.isclose(p, 0.006704, abs_tol=2e-4)
    rng = np.random.default_rng(3)
    assert shapiro_wilk(np.sort(rng.normal(size=400)))[1] > 0.05 > shapiro_wilk(np.sort(rng.exponential(size=400)))[1]


def test_distribution_fits_find_the_source(spark):
    from tidewatch.operators import statistics

    assert math.isclose(S.digamma(1.0), -0.5772156649, abs_tol=1e-9) and math.isclose(S.trigamma(1.0), math.pi**2 / 6, abs_tol=1e-9)
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"norm": rng.normal(5, 2, 4000), "lognorm": rng.lognormal(0, 1, 4000), "gamma": rng.gamma(3, 2, 4000), "weibull_min": 40 * rng.weibull(2.5, 4000), "beta": rng.beta(2, 6, 4000)})
    found: dict = {}
    for r in statistics.distribution_fit(spark.createDataFrame(frame), list(frame)).collect():
        found.setdefault(r["column"], {})[r["distribution"]] = r["aic"]
    assert {n: min(f, key=f.get) for n, f in found.items()} == {n: n for n in frame}


def test_mean_shift_rules(spark):
    means = lambda ys: spark.createDataFrame([(k, y) for k, y in enumerate(ys)], "tile long, mean double")
    rng = np.random.default_rng(11)
    moved = series.page_hinkley(means([float(x) for x in np.r_[rng.normal(10, 0.2, 30), rng.normal(12, 0.2, 20)]])).first()
    assert moved["detected"] and moved["direction"] == "up" and moved["detected_at"] > 30 and moved["sufficient"]
    quiet = series.page_hinkley(means([float(x) for x in np.random.default_rng(7).normal(10, 0.15, 80)]), threshold=10.0).first()
    assert not quiet["detected"] and quiet["updates"] == 80
    none = series.page_hinkley(means([None, float("nan"), float("inf")])).first()
    assert none["updates"] == 0 and not none["sufficient"]


def test_split_by_date_is_exact_with_ties(spark):
    rows = [(k, f"2024-01-{1 + k // 30:02d}") for k in range(100)] + [(100, None)]
    old, new = sampling.split_by_date(spark.createDataFrame(rows, "k long, d string"), "d")
    assert old.count() == new.count() == 50 and old.columns == ["k", "d"]
    assert max(r.d for r in old.collect()) <= min(r.d for r in new.collect())


def test_results_can_be_asked(spark):
    df = spark.createDataFrame([(k, float(k % 7), "ab"[k % 2]) for k in range(80)], "customer_id long, signal double, segment string")
    out = api.analyze(df, mode="research", disabled_modules=["modeling", "explainability"])
    assert out.summary()["shape"] == {"rows": 80, "columns": 3} and out.column("segment")["categorical"]["unique_values"] == 2
    assert out.section("profile.shape.rows") == 80 and out["execution"]["anomaly_method"] == "ensemble"
    assert out["provenance"]["profile"]["method"] == "exact" and out["provenance"]["anomalies_v2"]["method"] == "fitted_on_sample"
    assert out["display_cards"][0]["severity"] >= out["display_cards"][-1]["severity"] and out["bootstrap"]
    assert out.top_anomalies(3) and out.search("customer_id") and "80 rows" in out.brief() and out.to_snapshot()


def test_wide_tables_take_few_jobs(spark):
    from tidewatch.operators.facts import Facts

    df = spark.createDataFrame([tuple(float(k * j % 13) for j in range(1, 61)) + (f"v{k % 5}",) for k in range(200)], ", ".join(f"n{j} double" for j in range(60)) + ", t string")
    tracker, group = spark.sparkContext.statusTracker(), "wide"
    spark.sparkContext.setJobGroup(group, group)
    try:
        p = profile.build_profile(df, facts=Facts(df))
    finally:
        jobs = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 30 and p["correlations"]["n0"]["n1"] is not None


def test_long_series_are_tiled_and_lags_cross_blocks(spark, monkeypatch):
    from tidewatch.operators import ranks

    y = np.random.default_rng(2).normal(size=900).cumsum()
    frame = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "k long, y double").select(F.timestamp_seconds("k").alias("t"), "y").repartition(5)
    d = y - y.mean()
    want = [float((d[k:] * d[:-k]).sum() / (d @ d)) for k in range(1, 6)]
    for block, rows in ((100_000, 1_000_000), (7, 100)):
        monkeypatch.setattr(series, "BLOCK", block)
        monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
        assert np.allclose([r["acf"] for r in series.autocorrelation(frame, 5).orderBy("lag").collect()], want, atol=1e-6)
    got = [r["y"] for r in series.tiled(frame, 90).orderBy("t").collect()]
    assert np.allclose(got, y.reshape(90, 10).mean(1)) and series.tiled(frame, 900).count() == 900


def test_bounded_parts(spark):
    from tidewatch.operators import target as target_

    df = spark.createDataFrame([(k, float(k % 7), "ab"[k % 2], k % 2, 1) for k in range(100)], "id long, signal double, segment string, churn long, same int")
    found = target_.bounded_target_analysis(df, "churn", 3)
    assert found["available"] and found["columns_left_out"] == 2
    assert bivariate.numeric_matrix(df, "churn") == ["id", "signal"] and bivariate.numeric_matrix(df, "churn", 1) == ["id"]
    assert profile.duplicate_estimate(df, ["id"], 50)["duplicate_rows"] == 0
    assert charts.target_distribution(df, "id")["kind"] == "numeric" and charts.target_distribution(df, "segment")["balance"] == 1.0
    assert charts.best_rows([{"a": 1}, {"a": 3}, {"a": None}], "a", 1) == [{"a": 3}]
    top = charts.bivariate_highlights(df, ["id", "signal"], ["segment"])
    assert top and all(0 <= t["strength"] <= 1 for t in top)


def test_signals_choose_analyses(spark):
    from tidewatch.operators import signals

    df = spark.createDataFrame([(k, 1.0 * k, f"u{k}@mail.com", "ab"[k % 2], "2024-01-01") for k in range(40)], "id long, price double, contact string, gender string, created string")
    r = roles.infer_roles(df)
    s = signals.dataset_signals(profile.build_profile(df), r)
    assert s["has_email_like_columns"] and s["email_like_columns"] == ["contact"] and s["sensitive_columns"] == ["gender"] and s["has_id_like_columns"]
    quick, deep = signals.select_analyses(s, 40, mode="quick"), signals.select_analyses(s, 40, "gender", "deep")
    assert set(quick["selected"]) < set(deep["selected"]) and {"privacy_analysis", "normality_tests", "target_analysis"} <= set(deep["selected"])
    assert {"analysis": "baseline_model", "reason": "needs mode research"} in deep["skipped"]
    values = {"url": ["www.python.org", "http://a.b"], "ip_address": ["2001:db8::1", "10.0.0.8"], "currency": ["INR 5000", "$19.99"], "boolean_token": ["off", "YES"]}
    found = roles.semantic_types(spark.createDataFrame(list(zip(*values.values(), strict=True)), list(values)), list(values))
    assert {n: t for n, (t, _) in found.items()} == {n: n for n in values}
