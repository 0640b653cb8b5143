import random
from datetime import datetime, timedelta

import pytest
from compare import difference
from pyspark.sql import functions as F

from tidewatch import registry
from tidewatch.operators import sampling


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """Events and orders of sf0.1 six times, with shifted keys."""
    path = tmp_path_factory.mktemp("larger")
    for name, key in (("events", "event_id"), ("orders", "o_orderkey")):
        df = spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
        df.crossJoin(spark.range(6).withColumnRenamed("id", "_r")).withColumn(key, F.col(key) + F.col("_r") * 1_000_000).drop("_r").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def larger_difference(spark, name, path):
    sql = registry.ORACLE[name]
    for table in ("events", "orders"):
        sql = sql.replace(f"FROM {table}", f"FROM '{path}/{table}.parquet/*.parquet'")
    return difference(registry.QUERIES[name](spark, path), sql, path + "/none")


def test_window_means_of_larger_tables(spark, larger):
    assert larger_difference(spark, "chg02_window_means", larger) == ""


def test_page_hinkley_of_larger_tables(spark, larger):
    assert larger_difference(spark, "chg01_page_hinkley", larger) == ""


def test_even_sample_of_larger_tables(spark, larger):
    assert larger_difference(spark, "smp04_even_sample", larger) == ""


def test_even_positions_are_whole_quotients():
    for rows in range(300):
        for target in (0, 1, 2, 7, 100):
            n = min(rows, target)
            assert sampling.even_positions(rows, target) == ([0] if n == 1 else [k * (rows - 1) // (n - 1) for k in range(n)])


def test_row_numbers_do_not_depend_on_ranges(spark, monkeypatch):
    rng = random.Random(3)
    texts, start = [None, "", "a", "b", "Zoë"], datetime(2024, 10, 27)
    rows = [(rng.choice(texts), rng.choice([None, float("nan"), float("-inf"), -0.5, 3.0]), start + timedelta(minutes=rng.randrange(300)), bytes([rng.randrange(3), 200]), [k % 7], k) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "t string, x double, at timestamp, b binary, l array<int>, id long").repartition(7)
    for order in (["t", "x", "at", "id"], ["x", "id"], ["at", "b", "l", "id"], ["l", "id"], ["id"]):
        want = [r.id for r in df.coalesce(1).sortWithinPartitions(*order).select("id").collect()]
        for zone in ("UTC", "Europe/Berlin") if order[0] == "at" else ("UTC",):
            monkeypatch.setattr(sampling, "RANGE_ROWS", 150)
            spark.conf.set("spark.sql.session.timeZone", zone)
            try:
                found = {r.row_number: r.id for r in sampling.with_row_number(df, order).collect()}
            finally:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            assert [found.get(k) for k in range(len(rows))] == want, order
    assert sampling.with_row_number(df.limit(0), ["id"]).count() == 0
