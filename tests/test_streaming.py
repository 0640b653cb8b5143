from pyspark.sql import functions as F

from tidewatch.operators import profile
from tidewatch.streaming import monitor

SF = "/root/testdata/sf0.001"


def test_stream_profile_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitor.stream_profile(stream, ["value"], str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = monitor.read_profile(spark, str(tmp_path / "out")).first(), profile.numeric_summary(events, ["value"], digits=6).first()
    assert got["count"] == want["count"] and all(abs(got[k] - want[k]) < 1e-5 for k in ("mean", "std", "min", "max", "skewness", "kurtosis"))


def test_event_time_windows_and_shift_state(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = monitor.window_profile(stream, "ts", "value", width="1 day").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()
    q = monitor.shift_detector(stream, "event_type", "ts", "value").writeStream.outputMode("update").format("memory").queryName("shifts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("shifts").agg(F.sum("updates")).first()[0] == events.count()
