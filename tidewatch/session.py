"""A local session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session: UTC, adaptive execution, and case-sensitive column names, as the profile tells `A` from `a`."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.caseSensitive", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
