"""Any input as a Spark DataFrame with metadata."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

SUFFIXES = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "excel", ".xls": "excel"}
ENCODINGS = ("UTF-8", "ISO-8859-1")


@dataclass(frozen=True)
class Metadata:
    name: str
    kind: str
    format: str
    rows: int | None
    columns: int
    size_bytes: int | None
    materialized: bool
    supports_projection: bool = True
    supports_streaming: bool = True


@dataclass(frozen=True)
class Source:
    """A DataFrame and where it came from; `select` prunes columns before any read."""

    frame: DataFrame
    name: str
    kind: str
    format: str

    def inspect(self, count: bool = True) -> Metadata:
        size = int(self.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if self.kind == "path" else None
        return Metadata(self.name, self.kind, self.format, self.frame.count() if count else None, len(self.frame.columns), size, self.kind in ("pandas", "arrow"))

    def select(self, *names: str) -> Source:
        return Source(self.frame.select(*[f"`{n}`" for n in names]), self.name, self.kind, self.format)

    def head(self, rows: int = 5_000) -> DataFrame:
        return self.frame.limit(rows)


def check_path(spark: SparkSession, path: str) -> None:
    """FileNotFoundError if no file system that Spark knows has the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """A delimited text with inferred types; UTF-8 if every line is valid, else Latin-1, in which any byte is a character."""
    sep = sep or ("\t" if path.endswith(".tsv") else ",")
    from pyspark.sql import functions as F

    raw = spark.read.format("text").load(path).select(F.is_valid_utf8(F.col("value")).alias("ok"))
    encoding = ENCODINGS[0] if raw.where("not ok").isEmpty() else ENCODINGS[1]
    return spark.read.csv(path, header=header, inferSchema=True, sep=sep, encoding=encoding, mode="PERMISSIVE", multiLine=False)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """One sheet, read on the driver: spreadsheets are bounded by their format."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("Excel files need the optional package openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def read_path(spark: SparkSession, path: str) -> Source:
    kind = SUFFIXES.get(PurePosixPath(path).suffix.lower())
    check_path(spark, path)
    if kind is None:
        raise TypeError(f"unknown kind of file: {path}")
    read = {
        "csv": lambda: read_csv(spark, path),
        "parquet": lambda: spark.read.parquet(path),
        "orc": lambda: spark.read.orc(path),
        "json": lambda: spark.read.option("multiLine", True).json(path),
        "jsonl": lambda: spark.read.json(path),
        "excel": lambda: read_excel(spark, path),
    }[kind]
    return Source(read(), PurePosixPath(path).name, "path", kind)


def resolve_source(spark: SparkSession, data: object) -> Source:
    """A Source of a Spark or pandas frame, an Arrow table or stream, a DuckDB relation, a path, a table name or a Source."""
    import pandas as pd
    import pyarrow as pa

    if isinstance(data, Source):
        return data
    if isinstance(data, DataFrame):
        return Source(data, "dataframe", "spark", "spark")
    if isinstance(data, pd.DataFrame):
        if not len(data.columns):
            raise ValueError("an empty frame has no schema")
        return Source(spark.createDataFrame(data), "dataframe", "pandas", "pandas")
    if isinstance(data, (str, Path)):
        if isinstance(data, str) and not PurePosixPath(data).suffix and spark.catalog.tableExists(data):
            return Source(spark.table(data), data, "table", "table")
        return read_path(spark, str(data))
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if isinstance(data, pa.Table):
        return Source(spark.createDataFrame(data), "table", "arrow", "arrow")
    for method in ("to_arrow_table", "fetch_arrow_table"):  # a lazy relation of DuckDB
        if hasattr(data, method):
            return Source(spark.createDataFrame(getattr(data, method)()), "relation", "arrow", "duckdb")
    if hasattr(data, "__arrow_c_stream__"):
        return Source(spark.createDataFrame(pa.table(data)), "stream", "arrow", "arrow")
    raise TypeError(f"cannot read a {type(data).__name__}")


def inspect_source(spark: SparkSession, data: object) -> dict:
    return asdict(resolve_source(spark, data).inspect())


def safe_filename(name: str) -> str:
    """The last path component with unusual characters replaced."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name.replace("\\", "/").rsplit("/", 1)[-1]).lstrip(".") or "file"


def validate_upload(name: str, size: int, most: int = 100_000_000) -> None:
    if PurePosixPath(name).suffix.lower() not in SUFFIXES:
        raise ValueError(f"files of this kind are not accepted: {name}")
    if not 0 < size <= most:
        raise ValueError("the file is empty or too large")
