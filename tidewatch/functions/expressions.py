"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns whose aggregates share one pass; more would overflow a generated method.
PASS_COLUMNS = 40


def is_fractional(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a fractional column."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if is_fractional(df.schema[name].dataType) else c.isNull()


def finite(df: DataFrame, name: str) -> Column:
    """The value as double; null if it is missing or infinite. Decimals count as numbers."""
    if not is_fractional(df.schema[name].dataType):
        return F.col(f"`{name}`").cast("double")
    # one expression a column, as wide tables have many
    return F.expr(f"CASE WHEN abs(CAST(`{name}` AS DOUBLE)) < DOUBLE('Infinity') THEN CAST(`{name}` AS DOUBLE) END")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType, T.BinaryType))]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType))]


def family(kind: T.DataType) -> str:
    """boolean, datetime, integer, number or string, the catch-all."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.IntegralType):
        return "integer"
    return "number" if isinstance(kind, T.NumericType) else "string"


def unpivot(df: DataFrame, names: list[str], value: str = "value", as_text: bool = True) -> DataFrame:
    """(column, value) rows of the named columns, in one scan."""
    cells = [
        F.struct(F.lit(n).alias("column"), (F.col(f"`{n}`").cast("string") if as_text else finite(df, n)).alias(value)) for n in names
    ]
    return df.select(F.inline(F.array(*cells)))


def corrected_skewness(x: Column) -> Column:
    """Bias-corrected G1; null below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def corrected_kurtosis(x: Column) -> Column:
    """Bias-corrected excess G2; null below four values or without spread."""
    n = F.count(x).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n >= 4) & (F.var_pop(x) > 0), scale * ((n + 1) * F.kurtosis(x) + 6))


def chunks(names: list[str], size: int = PASS_COLUMNS) -> list[list[str]]:
    return [names[k : k + size] for k in range(0, len(names), size)]


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step whose bound x reaches; steps fall."""
    out = F.lit(otherwise)
    for bound, label in reversed(steps):
        out = F.when(x >= bound, label).otherwise(out)
    return out
