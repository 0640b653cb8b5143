"""Gapless numbers inside groups that may each hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SALT = 20_000


def salts_for(rows: int) -> int:
    """So many salts that one holds about ROWS_PER_SALT rows at any input size."""
    return max(1, -(-rows // ROWS_PER_SALT))


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """df with `out`, a long from 0 without gaps in each group; group columns hold no null.

    Each group is cut by a hash of the order columns into salts of bounded size. Rows are numbered inside a salt and
    shifted by the counts of the salts before it, so no task sees a whole group. The salt depends on a row's place in its
    file too, so that rows equal in all order columns spread as well; they are numbered in any order. df is read twice
    and must stem from a written table alone, as cut() gives it.
    """
    place = F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / ROWS_PER_SALT)
    salted = df.select("*", F.pmod(F.xxhash64(*order, *place), F.lit(salts_for(rows))).alias("_salt"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        salted.groupBy(*group, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))
    return (
        salted.withColumn("_row", inside)
        .join(shift, [*group, "_salt"])
        .withColumn(out, (F.col("_shift") + F.col("_row") - 1).cast("long"))
        .drop("_salt", "_row", "_shift")
    )
