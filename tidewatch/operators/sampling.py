"""Deterministic samples, splits and projections."""

from __future__ import annotations

from itertools import takewhile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in a range of row numbers, the most ranges, and the rows drawn for a cut between them.
RANGE_ROWS, RANGES, DRAWN = 100_000, 10_000, 100
SEED = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def stratified_positions(rows: int, target: int, seed: int = SEED) -> list[int]:
    """`target` ascending row numbers, one at a hashed place in each of as many equal strata; the first and last row are in."""
    target = min(rows, target)
    if target <= 0:
        return []
    if target == rows:
        return list(range(rows))
    if target == 1:
        return [rows // 2]
    edges = [k * rows // target for k in range(target + 1)]
    found = [lo + _mixed(k + seed & _MASK) % max(1, hi - lo) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    found[0], found[-1] = 0, rows - 1
    return found


def even_positions(rows: int, target: int) -> list[int]:
    """min(rows, target) row numbers from the first to the last row at equal steps, rounded down in whole numbers."""
    n = min(rows, target)
    return [k * (rows - 1) // max(1, n - 1) for k in range(n)]


def _with_range(df: DataFrame, order: list[str], rows: int, out: str) -> DataFrame:
    """df with the number of a row's range of about RANGE_ROWS rows in the given order: a function of its values alone.

    Cuts come from a random draw and only set the sizes. They are literals over the leading columns of plain types, found
    by binary search: of the first column as a double where that decides, else of all of these columns. Rows that agree
    in all of them are in one range.
    """
    from .ranks import with_range

    kinds = [(F.col(o), df.select(o).schema[0].dataType) for o in order]
    leading = list(takewhile(lambda t: not isinstance(t[1], (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.UserDefinedType)), kinds))
    parts = min(RANGES, -(-rows // RANGE_ROWS))
    if parts <= 1 or not leading:
        return df.withColumn(out, F.lit(0))
    key = F.struct(*[c.alias(f"_{k}") for k, (c, _) in enumerate(leading)])
    drawn = df.select(key.alias("_key")).sample(min(1.0, parts * DRAWN / rows), SEED & 0xFFFF).agg(F.sort_array(F.collect_list("_key")).alias("_keys"))
    places = F.sequence(F.lit(1), F.lit(parts - 1))
    found = drawn.select(F.explode(F.transform(places, lambda k: F.get("_keys", F.floor(k * F.size("_keys") / parts).cast("int")))).alias("_key")).where("_key is not null").distinct()
    # a value's text is read back as the value, or near it, and needs no Python type
    text = lambda c, kind: c if isinstance(kind, T.BinaryType) else c.cast("string")
    values = found.select(*[text(F.col(f"_key._{k}"), kind) for k, (_, kind) in enumerate(leading)]).collect()
    if not values:
        return df.withColumn(out, F.lit(0))
    literals = [F.struct(*[F.lit(v).cast(kind).alias(f"_{k}") for k, (v, (_, kind)) in enumerate(zip(row, leading, strict=True))]) for row in values]
    cuts = F.sort_array(F.array(*literals))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(values).bit_length()))])
    search = F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step <= len(values)) & (F.get(cuts, lo + step - 1) <= key), lo + step).otherwise(lo))
    first, kind = leading[0]
    if not isinstance(kind, (T.NumericType, T.TimestampType)):
        return df.withColumn(out, search)

    # as a double the first column keeps its order, though not all differences: rows equal to a cut's are searched in full
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))
    firsts = df.sparkSession.range(1).select(F.transform(cuts, lambda c: c["_0"].cast("double")).alias("f")).first()["f"]
    least = sum(x is None or x == float("-inf") for x in firsts)
    marks = sorted({x + 0.0 for x in firsts if x is not None and abs(x) < float("inf")})
    upto = F.array(*[F.lit(least + sum(x is not None and float("-inf") < x <= m for x in firsts)) for m in [float("-inf"), *marks]])
    x = first.cast("double")
    held = with_range(df.withColumn("_lead", F.when(finite(x) & (x != 0), x).otherwise(0.0)), "_lead", marks, "_slot")
    equal = F.coalesce(F.get(F.array(*[F.lit(m) for m in marks]), F.col("_slot") - 1) == F.col("_lead"), F.lit(False)) if marks else F.lit(False)
    return held.withColumn(out, F.when(finite(x) & ~equal, F.get(upto, F.col("_slot"))).otherwise(search)).drop("_lead", "_slot")


def with_row_number(df: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """Zero-based positions in the order of the given columns, without a global window.

    Rows are dealt to ranges, numbered inside each range, and shifted by the sizes of the ranges before it. A row's range
    follows from its values and fixed cuts, so sizes and numbers, which are found by two scans, rest on the same ranges.
    """
    ranged = _with_range(df, order, df.count(), "_part")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    counts = [(r["_part"], r["count"]) for r in ranged.groupBy("_part").count().orderBy("_part").collect()]
    shifts, total = [], 0
    for part, n in counts:
        shifts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    return ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_local") + F.col("_shift")).cast("long")).drop("_part", "_local", "_shift")


def sample_rows(df: DataFrame, order: list[str], target: int, how: str = "stratified") -> DataFrame:
    """At most `target` rows at deterministic positions in the given order: a semi-join on a list of `target` numbers."""
    rows = df.count()
    if rows <= target:
        return df
    positions = stratified_positions(rows, target) if how == "stratified" else even_positions(rows, target)
    chosen = df.sparkSession.createDataFrame([(p,) for p in positions], "row_number long")
    return with_row_number(df, order).join(F.broadcast(chosen), "row_number", "left_semi").drop("row_number")


def split_by_date(df: DataFrame, date_column: str, ratio: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(older, newer): the first int(n * ratio) of the n rows with a date, in its order, and the rest.

    Only rows of the one timestamp at the cut are ordered further, by a hash of the row; rows without a date are in neither.
    """
    from .ranks import exact_quantiles

    dated = df.withColumn("_ts", F.unix_micros(F.expr(f"try_to_timestamp(cast(`{date_column}` as string))"))).where("_ts is not null")
    rows = dated.count()
    cut = int(rows * ratio)
    if min(cut, rows - cut) < 10:
        raise ValueError("fewer than 10 dated rows on a side")
    # microseconds of this millennium and the next are exact as doubles
    edge = int(exact_quantiles(dated, [F.col("_ts").cast("double")], [cut / max(1, rows - 1)])[0]["quantiles"][0])
    before = dated.where(F.col("_ts") < edge).count()
    if not before <= cut < before + dated.where(F.col("_ts") == edge).count():
        edge = int(dated.where(F.col("_ts") > edge).agg(F.min("_ts")).first()[0])
        before = dated.where(F.col("_ts") < edge).count()
    tied = dated.where(F.col("_ts") == edge).withColumn("_at", F.row_number().over(Window.partitionBy("_ts").orderBy(F.xxhash64(*[F.col(f"`{n}`") for n in df.columns]))))
    older = dated.where(F.col("_ts") < edge).drop("_ts").unionByName(tied.where(F.col("_at") <= cut - before).drop("_ts", "_at"))
    newer = dated.where(F.col("_ts") > edge).drop("_ts").unionByName(tied.where(F.col("_at") > cut - before).drop("_ts", "_at"))
    return older, newer


def even_columns(names: list[str], target: int, keep: str | None = None) -> list[str]:
    """Evenly spaced names; `keep` is always among them."""
    if len(names) <= target:
        return list(names)
    picked = [names[k * (len(names) - 1) // max(1, target - 1)] for k in range(target)]
    if keep and keep in names and keep not in picked:
        picked[-1] = keep
    return [n for n in names if n in set(picked)]
