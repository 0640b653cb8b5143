"""Exact order statistics and cumulative counts of which no task sees all values."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from math import floor

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries of a quantile sketch; its ranks are off by at most one part in so many.
ACCURACY = 10_000
#: Values that may come to the driver once the intervals around all wanted ranks are narrow.
SMALL = 100_000
#: Columns whose sketches share one aggregation; more groups would make it sort.
GROUPS = 100
#: Columns that one scan turns into rows; more would overflow a generated method.
PASS_COLUMNS = 40
#: Rows in a range of cumulative counts, and the most ranges.
RANGE_ROWS, RANGES = 1_000_000, 10_000


def cells(df: DataFrame, columns: list[Column], value: str = "x") -> DataFrame:
    """(k, value): the non-null values of all columns by number; PASS_COLUMNS columns share a scan, which reads only them."""
    out = None
    for lo in range(0, len(columns), PASS_COLUMNS):
        part = df.select(F.posexplode(F.array(*columns[lo : lo + PASS_COLUMNS])).alias("k", value))
        part = part.withColumn("k", F.col("k") + lo) if lo else part
        out = part if out is None else out.unionByName(part)
    return out.where(F.col(value).isNotNull())


def keyed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table made on the driver, by column number, to be joined to cells: one row a column or interval."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _marks(shares: list[float]) -> list[float]:
    near = 1.5 / ACCURACY
    return sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-near, near)})


def _select(at: DataFrame, sizes: list[int], wanted: list[set[int]], pivots: list[list[float]] | None) -> list[dict[int, float]]:
    """The values at the wanted ranks (from 0) of each number k of at (k, x), of which sizes are the numbers of values.

    Sketches propose pivots, one scan counts the values between them, and only the intervals that hold a wanted rank go
    on, each about 3 parts in ACCURACY of the values before; what is left at last comes to the driver.
    """
    spark = at.sparkSession
    if sum(sizes) <= SMALL:
        rows = at.groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("xs")).collect() if any(wanted) else []
        values = {row["k"]: row["xs"] for row in rows}
        return [{r: values[k][r] for r in ranks} for k, ranks in enumerate(wanted)]
    if pivots is None:
        shares = _marks([r / max(1, n - 1) for n, ranks in zip(sizes, wanted, strict=True) for r in ranks])
        found = {r["k"]: r["marks"] for r in at.groupBy("k").agg(F.percentile_approx("x", shares, ACCURACY).alias("marks")).collect()}
        pivots = []
        for k, (n, ranks) in enumerate(zip(sizes, wanted, strict=True)):
            near = {bisect_left(shares, m) for m in _marks([r / max(1, n - 1) for r in ranks])}
            pivots.append([found[k][i] for i in sorted(near)] if k in found else [])
    pivots = [sorted(set(p)) for p in pivots]
    counts: list[list[int]] = [[0] * (2 * len(p) + 1) for p in pivots]
    most = max(map(len, pivots))
    table = keyed(spark, [(k, *p, *[None] * (most - len(p))) for k, p in enumerate(pivots)], "k int" + "".join(f", p{i} double" for i in range(most)))
    # 2 i for values between the pivots i - 1 and i, 2 i + 1 for values equal to pivot i
    bucket = F.lit(0)
    for i in range(most):
        step = (F.col("x") >= F.col(f"p{i}")).cast("int") + (F.col("x") > F.col(f"p{i}")).cast("int")
        bucket = bucket + F.coalesce(step, F.lit(0))
    for row in at.join(table, "k").groupBy("k", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["k"]][row["b"]] = row["n"]
    out: list[dict[int, float]] = [{} for _ in sizes]
    inner: dict[tuple[int, int], set[int]] = {}
    before = [[0, *accumulate(c)] for c in counts]
    for k, ranks in enumerate(wanted):
        for r in ranks:
            b = bisect_right(before[k], r) - 1
            if b % 2:
                out[k][r] = pivots[k][b // 2]
            else:
                inner.setdefault((k, b), set()).add(r)
    if inner:
        keys = sorted(inner)
        ends = [(k, j, pivots[k][b // 2 - 1] if b else None, pivots[k][b // 2] if b < 2 * len(pivots[k]) else None) for j, (k, b) in enumerate(keys)]
        inside = F.coalesce(F.col("x") > F.col("lo"), F.lit(True)) & F.coalesce(F.col("x") < F.col("hi"), F.lit(True))
        part = at.join(keyed(spark, ends, "k int, j int, lo double, hi double"), "k").where(inside).select(F.col("j").alias("k"), "x")
        ranks = [{r - before[k][b] for r in inner[k, b]} for k, b in keys]
        for (k, b), values in zip(keys, _select(part, [counts[k][b] for k, b in keys], ranks, None), strict=True):
            out[k].update({r + before[k][b]: v for r, v in values.items()})
    return out


def exact_quantiles(df: DataFrame, columns: list[Column], probs: list[float], extras: list[Column] = ()) -> list[dict]:
    """For each column {"n", "quantiles", and the extras by their names}: quantiles interpolate between order statistics.

    The result is exact at every size: sketches only choose where to look. State is bounded, nothing is shuffled but
    sketches and counts, and a few scans do for 10^12 rows. extras are aggregates of a column `x` of the first scan.
    Columns without values have None as quantiles; values are finite doubles or null.
    """
    out: list[dict] = []
    for lo in range(0, len(columns), GROUPS):
        part = columns[lo : lo + GROUPS]
        at = cells(df, [c.cast("double") for c in part])
        first = at.groupBy("k").agg(F.count("x").alias("n"), F.percentile_approx("x", _marks(probs), ACCURACY).alias("marks"), *extras)
        rows = {r["k"]: r.asDict() for r in first.collect()}
        sizes = [rows[k]["n"] if k in rows else 0 for k in range(len(part))]
        wanted = [{min(n - 1, floor(p * (n - 1)) + d) for p in probs for d in (0, 1)} if n else set() for n in sizes]
        found = _select(at, sizes, wanted, [rows[k]["marks"] if k in rows else [] for k in range(len(part))])
        for k, n in enumerate(sizes):
            row = rows.get(k, {"n": 0}) | {"quantiles": None}
            if n:
                row["quantiles"] = []
                for p in probs:
                    at = p * (n - 1)
                    a, b = found[k][floor(at)], found[k][min(n - 1, floor(at) + 1)]
                    row["quantiles"].append(a + (b - a) * (at - floor(at)))
            row.pop("marks", None)
            out.append(row)
    return out


def ranges(df: DataFrame, value: str, rows: int | None = None) -> list[float]:
    """Inner cuts of `value` that leave about RANGE_ROWS rows in a range."""
    rows = df.select(F.count(value)).first()[0] if rows is None else rows
    parts = min(RANGES, -(-rows // RANGE_ROWS))
    if parts <= 1:
        return []
    found = df.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], max(ACCURACY, 10 * parts))).first()[0]
    return sorted(set(found))


def with_range(df: DataFrame, value: str, cuts: list[float], out: str = "_range") -> DataFrame:
    """df with the number of the range of the double column `value`: a function of the value alone, by binary search."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=value, outputCol=out)
    return split.transform(df).withColumn(out, F.col(out).cast("int"))


def cumulative(df: DataFrame, value: str, counts: dict[str, Column]) -> DataFrame:
    """(value, each count, upto_<count>, next): distinct non-null doubles with running sums, and the next larger value.

    counts are aggregates of the rows of a value, whose totals are added up. Values are dealt to ranges of about
    RANGE_ROWS rows, added up inside a range, and shifted by the totals of the ranges before it, of which there are at
    most RANGES: no window sees all values unless they are few.
    """
    df = df.where(F.col(value).isNotNull())
    cuts = ranges(df, value)
    freq = with_range(df.groupBy(value).agg(*[c.alias(n) for n, c in counts.items()]), value, cuts)
    inside = Window.partitionBy("_range").orderBy(value)
    local = freq.withColumns({f"upto_{n}": F.sum(n).over(inside) for n in counts} | {"next": F.lead(value).over(inside)})
    if not cuts:
        return local.drop("_range")
    across = Window.orderBy("_range")
    totals = with_range(df, value, cuts).groupBy("_range").agg(*[c.alias(n) for n, c in counts.items()], F.min(value).alias("_first"))
    shifts = totals.select(
        "_range", *[F.coalesce(F.sum(n).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_shift_{n}") for n in counts], F.lead("_first").over(across).alias("_after")
    )
    joined = local.join(F.broadcast(shifts), "_range")
    return joined.select(value, *counts, *[(F.col(f"upto_{n}") + F.col(f"_shift_{n}")).alias(f"upto_{n}") for n in counts], F.coalesce("next", "_after").alias("next"))


def places(df: DataFrame, value: str, facts: dict[str, Column]) -> DataFrame:
    """(place, each fact): the place of each distinct non-null double, from 1, and aggregates of its rows."""
    df = df.where(F.col(value).isNotNull())
    cuts = ranges(df, value)
    freq = with_range(df.groupBy(value).agg(*[c.alias(n) for n, c in facts.items()]), value, cuts)
    local = freq.withColumn("place", F.row_number().over(Window.partitionBy("_range").orderBy(value)).cast("long"))
    if not cuts:
        return local.select("place", *facts)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = freq.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(sizes), "_range").select((F.col("place") + F.col("_before")).alias("place"), *facts)
