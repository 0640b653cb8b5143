"""Relations between columns."""

from __future__ import annotations

import math
from decimal import Decimal
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import special as S
from . import ranks
from .ranks import cumulative


#: Strips of either column in which pairs of rows are compared.
STRIPS = 2_000


def strength(r: Column) -> Column:
    return X.ladder(F.abs(r), [(0.8, "very_strong"), (0.6, "strong"), (0.4, "moderate"), (0.2, "weak")], "negligible")


def average_ranks(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, rank): the average rank of each distinct value of rows that count `weight` times."""
    upto = cumulative(df.select(value, weight), value, {"_n": F.sum(weight)})
    return upto.select(value, (F.col("upto__n") - (F.col("_n") - 1) / 2).alias("rank"))


def pair_counts(df: DataFrame, left: str, right: str) -> DataFrame:
    """(x, y, n): distinct pairs of finite values."""
    both = df.select(X.finite(df, left).alias("x"), X.finite(df, right).alias("y")).where("x is not null and y is not null")
    return both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, left: str, right: str) -> DataFrame:
    """(n, spearman) over rows where both are finite; ranks are joined to distinct pairs, not to rows."""
    pairs = pair_counts(df, left, right)
    rx, ry = (average_ranks(pairs, c, "n").withColumnRenamed("rank", f"r{c}") for c in ("x", "y"))
    n, a, b = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    # both mean ranks are (N + 1) / 2, so that sums of centred products need no second pass
    total = pairs.agg(F.sum("n")).first()[0]
    if not total:
        return df.sparkSession.createDataFrame([(0, None)], "n long, spearman double")
    a, b = a - (total + 1) / 2, b - (total + 1) / 2
    r = F.sum(n * a * b) / F.nullif(F.sqrt(F.sum(n * a * a) * F.sum(n * b * b)), F.lit(0.0))
    return pairs.join(rx, "x").join(ry, "y").agg(F.sum("n").alias("n"), F.round(r, 6).alias("spearman"))


def correlation_p(r: float, n: int) -> float:
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    return 2 * S.t_sf(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def kendall(df: DataFrame, left: str, right: str) -> DataFrame:
    """(n, tau_b) over all rows where both are finite, exact at every size."""
    pairs = pair_counts(df, left, right).persist()
    couples = lambda n: F.sum(n.cast("decimal(38,0)") * (n - 1) / 2)
    tied = lambda *c: int(pairs.groupBy(*c).agg(F.sum("n").alias("t")).agg(couples(F.col("t"))).first()[0] or 0)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    whole, same_x, same_y, same = total * (total - 1) // 2, tied("x"), tied("y"), tied("x", "y")
    # of all pairs of rows without a tie, those that are not discordant are concordant
    score = whole - same_x - same_y + same - 2 * _discordant(pairs)
    pairs.unpersist()
    scale = math.sqrt(whole - same_x) * math.sqrt(whole - same_y)
    return df.sparkSession.createDataFrame([(total, score / scale if scale else None)], "n long, tau_b double")


def inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """The sum of n_i n_j over x_i < x_j and y_i > y_j: at each level of a merge, left halves against right halves."""
    order = np.lexsort((y, x))
    rank, n = np.unique(y[order], return_inverse=True)[1].astype(np.int64), n[order].astype(np.int64)
    at, width, total, size = np.arange(len(n)), 1, 0, len(n)
    fits = int(n.sum()) < 1 << 31
    while width < size:
        block, side = at // (2 * width), at // width % 2
        by = np.argsort((block * size + rank) * 2 + side, kind="stable")
        block, side, weight = block[by], side[by], n[by]
        run = np.cumsum(np.where(side == 0, weight, 0))
        ends = run[np.searchsorted(block, np.arange(block[-1] + 1), "right") - 1]
        above, late = (ends[block] - run)[side == 1], weight[side == 1]
        total += int(above @ late) if fits else sum(a * b for a, b in zip(above.tolist(), late.tolist(), strict=True))
        width *= 2
    return total


def _strips(pairs: DataFrame, column: str, rows: int) -> tuple[list[float], list[int]]:
    """Cuts that leave about RANGE_ROWS pairs in a strip, and the strips of one hot value alone."""
    parts = min(STRIPS, -(-rows // ranks.RANGE_ROWS))
    if parts <= 1:
        return [], []
    marks = pairs.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    hot = {a for a, b in zip(marks, marks[1:], strict=False) if a == b}
    cuts = sorted(set(marks) | {math.nextafter(h, math.inf) for h in hot})
    return cuts, [cuts.index(h) + 1 for h in sorted(hot)]


def _discordant(pairs: DataFrame) -> int:
    """The number of row pairs with rising x and falling y, over distinct (x, y, n).

    x and y are cut into at most STRIPS strips each. Pairs of rows that share neither strip follow from the grid of strip
    counts, of at most STRIPS squared cells; those that share an x strip are counted in its task, and those that share
    only a y strip in that strip's task, by merging. A hot value has a strip of its own, which holds no such pair.
    """
    rows = pairs.count()
    (cx, hot_x), (cy, hot_y) = _strips(pairs, "x", rows), _strips(pairs, "y", rows)
    spread = ranks.with_range(ranks.with_range(pairs, "x", cx, "_px"), "y", cy, "_py")

    def count(by: str, name: str):
        def one(part):
            import pandas as pd

            found = inversions(part[name].to_numpy(float), part["y"].to_numpy(float), part["n"].to_numpy())
            return pd.DataFrame({"c": [Decimal(found)]})

        return lambda frame: int(frame.groupBy(by).applyInPandas(one, "c decimal(38,0)").agg(F.sum("c")).first()[0] or 0)

    total = count("_px", "x")(spread.where(~F.col("_px").isin(hot_x)))
    if cx:
        flat = spread.groupBy("_py", "_px", "y").agg(F.sum("n").alias("n"))
        total += count("_py", "_px")(flat.where(~F.col("_py").isin(hot_y)))
        grid = np.zeros((len(cx) + 1, len(cy) + 1), np.int64)
        for r in spread.groupBy("_px", "_py").agg(F.sum("n").alias("n")).collect():
            grid[r["_px"], r["_py"]] = r["n"]
        # rows of later x strips and earlier y strips
        below = np.zeros_like(grid)
        below[:-1, 1:] = np.cumsum(np.cumsum(grid[::-1], axis=0)[::-1][1:, :-1], axis=1)
        total += sum(a * b for a, b in zip(grid.ravel().tolist(), below.ravel().tolist(), strict=True))
    return total


def contingency(df: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b, n, row_total, column_total, total) of rows where both are given, marginals by windows over the small table."""
    cells = df.where(F.col(f"`{left}`").isNotNull() & F.col(f"`{right}`").isNotNull()).groupBy(F.col(f"`{left}`").cast("string").alias("a"), F.col(f"`{right}`").cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    return cells.select("a", "b", "n", over("a").alias("row_total"), over("b").alias("column_total"), over().alias("total"))


def chi_square(df: DataFrame, left: str, right: str, yates: bool = True) -> DataFrame:
    """(n, rows, columns, dof, chi2, cramers_v, p_value); with yates, 2 x 2 tables are corrected.

    Cells that never occur add their expectation, which is the total less the expectations of the cells that do.
    """
    cells = contingency(df, left, right)
    e = F.col("row_total") * F.col("column_total") / F.col("total")
    row = cells.agg(
        F.max("total").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"),
        F.sum((F.col("n") - e) ** 2 / e).alias("plain"), F.sum(e).alias("seen"), F.sum(F.greatest(F.abs(F.col("n") - e) - F.least(F.abs(F.col("n") - e), F.lit(0.5)), F.lit(0.0)) ** 2 / e).alias("damped"),
    ).first()
    out = "n long, rows long, columns long, dof long, chi2 double, cramers_v double, p_value double"
    if not row["n"]:
        return df.sparkSession.createDataFrame([(0, 0, 0, 0, None, None, None)], out)
    dof = (row["r"] - 1) * (row["c"] - 1)
    chi2 = row["damped"] if yates and dof == 1 else row["plain"]
    chi2 += max(0.0, row["n"] - row["seen"])
    k = min(row["r"], row["c"]) - 1
    v = math.sqrt(chi2 / (row["n"] * k)) if k else None
    p = S.chi2_sf(chi2, dof) if dof else None
    return df.sparkSession.createDataFrame([(row["n"], row["r"], row["c"], dof, round(chi2, 4), v and round(v, 6), p)], out)


def point_biserial(df: DataFrame, level: str, high: object, numeric: str) -> DataFrame:
    """(n, correlation) of a two-level column, counted as 1 where it equals `high`, with a number."""
    x = X.finite(df, numeric)
    y = F.when(F.col(f"`{level}`").isNotNull(), (F.col(f"`{level}`") == F.lit(high)).cast("double"))
    both = x.isNotNull() & y.isNotNull()
    return df.agg(F.count(F.when(both, 1)).alias("n"), F.round(F.corr(F.when(both, y), F.when(both, x)), 6).alias("correlation"))


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, n, rank_sum, ties, total): rank sums of each group, and the sum of t^3 - t over tied values."""
    both = df.select(F.col(f"`{group}`").cast("string").alias("g"), X.finite(df, value).alias("x")).where("g is not null and x is not null")
    cells = both.groupBy("x", "g").agg(F.count(F.lit(1)).alias("k"))
    per = cumulative(both, "x", {"t": F.count(F.lit(1))})
    mid = F.col("upto_t") - (F.col("t") - 1) / 2
    ranked = cells.join(per.select("x", mid.alias("rank")), "x")
    ties = per.agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"), F.sum("t").alias("total"))
    return ranked.groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("k")).alias("rank_sum")).crossJoin(F.broadcast(ties))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, n, h, epsilon_squared) with tie correction."""
    total = F.max("total").cast("double")
    raw = 12 / (total * (total + 1)) * F.sum(F.col("rank_sum") ** 2 / F.col("n")) - 3 * (total + 1)
    h = raw / F.nullif(1 - F.max("ties") / (total**3 - total), F.lit(0.0))
    return rank_sums(df, group, value).agg(F.count(F.lit(1)).alias("groups"), F.max("total").alias("n"), F.round(h, 4).alias("h"), F.round(h / (total - 1), 6).alias("epsilon_squared"))


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """(u, n1, n2, rank_biserial) of the first of two groups in the order of their names."""
    order = F.row_number().over(Window.orderBy("g"))
    pair = rank_sums(df, group, value).withColumn("k", order)
    n1, n2 = F.max(F.when(F.col("k") == 1, F.col("n"))), F.max(F.when(F.col("k") == 2, F.col("n")))
    u = F.max(F.when(F.col("k") == 1, F.col("rank_sum"))) - n1 * (n1 + 1) / 2
    return pair.agg(F.round(u, 2).alias("u"), n1.alias("n1"), n2.alias("n2"), F.round(2 * u / (n1 * n2) - 1, 6).alias("rank_biserial"))


def correlation_ratio(df: DataFrame, group: str, value: str) -> DataFrame:
    """(eta): the root of the between-group share of the sum of squares."""
    both = df.select(F.col(f"`{group}`").alias("g"), X.finite(df, value).alias("x")).where("g is not null and x is not null")
    per = both.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") ** 2) - F.sum("n") * mean**2
    within = F.sum(F.col("n") * F.col("v"))
    return per.agg(F.round(F.sqrt(between / (between + within)), 6).alias("eta"))


def correlation_matrix(df: DataFrame, names: list[str]) -> np.ndarray:
    """Pearson matrix over rows complete in all names, from one pass of sums of products."""
    complete = X.finite(df, names[0]).isNotNull()
    for n in names[1:]:
        complete = complete & X.finite(df, n).isNotNull()
    pairs = list(combinations(range(len(names)), 2))
    row = df.where(complete).agg(*[F.corr(X.finite(df, names[i]), X.finite(df, names[j])) for i, j in pairs]).first()
    out = np.eye(len(names))
    for (i, j), r in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = r if r is not None else 0.0
    return out


def variance_inflation(df: DataFrame, names: list[str], most: float = 999.0) -> DataFrame:
    """(column, vif, level): the diagonal of the inverse correlation matrix; 10 is high, 5 moderate."""
    inverse = np.diag(np.linalg.pinv(correlation_matrix(df, names)))
    rows = [(n, round(min(most, max(1.0, float(v))), 4)) for n, v in zip(names, inverse, strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, vif double").withColumn("level", X.ladder(F.col("vif"), [(10, "high"), (5, "moderate")], "low"))


def redundant_groups(df: DataFrame, names: list[str], least: float = 0.95) -> list[list[str]]:
    """Greedy groups of columns that correlate with their first member at least so strongly."""
    matrix, taken, out = np.abs(correlation_matrix(df, names)), set(), []
    for i, n in enumerate(names):
        if i in taken:
            continue
        group = [j for j in range(i + 1, len(names)) if j not in taken and matrix[i, j] >= least]
        if group:
            taken |= {i, *group}
            out.append([n, *(names[j] for j in group)])
    return out


def relationship_graph(df: DataFrame, names: list[str], order: list[str], least: float = 0.8, most_rows: int = 512, planes: int = 64, band: int = 16, seed: int = 11) -> dict:
    """Edges of strongly correlated columns and their components.

    Up to 100 columns all pairs are computed exactly. Wider tables take a bounded sample: sign patterns of standardised
    columns under random hyperplanes are cut into bands, a band and its complement meet in one bucket, and pairs that
    share a bucket are verified.
    """
    from .profile import correlations
    from .sampling import sample_rows

    if len(names) <= 100:
        edges = [(r["left"], r["right"], r["correlation"]) for r in correlations(df, names, 6).collect() if r["correlation"] is not None and abs(r["correlation"]) >= least]
    else:
        rows = sample_rows(df.select(*names, *[o for o in order if o not in names]), order, most_rows).select(*[X.finite(df, n) for n in names]).collect()
        x = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
        x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
        std = x.std(0)
        usable = np.flatnonzero(std > 0)
        z = (x[:, usable] - x[:, usable].mean(0)) / std[usable]
        bits = (np.random.default_rng(seed).normal(size=(planes, len(z))) @ z) > 0
        buckets: dict[tuple[int, bytes], list[int]] = {}
        for b in range(0, planes, band):
            part = bits[b : b + band]
            part = np.where(part[0], part, ~part)
            for k in range(part.shape[1]):
                buckets.setdefault((b, part[:, k].tobytes()), []).append(k)
        pairs = {(i, j) for own in buckets.values() for i, j in combinations(own, 2)}
        edges = []
        for i, j in sorted(pairs):
            r = float((z[:, i] * z[:, j]).mean())
            if abs(r) >= least:
                edges.append((names[usable[i]], names[usable[j]], round(r, 6)))
    up = {n: n for n in names}

    def root(n: str) -> str:
        while up[n] != n:
            n = up[n]
        return n

    for a, b, _ in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(root(n), []).append(n)
    return {"nodes": len(names), "edges": edges, "components": [g for g in groups.values() if len(g) > 1]}


def numeric_matrix(df: DataFrame, target: str | None = None, most: int = 30) -> list[str]:
    """The numeric columns for a matrix of all pairs: neither the target nor constants, at most `most`, the fullest first."""
    names = [n for n in X.numeric_columns(df) if n != target]
    if not names:
        return []
    row = df.agg(*[f(X.finite(df, n)) for n in names for f in (F.count, F.stddev_pop)]).first()
    kept = [(n, row[2 * k]) for k, n in enumerate(names) if row[2 * k + 1]]
    best = {n for n, _ in sorted(kept, key=lambda r: (-r[1], names.index(r[0])))[:most]}
    return [n for n in names if n in best]
