"""Exact top-k by inner product over an impact-ordered index."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Vectors in an index block, queries served in one visit, and impact levels of a dimension.
BLOCK, QUERIES, LEVELS = 16_384, 2_048, 8


class ImpactIndex:
    """Posting segments of distinct integer vectors: for each dimension, positions by falling quantised value.

    An index holds at most BLOCK rows. Equal vectors share postings and keep their ids sorted; among them only the k + 1
    smallest ids can enter a list of k, as all others lose the tie.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, owner = np.unique(vectors, axis=0, return_inverse=True)
        by_owner = np.argsort(owner.ravel(), kind="stable")
        self.ids, bounds = ids[by_owner], np.searchsorted(owner.ravel()[by_owner], np.arange(len(self.vectors) + 1))
        self.bounds = bounds
        n, dims = self.vectors.shape
        self.size = n
        cuts = sorted({round(n * k / levels) for k in range(levels + 1)})
        self.spans = list(zip(cuts, cuts[1:], strict=False))
        self.postings = np.argsort(-self.vectors, axis=0, kind="stable").T.copy()
        ranked = np.take_along_axis(self.vectors.T, self.postings, axis=1)
        self.top = np.array([[ranked[d, a] for a, _ in self.spans] for d in range(dims)])
        self.low = np.array([[ranked[d, b - 1] for _, b in self.spans] for d in range(dims)])

    def search(self, query: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) with id other than `own`, of equal scores the smaller ids.

        A segment's impact is the most that it adds to a score, taken above the least that its dimension can give, so
        impacts are never negative. Segments are read by falling impact, adding each segment's floor to its members. The sum
        of the largest unread impacts bounds what any vector can still gain; a vector whose sum, with that bound and the
        floors' error, is below the k-th best sum is proven out. Reading stops once few enough are possible, or at the end;
        all possible ones are scored exactly.
        """
        weighed_top = np.where(query[:, None] >= 0, query[:, None] * self.top, query[:, None] * self.low)
        weighed_low = np.where(query[:, None] >= 0, query[:, None] * self.low, query[:, None] * self.top)
        base = weighed_low.min(axis=1, keepdims=True)
        most, floor = weighed_top - base, weighed_low - base
        dims, count = most.shape
        order = np.argsort(-most, axis=None, kind="stable")
        left = most.max(axis=1)
        rank = np.argsort(-most, axis=1, kind="stable")
        done = np.zeros(dims, np.int64)
        sums, slack = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        want = min(k + 1, self.size)
        possible = np.arange(self.size)
        goal = max(4 * want, self.size // 64)
        every = max(dims, 1)
        for step, at in enumerate(order.tolist(), 1):
            d, s = divmod(at, count)
            a, b = self.spans[s]
            members = self.postings[d, a:b]
            sums[members] += floor[d, s]
            slack[members] += most[d, s] - floor[d, s]
            done[d] += 1
            left[d] = most[d, rank[d, done[d]]] if done[d] < count else 0
            if step % every == 0:
                sure = np.partition(sums, self.size - want)[self.size - want]
                possible = np.flatnonzero(sums + slack + left.sum() >= sure)
                if len(possible) <= goal:
                    break
        exact = self.vectors[possible] @ query
        best = np.argsort(-exact, kind="stable")
        found: list[tuple[int, int]] = []
        for p in best.tolist():
            if len(found) >= k and exact[p] < found[k - 1][0]:
                break
            ids = self.ids[self.bounds[possible[p]] : self.bounds[possible[p] + 1]][: k + 1]
            found += [(int(exact[p]), int(x)) for x in ids.tolist() if x != own]
            found.sort(key=lambda r: (-r[0], r[1]))
            del found[k:]
        return found


def _serve(key, candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    names = ["query_id", "vec_id", "score"]
    if not len(candidates) or not len(queries):
        return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
    dims = candidates["vector"].map(len).to_numpy()
    out = []
    for width in np.unique(dims).tolist():
        mine = candidates[dims == width]
        index = ImpactIndex(mine["vec_id"].to_numpy(np.int64), np.array(mine["vector"].tolist(), np.int64).reshape(len(mine), width))
        for q, v in zip(queries["query_id"].tolist(), queries["vector"].tolist(), strict=True):
            if len(v) == width:
                out += [(q, i, s) for s, i in index.search(np.array(v, np.int64), q, k)]
    return pd.DataFrame(out, columns=names).astype(np.int64)


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as double; null if the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return F.when(embedding.isNotNull() & ~bad, whole)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k largest inner products over all vectors but its own.

    vectors (vec_id, vector) and queries (query_id, vector) hold arrays of long; null ids and null or empty vectors take no part,
    vectors of another length than the query's are no candidates. Ties go to the smaller id; a query with fewer candidates
    gets all; repeated rows count as often as they occur among
    candidates; a query id with several vectors is asked with the smallest. Empty tables give no rows.

    Vectors are dealt by a hash into blocks of about `block` rows, queries into blocks of QUERIES; each pair of blocks
    is one task that builds the block's index and serves its queries, and k rows a query and block are merged.
    """
    vectors = cut(vectors.select("vec_id", "vector").where("vec_id is not null and size(vector) > 0"), "vectors")
    queries = queries.where("query_id is not null and size(vector) > 0")
    queries = cut(queries.groupBy("query_id").agg(F.min("vector").alias("vector")), "queries")
    n, q = (x.agg(F.count(F.lit(1))).first()[0] for x in (vectors, queries))
    blocks, groups = max(1, -(-n // block)), max(1, -(-q // QUERIES))
    left = vectors.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    right = queries.withColumn("g", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    served = (
        left.groupBy("b", "g")
        .cogroup(right.groupBy("b", "g"))
        .applyInPandas(partial(_serve, k=k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return served.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
