"""Token-budget batches inside length buckets of least padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import gapless
from .scratch import cut

#: A piece is a run of letters, up to three digits, or a run of other marks.
PIECES = r"\p{L}+|\p{N}{1,3}|[^ \t\n\r\f\x0B\p{L}\p{N}]+"


def bucket_edges(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most `buckets` upper edges, each a length that occurs, for which the padding of all rows up to their edge is least.

    Dynamic programming over the sorted distinct lengths: best[k][j] is the least padding of the j shortest lengths in k
    buckets. Of equal sums the fewest buckets, then the smaller edges win.
    """
    lengths = np.array(sorted(x for x, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    rows = np.append(0, np.cumsum(counts))
    mass = np.append(0, np.cumsum(counts * lengths))
    n, big = len(lengths), np.iinfo(np.int64).max
    best, backs = np.full(n + 1, big), []
    best[0] = 0
    finished = []
    for _ in range(min(buckets, n)):
        now, back = np.full(n + 1, big), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            ready = best[:j] < big
            cost = np.where(ready, np.where(ready, best[:j], 0) + lengths[j - 1] * (rows[j] - rows[:j]) - (mass[j] - mass[:j]), big)
            back[j] = int(np.argmin(cost))
            now[j] = cost[back[j]]
        best = now
        backs.append(back)
        finished.append(int(now[n]))
    k = int(np.argmin(finished))
    edges, j = [], n
    while k >= 0:
        edges.append(int(lengths[j - 1]))
        j, k = int(backs[k][j]), k - 1
    return edges[::-1]


def pack_documents(
    docs: DataFrame, max_tokens: int = 2048, buckets: int = 8, batch_tokens: int = 65_536, length: Column | None = None
) -> DataFrame:
    """(doc_id, segment, first_token, n_tokens, bucket, padded_to, batch, slot) for docs (doc_id, text, ...).

    A document of more than max_tokens tokens is cut into segments of max_tokens and a rest; one without tokens (null and
    empty texts too) has one segment of length 0. The histogram of segment lengths, at most max_tokens + 1 rows however
    large the input, goes to the driver, where dynamic programming picks the bucket edges of least padding. Inside a
    bucket, batches hold batch_tokens // padded_to segments (one at least); batch counts from 0 in each bucket without
    gaps, slot from 0 in each batch, only a bucket's last batch may be short. length: tokens of a row; by default the
    pieces of PIECES in its text. Null ids and repeated rows keep their segments; other columns are ignored.
    """
    tokens = F.coalesce(length if length is not None else F.regexp_count("text", F.lit(PIECES)), F.lit(0)).cast("long")
    extra = F.greatest(F.ceil(F.col("_n") / max_tokens) - 1, F.lit(0)).cast("long")
    pieces = (
        docs.select("doc_id", tokens.alias("_n"))
        .select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), extra)).alias("segment"))
        .select(
            "doc_id",
            "segment",
            (F.col("segment") * max_tokens).alias("first_token"),
            F.least(F.col("_n") - F.col("segment") * max_tokens, F.lit(max_tokens)).cast("int").alias("n_tokens"),
        )
    )
    pieces = cut(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").count().collect()}
    edges = bucket_edges(histogram, buckets)
    if not edges:
        edges = [0]
    bucket = F.lit(len(edges) - 1)
    padded = F.lit(edges[-1])
    for k in range(len(edges) - 2, -1, -1):
        inside = F.col("n_tokens") <= edges[k]
        bucket, padded = F.when(inside, k).otherwise(bucket), F.when(inside, edges[k]).otherwise(padded)
    placed = pieces.withColumn("bucket", bucket).withColumn("padded_to", padded)
    numbered = gapless(placed, ["bucket"], ["doc_id", "segment", "n_tokens"], "_at", sum(histogram.values()))
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.lit(1), F.col("padded_to")))).cast("long")
    return numbered.withColumns({"batch": F.floor(F.col("_at") / room).cast("long"), "slot": (F.col("_at") % room).cast("int")}).drop("_at")
