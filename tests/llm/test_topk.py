import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import topk


def plain(ids, vectors, queries, k):
    out = []
    for q, v in queries:
        found = sorted(((int(w @ v), i) for i, w in zip(ids, vectors, strict=True) if i != q), key=lambda r: (-r[0], r[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 1000])
def test_index_equals_brute_force(spread):
    rng = np.random.default_rng(spread)
    vectors = np.rint(rng.normal(0, spread, (700, 8))).astype(np.int64)
    vectors[200:500] = vectors[7]
    ids = rng.permutation(700)
    index = topk.ImpactIndex(ids, vectors)
    for at in range(0, 700, 23):
        q, v = int(ids[at]), vectors[at]
        assert [(q, r + 1, i, s) for r, (s, i) in enumerate(index.search(v, q, 10))] == plain(ids.tolist(), vectors, [(q, v)], 10)
    small = topk.ImpactIndex(np.array([1, 2]), np.array([[1, 2], [3, 4]]))
    assert small.search(np.array([1, 1]), 1, 10) == [(7, 2)]


def test_query_over_many_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 6)]) for k in range(900)]
    rows += [(1000, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (1400, [0.5, 0.5]), (1500, []), (55, rows[55][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    vectors = df.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    queries = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = sorted(map(tuple, topk.exact_top_k(vectors, queries, 10, block=100).collect()))
    good = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    assert found == plain([i for i, _ in good], [v for _, v in good], [(i, v) for i, v in good if i % 100 == 0], 10)
    assert topk.exact_top_k(vectors.limit(0), queries).count() == 0 == topk.exact_top_k(vectors, queries.limit(0)).count()
