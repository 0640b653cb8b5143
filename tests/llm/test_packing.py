import random
from collections import Counter
from itertools import combinations

from tidewatch.llm import packing


def padding(histogram, edges):
    return sum(n * (min(e for e in edges if e >= x) - x) for x, n in histogram.items())


def test_edges_have_least_padding():
    rng = random.Random(2)
    for _ in range(40):
        histogram = {x: rng.randint(1, 9) for x in rng.sample(range(30), rng.randint(1, 8))}
        k = rng.randint(1, 4)
        edges = packing.bucket_edges(histogram, k)
        top = max(histogram)
        best = min(padding(histogram, [*c, top]) for r in range(k) for c in combinations([x for x in histogram if x < top], min(r, len(histogram) - 1)))
        assert len(edges) <= k and edges[-1] == top and padding(histogram, edges) == best
    assert packing.bucket_edges({}, 3) == []


def test_segments_and_batches(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 250])))) for k in range(300)] + [(None, None), (7, "w w"), (7, "w w"), (400, "w " * 100_001)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int")
    out = packing.pack_documents(docs, max_tokens=100, buckets=3, batch_tokens=400).collect()
    want = Counter()
    for d, t in rows:
        n = len((t or "").split())
        for s in range(max(1, -(-n // 100))):
            want[d, s, s * 100, min(100, n - s * 100)] += 1
    assert Counter((r.doc_id, r.segment, r.first_token, r.n_tokens) for r in out) == want
    for bucket in {r.bucket for r in out}:
        own = [r for r in out if r.bucket == bucket]
        edge = own[0].padded_to
        room = max(1, 400 // max(1, edge))
        assert all(r.padded_to == edge and r.n_tokens <= edge for r in own)
        assert sorted((r.batch, r.slot) for r in own) == [(k // room, k % room) for k in range(len(own))]
    assert packing.pack_documents(docs.limit(0)).count() == 0
