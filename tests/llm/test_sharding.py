import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import sharding


def test_differencing_balances():
    rng = random.Random(6)
    weights = [rng.randint(1, 1000) for _ in range(400)]
    parts = sharding.difference([(0,) * 7 + (w,) for w in weights], 8)
    sums = [sum(w for w, p in zip(weights, parts, strict=True) if p[-1] == k) for k in range(8)]
    assert max(sums) - min(sums) <= 8 and all(sorted(p) == list(range(8)) for p in parts)
    assert sharding.difference([], 8) == []
    two = sharding.difference([(0, 8), (0, 7), (0, 6), (0, 5), (0, 4)], 2)
    loads = [sum(w for w, p in zip((8, 7, 6, 5, 4), two, strict=True) if p[-1] == k) for k in (0, 1)]
    assert abs(loads[0] - loads[1]) == 2


def check(rows, out, ways=8):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    shards, slots = defaultdict(int), defaultdict(list)
    for r in out:
        shards[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    group = defaultdict(set)
    for r in out:
        group[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in group.values())
    return [shards[k] for k in range(ways)]


def test_documents(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, "é" * rng.randint(0, 400)) for k in range(900)] + [(2000 + k, "copy") for k in range(300)] + [(None, None), (None, ""), (5, "x"), (5, "x"), (6000, "long " * 2000)]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, shard string")
    sums = check(rows, sharding.shard_documents(docs).collect())
    assert max(sums) - min(sums) <= 0.02 * sum(sums)
    monkeypatch.setattr(sharding.shard_groups, "__defaults__", (8, 20, 3))
    sums = check(rows, sharding.shard_documents(docs).collect())
    assert max(sums) - min(sums) <= 0.03 * sum(sums)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_gapless_splits_equal_rows(spark, monkeypatch):
    from tidewatch.llm import numbering, scratch

    monkeypatch.setattr(numbering, "ROWS_PER_SALT", 50)
    rows = scratch.cut(spark.range(2000).select(F.lit(7).alias("doc_id"), F.when(F.col("id") < 5, 1).otherwise(0).alias("g")).repartition(3), "equal")
    got = numbering.gapless(rows, ["g"], ["doc_id"], "at", 2000)
    numbers = {g: sorted(r["at"] for r in got.where(F.col("g") == g).collect()) for g in (0, 1)}
    assert numbers == {0: list(range(1995)), 1: list(range(5))}
    salts = rows.select(F.pmod(F.xxhash64("doc_id", F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / 50)), F.lit(40)).alias("s"))
    assert max(r["count"] for r in salts.groupBy("s").count().collect()) < 600


def plain_difference(items, ways):
    """The same by scanning for the two widest partial partitions."""
    live = {}
    for k, sums in enumerate(items):
        order = sorted(range(ways), key=lambda s: (sums[s], s))
        live[k] = [(sums[s], {(k, s)}) for s in order]
    count = len(items)
    while len(live) > 1:
        a, b = sorted(live, key=lambda k: (live[k][0][0] - live[k][-1][0], k))[:2]
        low, high = live.pop(a), live.pop(b)[::-1]
        live[count] = sorted(((x + y, p | q) for (x, p), (y, q) in zip(low, high, strict=True)), key=lambda r: r[0])
        count += 1
    (last,) = live.values()
    return {member: place for place, (_, members) in enumerate(last) for member in members}


def test_differencing_equals_a_plain_scan():
    rng = random.Random(12)
    for ways in (2, 3, 8):
        for size in (1, 2, 7, 60):
            items = [tuple(rng.randint(0, 40) for _ in range(ways)) if rng.random() < 0.3 else (0,) * (ways - 1) + (rng.randint(1, 400),) for _ in range(size)]
            got, want = sharding.difference(items, ways), plain_difference(items, ways)
            assert {(k, s): got[k][s] for k in range(size) for s in range(ways)} == want
