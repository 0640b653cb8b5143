import random

import numpy as np
import pytest
import xxhash

from tidewatch.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Ünï", "ça", "A\x0b", "日本"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300]))] for _ in range(60)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for k in range(200):
        b = list(base[3] if k % 2 else rng.choice(base))
        b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((100 + k, " \t".join(b)))
    rows += [(500, None), (501, ""), (502, " \n "), (None, "w1 w2 w3"), (7, rows[7][1]), (7, rows[7][1]), (503, "long " * 200_000)]
    return rows


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_components_equal_brute_force(spark, monkeypatch, bucket):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, fp string, component_id double")
    monkeypatch.setattr(simhash.near_links, "__defaults__", (3, bucket))
    found = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert found == plain_components(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


@pytest.mark.parametrize("n,spread", [(5, 2), (300, 2), (300, 20)])
def test_bit_sliced_groups_find_all_near_pairs(n, spread):
    rng = np.random.default_rng(n + spread)
    group = np.sort(rng.integers(0, 4, n))
    fps = rng.integers(0, 1 << 63, 4, np.uint64)[group]
    for _ in range(spread):
        fps ^= np.uint64(1) << rng.integers(0, 64, n, np.uint64)
    roots, members = simhash._near_in_groups(group, fps, 3)
    label = np.arange(n)
    for r, m in zip(roots, members, strict=True):
        assert group[r] == group[m]
        label[label == label[m]] = label[r]
    want = np.arange(n)
    for i in range(n):
        for j in range(i):
            if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 3:
                want[want == want[i]] = want[j]
    assert len(set(zip(label.tolist(), want.tolist(), strict=True))) == len(set(label.tolist())) == len(set(want.tolist()))


def test_refinement_ends():
    mask, depth = 0, 0
    while 64 - mask.bit_count() > 11:
        mask, depth = min(simhash.child_masks(mask, 3), key=int.bit_count), depth + 1
    assert depth <= 8
