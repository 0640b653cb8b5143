import random

import corpus_pipeline
import pytest

from tidewatch.llm import shingles, simhash


def plain_shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(rows):
    sets, up = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return {d for d, _ in rows} - {d for i, (d, _) in enumerate(rows) if d is not None and d != least[root(i)]}


@pytest.mark.parametrize("block", [shingles.BLOCK, 7])
def test_stage_equals_brute_force(spark, monkeypatch, block):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["Ünï", "ça", "A\x0b", "日本"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 5, 40, 120, 1500]))] for _ in range(60)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for k in range(240):
        b = list(base[3] if k % 2 else rng.choice(base))
        for _ in range(rng.randint(1, max(1, len(b) // 40))):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((100 + k, " \t".join(b)))
    rows += [(500, None), (501, ""), (502, " \n "), (None, rows[3][1]), (7, rows[7][1]), (503, "long " * 20_000), (504, "long " * 30_000)]
    monkeypatch.setattr(shingles, "BLOCK", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert found == plain_kept(rows)
    assert shingles.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprints_alone_find_candidates(spark, monkeypatch):
    """Without any band, the copies within the radius are linked, and those only."""
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(12)]
    rows = [(k, b) for k, b in enumerate(base)] + [(100 + k, f"{b} tail") for k, b in enumerate(base)]
    rows += [(200, None), (201, ""), (202, "one"), (None, base[4] + " tail")]
    prints = [simhash.fingerprint(t.encode(), 5) for _, t in rows[:24]]
    near = {k for k in range(12) if (prints[k] ^ prints[12 + k]).bit_count() <= 3}
    assert len(near) >= 6
    kept = shingles.cut
    monkeypatch.setattr(shingles, "cut", lambda df, name: kept(df.limit(0) if name == "bands" else df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect() if r.doc_id is not None}
    assert {k for k in range(12) if found[100 + k] == k} == near
    assert found[200] == found[201] == 200 and found[202] == 202
