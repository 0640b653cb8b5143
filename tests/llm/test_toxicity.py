import random
import zlib

import numpy as np
import pyarrow as pa

from tidewatch.llm import toxicity

TABLES = "/root/testdata/sf0.01"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 80))]
        toxic = int(k % 4 == 0)
        if toxic:
            for _ in range(1 + len(words) // 20):
                words[rng.randrange(len(words))] = rng.choice(["scoundrel", "blockhead", "dimwit"])
        rows.append((k, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en") for d, t, _ in rows] + [(None, "blockheadd", ""), (900, "dimwitt scoundrell", ""), (901, "", ""), (902, None, ""), (903, "melon " * 100_000, "")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(out) == len(rows) + 5
    held = [(out[d].predicted, y) for d, _, y in rows if out[d].held_out]
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _ in rows)
    assert np.mean([p == y for p, y in held]) > 0.95
    assert out[900].predicted == 1 and out[None].predicted == 1 and not out[None].held_out
    assert out[901].score == out[902].score and 0 <= out[901].score <= 1 and out[903].predicted == 0


def test_without_labels_every_score_is_zero(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert [tuple(r)[2:] for r in toxicity.score_documents(docs, labels).collect()] == [(0.0, 0)] * 3
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_chunks_do_not_change_scores_or_features(monkeypatch):
    body = ("Some WORDS, ünd much more text " * 900).encode()
    model = toxicity.Model(*np.random.default_rng(1).random((2, 1 << toxicity.BUCKET_BITS)).astype(np.float32), 0.1)
    bodies = [body, b"", None, b"x", body[:1000]]
    whole, parts = toxicity.scores(bodies, model), toxicity.features(body)
    monkeypatch.setattr(toxicity, "CHUNK", 777)
    assert np.allclose(whole, toxicity.scores(bodies, model))
    again = toxicity.features(body)
    assert (parts[0] == again[0]).all() and (parts[1] == again[1]).all()
    alone = [toxicity.scores([b], model)[0] for b in bodies]
    assert np.allclose(whole, alone)


def test_repeated_rows_do_not_move_the_model(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    more = docs.unionByName(docs.where("doc_id = 4").crossJoin(spark.range(300).select()))
    once, often = toxicity.fit(docs, labels), toxicity.fit(more, labels)
    assert more.count() == 420 and once.bias == often.bias and (once.pull == often.pull).all()


def test_counts_above_a_short_are_whole():
    body = b"melon " * 40_000
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([body], pa.binary())], names=["label", "body"])
    (out,) = toxicity._feature_batches(iter([batch]))
    sums = np.bincount(out.column(1)[0].as_py(), out.column(2)[0].as_py(), 1 << toxicity.BUCKET_BITS)
    ids, counts = toxicity.features(body)
    assert counts.max() >= 40_000 and (sums[ids] == counts).all() and sums.sum() == counts.sum()


def test_scores_equal_a_loop_over_grams():
    rng = np.random.default_rng(6)
    weight, pull = rng.random((2, 1 << toxicity.BUCKET_BITS)).astype(np.float32)
    model = toxicity.Model(weight, pull, -0.3)
    bodies = [b"A few Words, of text", "ünd 7x".encode(), b"", b"a", b"  x  ", b"one-two"]

    def plain(body):
        text = bytes(toxicity._BYTES[list(b" " + body + b" ")])
        up = down = 0.0
        for n in toxicity.GRAMS:
            for at in range(len(text) - n + 1):
                gram = text[at : at + n]
                if 32 in gram[1:-1]:
                    continue
                mixed = sum(c * int(p) for c, p in zip(gram, toxicity._POWERS, strict=False)) & 0xFFFFFFFF
                mixed ^= (mixed >> 15) ^ (n * 0x9E37)
                bucket = (mixed * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - toxicity.BUCKET_BITS)
                up, down = up + float(pull[bucket]), down + float(weight[bucket])
        return 1 / (1 + np.exp(-(up / max(down, 1e-6) - 0.3)))

    assert np.allclose(toxicity.scores(bodies, model), [plain(b) for b in bodies], atol=1e-6)
