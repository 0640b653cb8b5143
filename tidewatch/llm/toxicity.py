"""Toxicity by subword-bag embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, trimmed

GRAMS = (3, 4, 5, 6)
BUCKET_BITS, DIM = 17, 4
#: Labelled rows of each class that are fitted at most; all rows are scored.
MAX_TOXIC, MAX_CLEAN = 1_000, 2_000
MIN_DOCS, EPOCHS, STEPS, BATCH, RATE, DECAY = 5, 6, 150, 128, 3.0, 1e-5
CHUNK = 1 << 20

#: A-Z become lower case; other ASCII but letters and digits separates words.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_POWERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xB5297A4D], np.uint32)


class Model(NamedTuple):
    """Per bucket: its weight in the average, and its vector's part of the logit times that weight."""

    weight: np.ndarray
    pull: np.ndarray
    bias: float


def gram_buckets(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, valid) by start byte for each n; an n-gram is valid if no byte but its first and last is a space."""
    blank = text == 32
    wide = text.astype(np.uint32)
    mixed = np.zeros(len(text), np.uint32)
    inner = np.zeros(len(text), bool)
    for n in range(1, GRAMS[-1] + 1):
        room = len(text) - n + 1
        if room <= 0:
            return
        mixed = mixed[:room] + wide[n - 1 :] * _POWERS[n - 1]
        inner = inner[:room] | (blank[n - 2 : n - 2 + room] if n > 2 else False)
        if n in GRAMS:
            hashed = mixed ^ (mixed >> np.uint32(15)) ^ np.uint32(n * 0x9E37)
            yield (hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS), ~inner


def _spaced(body: bytes | None) -> np.ndarray:
    return _BYTES[np.frombuffer(b" " + (body or b"") + b" ", np.uint8)]


def features(body: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole UTF-8 text, streamed in chunks."""
    text, total = _spaced(body), np.zeros(1 << BUCKET_BITS, np.int64)
    small = len(text) <= 1 << 14
    seen = []
    for lo in range(0, len(text), CHUNK):
        for n, (bucket, valid) in zip(GRAMS, gram_buckets(text[lo : lo + CHUNK + GRAMS[-1] - 1]), strict=False):
            own = bucket[: max(0, min(CHUNK, len(text) - lo - n + 1))]
            own = own[valid[: len(own)]]
            if small:
                seen.append(own)
            else:
                total += np.bincount(own, minlength=len(total))
    if small:
        return np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    found = np.flatnonzero(total)
    return found, total[found]


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Embeddings and softmax fitted together by AdaGrad on (buckets, counts, label); the list is emptied on the way.

    A text is the average of its subword vectors, weighted by count and inverse document frequency; buckets of fewer than
    MIN_DOCS texts take no part, so that chance subwords carry no weight. Classes weigh the same in sum up to a factor of 3.
    There are EPOCHS passes, and more over few examples, so that at least STEPS batches are seen.
    """
    size = 1 << BUCKET_BITS
    seen = np.zeros(size, np.int64)
    for ids, _, _ in examples:
        seen[ids] += 1
    weight = np.where(seen >= MIN_DOCS, np.log((1 + len(examples)) / (1 + seen)) + 1e-3, 0.0).astype(np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    output = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sums = [np.full_like(vectors[:, 0], 1e-8), np.full_like(output, 1e-8), np.full_like(bias, 1e-8)]
    labels = np.array([y for _, _, y in examples], np.int64)
    share = max(labels.mean(), 1e-9)
    cost = np.where(labels == 1, min(3.0, (1 - share) / share), 1.0).astype(np.float32)
    if share > 0.5:
        cost = np.where(labels == 0, min(3.0, share / max(1 - share, 1e-9)), 1.0).astype(np.float32)
    mixes = []
    for k, (ids, counts, _) in enumerate(examples):
        # what is no longer needed goes at once, as the driver's memory is small
        examples[k] = ()
        ids = ids[weight[ids] > 0], counts[weight[ids] > 0]
        mix = weight[ids[0]] * ids[1]
        mixes.append((ids[0].astype(np.int32), (mix / max(mix.sum(), 1e-6)).astype(np.float32)))
    scale = np.float32(20)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(examples))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(examples))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            ids = np.concatenate([mixes[r][0] for r in rows])
            mix = np.concatenate([mixes[r][1] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(mixes[r][0]) for r in rows])
            mean = np.stack([np.bincount(owner, mix * vectors[ids, d], len(rows)) for d in range(DIM)], axis=1).astype(np.float32) * scale
            logits = mean @ output + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= cost[rows, None] / len(rows)
            back = p @ output.T * scale
            used = np.flatnonzero(np.bincount(ids, minlength=size))
            grad = np.stack([np.bincount(ids, mix * back[owner, d], size)[used] for d in range(DIM)], axis=1).astype(np.float32)
            grad += DECAY * vectors[used]
            sums[0][used] += (grad**2).mean(1)
            vectors[used] -= rate * grad / np.sqrt(sums[0][used])[:, None]
            for value, part, own in ((output, mean.T @ p, sums[1]), (bias, p.sum(0), sums[2])):
                own += part**2
                value -= 0.1 * rate * part / np.sqrt(own)
    pull = scale * (vectors @ (output[:, 1] - output[:, 0])) * weight
    return Model(weight, pull.astype(np.float32), float(bias[1] - bias[0]))


def scores(bodies: list[bytes | None], model: Model) -> np.ndarray:
    """The softmax probability of label 1 for each whole text."""
    texts = [_spaced(b) for b in bodies]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    pull, weight = np.zeros(len(texts)), np.zeros(len(texts))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK, "right")) - 1)
        text = np.concatenate(texts[lo:hi])
        starts = bounds[lo:hi] - bounds[lo]
        for at in range(0, len(text), CHUNK):
            for bucket, valid in gram_buckets(text[at : at + CHUNK + GRAMS[-1] - 1]):
                bucket, valid = bucket[:CHUNK], valid[:CHUNK]
                first = int(np.searchsorted(starts, at, "right")) - 1
                inside = np.append(at, starts[(starts > at) & (starts < at + len(bucket))]) - at
                rows = slice(lo + first, lo + first + len(inside))
                pull[rows] += np.add.reduceat(np.where(valid, model.pull[bucket], 0), inside, dtype=np.float64)
                weight[rows] += np.add.reduceat(np.where(valid, model.weight[bucket], 0), inside, dtype=np.float64)
        lo = hi
    logit = pull / np.maximum(weight, 1e-6) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _in_bytes(buckets: np.ndarray, counts: np.ndarray, most: int = 127) -> tuple[np.ndarray, np.ndarray]:
    """The same sums a bucket in counts of one byte: a bucket with a larger count is named several times."""
    times = -(-counts // most)
    out = np.full(int(times.sum()), most, np.int8)
    out[np.cumsum(times) - 1] = counts - (times - 1) * most
    return np.repeat(buckets, times), out


@trimmed
def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_in_bytes(*features(x.as_py())) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                pa.array([f[1] for f in found], pa.list_(pa.int8())),
            ],
            names=["label", "buckets", "counts"],
        )


@trimmed
def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        bodies = [x.as_py() for x in batch.column(1)]
        found = scores(bodies, model) if model is not None else np.zeros(len(bodies))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])


def _body(docs: DataFrame):
    return F.col("text").cast("string").cast("binary").alias("body")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model | None:
    """A model of labels.toxic over texts whose crc32(doc_id) mod 5 is not 0; None without rows of both classes.

    Of each class the max_toxic or max_clean rows with the smallest hash of doc_id are fitted: a bounded sample, so the
    joined side that is broadcast, and what reaches the driver, have fixed bounds. An id whose labels disagree is left out, and
    of rows that repeat an id the smallest text is fitted.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("high"))
    known = known.where((F.col("label") == F.col("high")) & ~held_out(F.col("doc_id"))).join(
        docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi"
    )
    picked = None
    for label, most in ((1, max_toxic), (0, max_clean)):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "label")
        picked = part if picked is None else picked.unionByName(part)
    # one text an id: an id that many rows repeat adds no more to the driver than any other
    rows = docs.select("doc_id", _body(docs)).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.min("body").alias("body")).drop("doc_id")
    table = rows.mapInArrow(_feature_batches, "label int, buckets array<int>, counts array<byte>").toArrow()
    if len(set(table.column("label").to_pylist())) < 2:
        return None
    examples = []
    for batch in table.to_batches():
        label = batch.column(0).to_pylist()
        ids, counts = batch.column(1), batch.column(2)
        for k, y in enumerate(label):
            examples.append((ids[k].values.to_numpy(), counts[k].values.to_numpy(), y))
    del table
    examples.sort(key=lambda e: (e[2], len(e[0]), e[0].tobytes(), e[1].tobytes()))
    model = train(examples)
    examples.clear()
    release(docs.sparkSession)
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text), with labels (doc_id, toxic).

    Only texts enter a score. Letters and digits are case-folded (ASCII), and the n-grams of 3 to 6 bytes of each word
    with its borders are hashed to vectors, so unseen misspellings share most vectors with the words they stand for.
    Null, empty and wordless texts get the score of the bias alone. Without labels of both classes every score is 0. held_out
    is crc32(doc_id as text) mod 5 = 0, false for a null id. Repeated rows stay; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", _body(docs)).mapInArrow(partial(_score_batches, shared=shared), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
