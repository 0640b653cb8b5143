"""Near-duplicates by the exact similarity of word-shingle sets, found by SimHash and, beyond its radius, MinHash bands."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import cut, trimmed
from .simhash import _Sets, fingerprint, near_links

WIDTH, SIMILARITY = 5, 0.8
#: Sets whose SimHash fingerprints differ in so many bits or fewer are candidates.
RADIUS = 3
#: Sets of similarity s share one of BANDS bands of ROWS minima with probability 1 - (1 - s**ROWS)**BANDS: at 0.8 all but 5 in a million.
BANDS, ROWS = 40, 6
#: Candidates are compared in pairs of blocks of about so many sets.
BLOCK = 128
CHUNK = 1024

_RNG = np.random.default_rng(42)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(k) for k in (1, 0))


def shingle_set(body: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles; a text of fewer words than width is one shingle."""
    words = body.lower().split() if body else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.fromiter((digest(s, 42) for s in joined), np.uint64, len(words) - width + 1))


def band_keys(shingles: np.ndarray) -> list[int]:
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), CHUNK):
        np.minimum(least, (shingles[lo : lo + CHUNK] * _TIMES + _PLUS).min(1), out=least)
    keys = (xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS))
    return np.fromiter(keys, np.uint64, BANDS).view(np.int64).tolist()


def _node(shingles: np.ndarray) -> int:
    """The number of a set: equal sets are one node."""
    n = xxhash.xxh64_intdigest(shingles.tobytes(), 7)
    return n - (1 << 64) if n >> 63 else n


@trimmed
def _band_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, fps, bands = [], [], []
        for body in batch.column(1):
            text = body.as_py()
            own = shingle_set(text, width)
            nodes.append(_node(own))
            fps.append(fingerprint(text, width))
            bands.append(band_keys(own))
        columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(fps, pa.uint64()).view(pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "bands"])


@trimmed
def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            sets = [shingle_set(body.as_py(), width) for body in batch.column(0)[lo : lo + 256]]
            columns = [pa.array(map(_node, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of all pairs of sets whose Jaccard similarity is at least `similarity`."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner, both = np.repeat(np.arange(n), sizes), np.zeros((n, n))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for lo in range(0, len(values), 8192):
        a, b = np.searchsorted(code, [lo, lo + 8192])
        has = np.zeros((n, min(8192, len(values) - lo)), np.float32)
        has[owner[a:b], code[a:b] - lo] = 1
        both += has @ has.T
    return np.nonzero(np.triu(both / (sizes[:, None] + sizes - both) >= similarity, 1))


def _compare(table: pa.Table, similarity: float) -> pa.Table:
    """A spanning forest of the similar pairs of one pair of blocks."""
    nodes = table.column("node").to_pylist()
    found = _Sets()
    if len(nodes) > 1:
        i, j = similar([np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()], similarity)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            found.join(x, y)
    members = [k for k in found.up if found.root(k) != k]
    return pa.table({"u": pa.array([nodes[k] for k in members], pa.int64()), "v": pa.array([nodes[found.root(k)] for k in members], pa.int64())})


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) of nodes of prints (node, fp, bands) that connect all whose fingerprints are within radius."""
    marks = cut(prints.where(F.size("bands") > 0).select("node", "fp").distinct(), "marks")
    first = cut(marks.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    near = cut(near_links(first.select("fp"), radius), "near")
    inside = marks.join(first, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    across = near.join(first.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v")
    return inside.unionByName(across.select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(doc_id, component_id) of every row of docs (doc_id, text, ...).

    Words are maximal runs without ASCII white space, with A-Z lower-cased. Two texts are linked if the Jaccard similarity
    of their sets of `width`-word shingles is at least `similarity`; wordless and null texts equal each other.
    component_id is the smallest doc_id reachable over links; rows without an id get a row and do not name a component.

    Sets are candidates if op3's method links them, that is if the SimHash fingerprints of their texts differ in RADIUS
    bits or fewer, or if they share a MinHash band, which finds the similar sets that lie beyond that radius. Stars over
    fingerprints and bands join candidates to groups, whose sets are then compared exactly, all with all, in pairs of
    blocks; equal sets are one node throughout, wordless ones need no comparison.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("body"))
    prints = cut(texts.mapInArrow(partial(_band_batches, width=width), f"doc_id {kind}, node long, fp long, bands array<long>"), "prints")
    rows = cut(prints.select(F.explode("bands").alias("key"), "node").distinct(), "bands")
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").drop("last")
    shared = rows.join(heads, "key").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    groups = cut(connected_components(shared.unionByName(fingerprint_links(prints))), "groups")

    # one text of each node that has candidates; texts without an id may be the only ones of their node
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("first")), "nodes")
    chosen = nodes.join(groups.select("node"), "node", "left_semi").select(F.col("first").alias("doc_id")).where("doc_id is not null")
    bodies = texts.join(cut(chosen.distinct(), "chosen"), "doc_id", "left_semi").unionByName(texts.where("doc_id is null")).select("body")
    sets = bodies.mapInArrow(partial(_set_batches, width=width), "node long, shingles binary")
    blocks = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = cut(placed.join(sets.dropDuplicates(["node"]), "node"), "sets")
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "shingles"
    )

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, similarity)

    links = dealt.groupBy("root", "i", "j").applyInArrow(compare, "u long, v long")

    member = cut(connected_components(links), "members")
    least = member.join(nodes, "node").groupBy("root").agg(F.min("first").alias("least"))
    moved = member.join(least, "root").select("node", "least", F.lit(True).alias("linked"))
    named = cut(nodes.join(moved, "node", "left").select("node", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id")), "named")
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
