"""SimHash near-duplicates, compared in bit-sliced form."""

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

BITS = 64
CHUNK = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A bucket of more distinct fingerprints than this is refined by further pigeonholes.
BUCKET = 2048
#: Groups up to this size are compared along shifted planes of a whole batch, larger ones group by group.
SHORT = 48


def fingerprint(body: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text; null and wordless texts give 0."""
    words = body.lower().split() if body else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, n, CHUNK):
        part = words[lo : lo + CHUNK + width - 1]
        if len(words) < width:
            shingles = [b" ".join(words)]
        else:
            shingles = list(map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)))
        hashed = np.fromiter((digest(s, seed) for s in shingles), np.dtype("<u8"), len(shingles))
        counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@trimmed
def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    body = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("body"))
    return body.mapInArrow(partial(_fingerprint_batches, width=width, seed=seed), f"doc_id {kind}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """uint64[64, words]: bit i of plane p is bit p of fingerprint i."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    room = -(-len(fps) // BITS) * BITS
    wide = np.zeros((BITS, room), np.uint8)
    wide[:, : len(fps)] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def near_lanes(
    left: np.ndarray, at: np.ndarray, right: np.ndarray, to: np.ndarray, dead: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes of 64 pairs hold a pair within radius: positions in `at`, and for each the lanes' bits.

    Word k compares left[:, at[k]] with right[:, to[k]], 64 pairs at once. Two planes at a time enter the counters by a
    full adder, carries ripple through the higher counters, and a carry out of the last marks a lane as too far. After
    every eight planes the words whose lanes are all too far are abandoned.
    """
    counters = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over, where = dead.copy(), np.arange(len(at))
    for lo in range(0, BITS, 8):
        for p in range(lo, lo + 8, 2):
            x, y = left[p, at] ^ right[p, to], left[p + 1, at] ^ right[p + 1, to]
            half = counters[0] ^ x
            carry = (counters[0] & x) | (half & y)
            counters[0] = half ^ y
            for c in range(1, len(counters)):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
        alive = over != ALL
        if not alive.all():
            at, to, over, where = at[alive], to[alive], over[alive], where[alive]
            counters = [c[alive] for c in counters]
            if not len(at):
                break
    return where, ~over


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bit) of every set bit."""
    return np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class _Sets:
    """Union-find whose root is the smallest position."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.up.setdefault(min(x, y), min(x, y))


def _short_groups(group: np.ndarray, fps: np.ndarray, longest: int, radius: int, sets: _Sets) -> None:
    """Joins near members of the groups, all in one pass for each distance in the sorted batch."""
    planes, n = bit_planes(fps), len(fps)
    for d in range(1, longest):
        shifted = bit_planes(fps[d:])
        words = shifted.shape[1]
        same = np.zeros(words * BITS, np.uint8)
        same[: n - d] = group[d:] == group[:-d]
        dead = ~np.packbits(same, bitorder="little").view(np.uint64)
        at = np.nonzero(dead != ALL)[0]
        where, lanes = near_lanes(planes, at, shifted, at, dead[at], radius)
        if len(where):
            word, bit = _lanes(lanes)
            i = at[where][word] * BITS + bit
            for k in i[_distance(fps[i], fps[i + d]) <= radius].tolist():
                sets.join(k, k + d)


def _long_group(start: int, fps: np.ndarray, radius: int, sets: _Sets) -> None:
    planes, n = bit_planes(fps), len(fps)
    words = planes.shape[1]
    tail = np.zeros(words * BITS, np.uint8)
    tail[:n] = 1
    dead = ~np.packbits(tail, bitorder="little").view(np.uint64)
    label = np.arange(n)
    for lo in range(0, n, 128):
        asked = fps[lo : lo + 128]
        first = lo // BITS
        bits = np.unpackbits(np.ascontiguousarray(asked).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
        masks = np.where(bits, ALL, np.uint64(0))
        at = np.tile(np.arange(first, words), len(asked))
        to = np.repeat(np.arange(len(asked)), words - first)
        where, lanes = near_lanes(planes, at, masks, to, dead[at], radius)
        word, bit = _lanes(lanes)
        i, j = lo + to[where][word], at[where][word] * BITS + bit
        near = (j > i) & (_distance(fps[i], fps[np.minimum(j, n - 1)]) <= radius)
        i, j = i[near], j[near]
        for one in np.unique(i):
            met = np.unique(np.append(label[j[i == one]], label[one]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    for k in np.nonzero(label != np.arange(n))[0].tolist():
        sets.join(start + int(label[k]), start + k)


def _near_in_groups(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the near pairs inside each run of equal group numbers: positions of roots and members."""
    sets = _Sets()
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    if (short := sizes <= SHORT).any():
        keep = np.repeat(short & (sizes > 1), sizes)
        kept = np.flatnonzero(keep)
        if len(kept):
            own = _Sets()
            _short_groups(group[kept], fps[kept], int(sizes[short].max()), radius, own)
            for k in own.up:
                sets.join(int(kept[own.root(k)]), int(kept[k]))
    for s, n in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True):
        _long_group(s, fps[s : s + n], radius, sets)
    members = [k for k in sets.up if sets.root(k) != k]
    return [sets.root(k) for k in members], members


@trimmed
def _bucket_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside buckets of (mask, val, fp) rows sorted by mask and val; a bucket may span batches."""

    def links(mask: np.ndarray, val: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        change = np.append(False, (mask[1:] != mask[:-1]) | (val[1:] != val[:-1]))
        roots, members = _near_in_groups(np.cumsum(change), fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[members]), pa.array(fp[roots])], names=["u", "v"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.append(h, batch.column(k).to_numpy(zero_copy_only=False)) for k, h in enumerate(held)]
        mask, val, _ = held
        if not len(mask):
            continue
        last = (mask == mask[-1]) & (val == val[-1])
        cut_at = int(np.argmax(last))
        if cut_at:
            yield links(*(h[:cut_at] for h in held))
            held = [h[cut_at:].copy() for h in held]
    if len(held[0]):
        yield links(*held)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def child_masks(mask: int, radius: int) -> list[int]:
    """Masks that fix, beside the bits of mask, one of radius+1 equal shares of its free bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False) if hi > lo]


def near_links(nodes: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) that connect all pairs within radius.

    Pigeonhole: of radius+1 shares of the bits, two near fingerprints agree on one. Inside a bucket the bit-sliced
    comparison finds all near pairs and a spanning forest of them is returned, so output stays linear. Buckets of more
    than `bucket` members are refined: the same argument on their free bits gives finer buckets. A bucket with f free
    bits has at most 2**f distinct members, so refinement ends and every bucket that reaches a task is bounded.
    """
    masks = child_masks(0, radius)
    rows = nodes.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp")
    out = None
    while True:
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"), "fp")
        full = cut(rows.groupBy("mask", "val").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).drop("n"), "full")
        more = not full.isEmpty()
        small = rows.join(full, ["mask", "val"], "left_anti") if more else rows
        part = (
            small.repartition("mask", "val")
            .sortWithinPartitions("mask", "val")
            .mapInArrow(partial(_bucket_batches, radius=radius), "u long, v long")
        )
        out = part if out is None else out.unionByName(part)
        if not more:
            return out
        finer = {m: child_masks(m, radius) for m in masks}
        masks = sorted({c for cs in finer.values() for c in cs})
        pairs = [x for m, cs in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in cs]))]
        rows = rows.join(full, ["mask", "val"], "left_semi").select(
            F.explode(F.create_map(*pairs)[F.col("mask")]).alias("mask"), "fp"
        )


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text, ...).

    Words are maximal runs without ASCII white space, with A-Z lower-cased. Texts of fewer words than `width` have one
    shingle, wordless and null texts the fingerprint 0, linked like any other. component_id is the smallest doc_id
    reachable over fingerprints at most `radius` bits apart; rows without an id get a row and do not name a component
    (null if no reachable row has an id). Repeated rows give repeated rows. Other columns are ignored.
    """
    prints = cut(fingerprints(docs, width, seed), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    member = cut(connected_components(near_links(nodes, radius)), "members")
    least = (
        member.join(nodes, member.node == nodes.fp).groupBy("root").agg(F.min("first").alias("least"))
    )
    moved = member.join(least, "root").select(F.col("node").alias("fp"), "least", F.lit(True).alias("linked"))
    # a table of its own, so that the last join is of two plain scans, whose hot fingerprints adaptive execution can split
    named = cut(
        nodes.join(moved, "fp", "left").select(
            "fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id")
        ),
        "named",
    )
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
