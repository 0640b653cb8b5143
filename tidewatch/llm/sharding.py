"""Byte-balanced shards by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import gapless
from .scratch import cut

#: Groups differenced in one task, and partial partitions combined in one task or on the driver.
BLOCK, FAN_IN = 50_000, 4_096


def difference(items: list[tuple[int, ...]], ways: int) -> list[list[int]]:
    """For every partial partition (its sums), the part into which each of its slots goes.

    The two partial partitions of largest spread are combined in opposite order, the largest sum of one with the
    smallest of the other, until one is left. Ties go to the earlier item.
    """
    if not items:
        return []
    heap, tree, count = [], {}, 0
    for sums in items:
        order = sorted(range(ways), key=lambda k: (sums[k], k))
        tree[count] = order
        heap.append((sums[order[0]] - sums[order[-1]], count, [sums[k] for k in order]))
        count += 1
    heapq.heapify(heap)
    joined: dict[int, tuple[int, int, list[int]]] = {}
    while len(heap) > 1:
        (_, a, low), (_, b, high) = heapq.heappop(heap), heapq.heappop(heap)
        sums = [low[k] + high[ways - 1 - k] for k in range(ways)]
        order = sorted(range(ways), key=lambda k: (sums[k], k))
        joined[count] = (a, b, order)
        heapq.heappush(heap, (sums[order[0]] - sums[order[-1]], count, [sums[k] for k in order]))
        count += 1
    parts: list[list[int]] = [[0] * ways for _ in items]
    todo = [(heap[0][1], list(range(ways)))]
    while todo:
        node, to = todo.pop()
        if node < len(items):
            for place, slot in enumerate(tree[node]):
                parts[node][slot] = to[place]
            continue
        a, b, order = joined[node]
        mine = [0] * ways
        for place, k in enumerate(order):
            mine[k] = to[place]
        todo.append((a, mine))
        todo.append((b, mine[::-1]))
    return parts


def _deal_groups(rows: pd.DataFrame, ways: int) -> pd.DataFrame:
    rows = rows.sort_values(["weight", "group"], ascending=[False, True])
    parts = difference([(0,) * (ways - 1) + (int(w),) for w in rows["weight"]], ways)
    return pd.DataFrame({"group": rows["group"], "block": rows["block"], "slot": [p[-1] for p in parts]})


def _sums(rows: pd.DataFrame, ways: int) -> tuple[list[int], list[tuple[int, ...]]]:
    wide = rows.pivot_table(index="block", columns="slot", values="weight", aggfunc="sum", fill_value=0)
    wide = wide.reindex(columns=range(ways), fill_value=0).sort_index()
    return wide.index.tolist(), [tuple(int(x) for x in row) for row in wide.to_numpy()]


def _deal_blocks(rows: pd.DataFrame, ways: int) -> pd.DataFrame:
    blocks, sums = _sums(rows, ways)
    parts = difference(sums, ways)
    return pd.DataFrame(
        [(b, s, int(rows["parent"].iloc[0]), p[s]) for b, p in zip(blocks, parts, strict=True) for s in range(ways)],
        columns=["block", "slot", "parent", "into"],
    )


def _rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def shard_groups(groups: DataFrame, ways: int = 8, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """(group, shard) for groups (group, weight), one row a group, with sums of weight as near equal as differencing gets.

    Hash blocks of about `block` groups are differenced in parallel tasks. Each leaves one partial partition of `ways`
    sums with a tiny spread, and these are differenced in turn, `fan_in` at a time, until at most `fan_in` are left for
    the driver, whose rows (fan_in times ways) are thus bounded at any input size.
    """
    groups = cut(groups, "groups")
    blocks = max(1, -(-_rows(groups) // block))
    dealt = cut(
        groups.withColumn("block", F.pmod(F.xxhash64("group", F.lit("block")), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(partial(_deal_groups, ways=ways), f"group {groups.schema['group'].dataType.simpleString()}, block long, slot int"),
        "dealt",
    )
    tuples = dealt.join(groups, "group").groupBy("block", "slot").agg(F.sum("weight").alias("weight"))
    path = None
    while blocks > fan_in:
        tuples = cut(tuples.withColumn("parent", F.floor(F.col("block") / fan_in)), "tuples")
        step = cut(tuples.groupBy("parent").applyInPandas(partial(_deal_blocks, ways=ways), "block long, slot int, parent long, into int"), "step")
        tuples = (
            tuples.drop("parent").join(step, ["block", "slot"]).groupBy(F.col("parent").alias("block"), F.col("into").alias("slot")).agg(F.sum("weight").alias("weight"))
        )
        path = step if path is None else path.join(
            step.select(F.col("block").alias("parent"), F.col("slot").alias("into"), F.col("parent").alias("p2"), F.col("into").alias("i2")), ["parent", "into"]
        ).select("block", "slot", F.col("p2").alias("parent"), F.col("i2").alias("into"))
        blocks = -(-blocks // fan_in)
    left = pd.DataFrame([tuple(r) for r in tuples.collect()], columns=["block", "slot", "weight"])
    names, sums = _sums(left, ways) if len(left) else ([], [])
    final = [(b, s, p[s]) for b, p in zip(names, difference(sums, ways), strict=True) for s in range(ways)]
    last = groups.sparkSession.createDataFrame(final, "block long, slot int, shard int")
    if path is not None:
        last = path.join(last.toDF("parent", "into", "shard"), ["parent", "into"]).select("block", "slot", "shard")
    return dealt.join(last, ["block", "slot"]).select("group", "shard")


def shard_documents(docs: DataFrame, ways: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs (doc_id, text, ...).

    Rows of equal text are one indivisible group; null and empty texts are one group too. size is the text's UTF-8 bytes
    plus 1 (null: 1), text_crc32 is 0 for a null text, law is `bytes`: sums of size are as near equal as Karmarkar-Karp
    differencing of the groups makes them, so a group above an eighth of all bytes has a shard to itself. slot counts
    from 0 without gaps in each shard; grown_shard is null. Null ids and repeated rows keep their rows; other columns are
    ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)).alias("group"),
        ),
        "sizes",
    )
    shards = shard_groups(rows.groupBy("group").agg(F.sum("size").alias("weight")), ways)
    placed = cut(rows.join(shards, "group").drop("group"), "placed")
    return gapless(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot", _rows(placed)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
