"""URL rules as a sort-merge range join over reversed hosts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def rule_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def host_and_path(url):
    """Columns (host, path) of a url column; both empty for null and for text without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substr(url, F.length(rest) + F.lit(4))
    host = F.coalesce(F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def host_key(host):
    """Labels reversed, each closed by a dot: the keys of a host and its subdomains are one interval."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Events sorted by (part, key, kind): a rule opens its interval, a url reads the stack of open ones."""
    stack: list[tuple[str, list[tuple[int, str, str, str]]]] = []
    part, last, answers = None, None, {}
    for batch in batches:
        columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        keys, kinds, parts = (columns[n].to_pylist() for n in ("key", "kind", "part"))
        hosts, paths, verdicts = (columns[n].to_pylist() for n in ("host", "path", "verdict"))
        take, rules, given = [], [], []
        for i, key in enumerate(keys):
            if parts[i] != part:
                part, stack, last = parts[i], [], None
            if kinds[i] == 0:
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                rule = (len(hosts[i]) + len(paths[i]), paths[i], hosts[i] + paths[i], verdicts[i])
                if stack and stack[-1][0] == key:
                    stack[-1][1].append(rule)
                else:
                    stack.append((key, [rule]))
                last = None
                continue
            if key != last:
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                last, answers = key, {}
            best = answers.get(paths[i])
            if best is None:
                fits = [r for _, own in stack for r in own if paths[i].startswith(r[1])]
                best = max(fits, key=lambda r: (r[0], r[3] == "block", r[2])) if fits else (0, "", None, default)
                if len(answers) < 10_000:
                    answers[paths[i]] = best
            take.append(i)
            rules.append(best[2])
            given.append(best[3])
        at = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [columns["page_id"].take(at), columns["host"].take(at), columns["path"].take(at), pa.array(rules, pa.string()), pa.array(given, pa.string())],
            names=["page_id", "host", "path", "rule", "verdict"],
        )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url, ...).

    rules (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's path;
    the longest host plus path wins, of equal ones a block. Rules with a null field never fit. A null url, or one without
    `://`, has an empty host and path. Urls without a fitting rule get a null rule and the default verdict. Repeated
    rows stay; other columns are ignored.

    Keys with reversed labels make each rule an interval, and all intervals are nested or disjoint. Rules and urls are
    dealt into key ranges; a hot host spans several of them, since path and id split it further. The rules open where a
    range starts are the ones whose key is a prefix of its first key: an equi-join on those prefixes hands them over, so
    neither side is ever broadcast by force, and each range is swept once with a stack of open rules.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    rules = rules.select("verdict", "host", "path").where("verdict is not null and host is not null and path is not null")
    rules = rules.withColumn("key", host_key(F.translate("host", UPPER, LOWER))).distinct()
    kind = pages.schema["page_id"].dataType
    events = urls.select("key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    events = events.unionByName(
        rules.select("key", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict")
    )
    width = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(
        events.repartitionByRange(width, "key", "kind", "path", F.xxhash64("page_id")).withColumn("part", F.spark_partition_id()), "urls"
    )
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split(F.col("first"), r"\.")
    prefixes = firsts.select(
        "part", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("key")
    )
    carried = prefixes.join(rules, "key").select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict", "part"
    )
    ready = ranged.unionByName(carried).repartition(width, "part").sortWithinPartitions("part", "key", "kind")
    return ready.mapInArrow(
        partial(_sweep, default=default), f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string"
    )
