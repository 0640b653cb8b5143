"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licences, packing, pii, sharding, simhash, topk, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), urls.rule_frame(spark, URL_RULES))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    log = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    events = log.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("op"), "role", "text")
    done = chat.format_chats(events)
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    learned = done.select("conv_id", "formatted", turns.alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return learned.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    queries = vectors.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")
    return topk.exact_top_k(vectors, queries)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_url_filter, op3_simhash, op4_toxicity, op5_pii, op6_chat, op7_licences, op8_packing, op9_topk, op10_sharding)
}

#: The columns of some operators' results that SQL can express, under names of their own.
PARTS = {
    "part_licence_places": lambda s, d: op7_licences(s, d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "part_personal_data_counts": lambda s, d: op5_pii(s, d).select("doc_id", "n_email", "n_ip", "n_card", "n_phone"),
    "part_packing_segments": lambda s, d: op8_packing(s, d).select("doc_id", "segment", "first_token", "n_tokens"),
    "part_shard_sizes": lambda s, d: op10_sharding(s, d).select("doc_id", "size", "law"),
}
QUERIES |= PARTS

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLACES = " || ".join(
    f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i : i + {len(p.split()) - 1}] = {p.split()}), lambda i: struct_pack(i := i, label := '{label}'))" for p, label in licences.PHRASES.items()
)
_COUNT = r"CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{}'), lambda m: {})) AS BIGINT)"
_BARE = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_BARE}) + 1), lambda i: CAST(substr({_BARE}, CAST(length({_BARE}) - i + 1 AS INT), 1) AS INT) * (2 - i % 2) // 10 + CAST(substr({_BARE}, CAST(length({_BARE}) - i + 1 AS INT), 1) AS INT) * (2 - i % 2) % 10)) % 10 = 0"
_HOST = r"coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>)', '\1\\\2\3', 'g')"

ORACLE = {
    "op2_url_filter": f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(v, h, p) AS (VALUES {_RULES}),
m AS (SELECT page_id, host, path, h || p AS rule, v,
  row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON m.k = 1 AND m.page_id = u.page_id AND m.host = u.host AND m.path = u.path""",
    "op6_chat": f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
a AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS l,
  sum(length({_ESC.format("text")}) + length(role) + 9) AS f
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256,
  CAST(f AS BIGINT) AS formatted_chars FROM a""",
    "op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "part_licence_places": f"""
WITH t AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {_PLACES} AS p FROM t)
SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min(list_transform(p, lambda x: x.i - 1)) AS first_word,
  list_max(list_transform(p, lambda x: x.i - 1)) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ','), '') AS base_labels FROM p""",
    "part_personal_data_counts": f"""
SELECT doc_id, {_COUNT.format(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true")} AS n_email,
  {_COUNT.format(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 256) > 255)) = 0")} AS n_ip,
  {_COUNT.format(r"[0-9]([\x20-]?[0-9])+", f"length({_BARE}) BETWEEN 16 AND 19 AND {_LUHN}")} AS n_card,
  {_COUNT.format(r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_BARE}) BETWEEN 8 AND 15")} AS n_phone FROM documents""",
    "part_packing_segments": r"""
WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}{1,3}|[^ \t\n\r\f\x0B\p{L}\p{N}]+')) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(range(CAST(greatest(1, ceil(n / 2048)) AS BIGINT))) AS segment FROM t)
SELECT doc_id, segment, segment * 2048 AS first_token, CAST(least(n - segment * 2048, 2048) AS INT) AS n_tokens FROM s""",
    "part_shard_sizes": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, 'bytes' AS law FROM documents",
}
