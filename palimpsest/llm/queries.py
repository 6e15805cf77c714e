"""The operators' queries with production parameters, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, hamming, html_main, kneser_ney, mixing, records, simhash, syncmers, urlrules
from palimpsest.llm.common import table


TOKENIZER = "word_bpe_49k.json"


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op2_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


RULES = [
    urlrules.Rule("com", "/", "allow"),
    urlrules.Rule("example.com", "/en/", "block"),
    urlrules.Rule("www.example.com", "/en/", "allow"),
    urlrules.Rule("net", "/es/", "block"),
    urlrules.Rule("net", "/fr/", "block"),
]
#: For URLs that no rule fits.
PATTERNS = [
    urlrules.Rule("*", f"*/{word}/", "block")
    for word in "ads adserver banners cart cgi-bin checkout feed forgot-password login logout password-reset print redirect register search session share signup tracking wp-admin wp-login".split()
]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), RULES, PATTERNS)


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.where("vec_id % 20 = 0"), k=10)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join("blocks", " ")
    return html_main.extract(table(spark, sf_dir, "pages")).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: The tools that conversations may call.
TOOLS: chat.Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True), "precision": ("number", False)},
}


def op9_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"), TOOLS)


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = records.written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2, as_bytes=True)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_closed_syncmers": op1_closed_syncmers,
    "op2_simhash_bk_tree": op2_simhash_bk_tree,
    "op3_url_rules": op3_url_rules,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_html_main_text": op5_html_main_text,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_sainte_lague_mix": op7_sainte_lague_mix,
    "op8_bpe_segment_tree": op8_bpe_segment_tree,
    "op9_chat_tool_links": op9_chat_tool_links,
    "op10_token_records": op10_token_records,
}

SQL_HOST = "regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)"
SQL_PATH = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
SQL_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
SQL_BLOCKED = " OR ".join(f"contains(path, '{p.path.strip('*')}')" for p in PATTERNS)

OP3_SQL = f"""
WITH p AS (SELECT page_id, row_number() OVER () AS n, coalesce(translate({SQL_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce({SQL_PATH}, '') AS path FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES {SQL_RULES}),
f AS (SELECT n, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
    FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {SQL_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN f USING (n)
"""

SQL_BIT = "coalesce({0}[i] > 0 AND NOT isnan({0}[i]), FALSE)"
OP4_SQL = f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
c AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN {SQL_BIT.format('embedding')} THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END))::UBIGINT AS code FROM e),
d AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::BIGINT AS distance FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d QUALIFY rank <= 10
"""


def sql_number(digest: str) -> str:
    return f"CAST('0x' || substr({digest}, 1, 8) AS BIGINT)"


SQL_DIGEST = f"md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || r.t)"
#: Quotients of all blocks are ranked here, where the operator ranks only those in doubt.
OP7_SQL = f"""
WITH r AS (SELECT row_number() OVER () AS n, doc_id, source, md5(coalesce(text, '')) AS t, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM r GROUP BY source),
b AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM a),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cb, coalesce(sum(w) OVER o, 0) AS wb, sum(source_size) OVER () AS t, sum(w) OVER () AS ws FROM b WINDOW o AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, cap::HUGEINT * (ws - wb) <= w::HUGEINT * (t - cb) AS is_full FROM c),
e AS (SELECT *, t - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS rest, ws - coalesce(sum(w) FILTER (is_full) OVER (), 0) AS wl FROM d),
s AS (SELECT source, k, source_size, CAST(ceil(docs / {mixing.SHARD_ROWS}) AS BIGINT) AS shards, CASE WHEN is_full THEN cap::DOUBLE ELSE (w * rest)::DOUBLE / wl::DOUBLE END AS target FROM e),
q AS (SELECT k, count(*) AS quota FROM (SELECT k FROM (SELECT k, target, unnest(range(0, CAST(target / {mixing.BLOCK} AS BIGINT) + 4)) AS j FROM s) WHERE target > 0
    QUALIFY row_number() OVER (ORDER BY target / (2 * j + 1) DESC, k, j) <= (SELECT floor(sum(target) / {mixing.BLOCK} + 0.5) FROM s)) GROUP BY k),
p AS (SELECT r.*, s.k, s.source_size, s.target, {SQL_DIGEST} AS h, {sql_number(SQL_DIGEST)} % s.shards AS shard FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source),
g AS (SELECT k, shard, CAST(sum(size) AS BIGINT) AS words FROM p GROUP BY k, shard),
u AS (SELECT k, shard, count(*) AS blocks FROM (SELECT k, shard FROM (SELECT g.k, shard, words, coalesce(quota, 0) AS quota, unnest(range(0, 3 * CAST(words / {mixing.BLOCK} AS BIGINT) + 8)) AS j FROM g LEFT JOIN q USING (k)) WHERE words > 0
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY words / (2 * j + 1) DESC, shard, j) <= quota) GROUP BY k, shard),
v AS (SELECT g.k, g.shard, words, (words + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS whole, least(coalesce(blocks, 0), 3 * ((words + {mixing.BLOCK - 1}) // {mixing.BLOCK})) AS blocks FROM g LEFT JOIN u ON g.k = u.k AND g.shard = u.shard WHERE words > 0),
x AS (SELECT k, shard, words, blocks // whole AS passes, blocks % whole AS run, whole, {sql_number(f"md5('{mixing.SEED}:' || k || ':' || shard)")} % whole AS first FROM v),
y AS (SELECT p.*, CAST(coalesce(sum(size) OVER (PARTITION BY k, shard ORDER BY substr(h, 9, 24), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_word FROM p)
SELECT doc_id, size, source_size, target, CAST(coalesce(passes * size
    + greatest(least(least((first + run) * {mixing.BLOCK}, words), at_word + size) - greatest(first * {mixing.BLOCK}, at_word), 0)
    + greatest(least(greatest((first + run - whole) * {mixing.BLOCK}, 0), at_word + size) - greatest(0, at_word), 0), 0) AS BIGINT) AS taken
FROM y LEFT JOIN x ON y.k = x.k AND y.shard = x.shard
"""

SQL_CALLS = f"CASE WHEN role = 'assistant' THEN len(regexp_extract_all(coalesce(text, ''), '{chat.CALL}', 1)) ELSE 0 END"
#: The tables hold no calls and no results; tests link, order and validate those of a fixture.
OP9_SQL = f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text) AS position, turn, role, CAST({SQL_CALLS} AS BIGINT) AS n_calls, CAST({SQL_CALLS} AS BIGINT) AS n_bad,
    CASE WHEN role = 'tool' THEN 'orphan' END AS link, '{{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}}' AS json FROM conversations
"""

ORACLE_SQL: dict[str, str] = {
    "op3_url_rules": OP3_SQL,
    "op4_multi_index_hashing": OP4_SQL,
    "op7_sainte_lague_mix": OP7_SQL,
    "op9_chat_tool_links": OP9_SQL,
}
