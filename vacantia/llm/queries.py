"""The queries of this folder, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, media, mixing, packing, sharding, simhash, token_counts, toxicity, url_filters
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontam.digest(found)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.describe(media.store(table(spark, sf_dir, "documents"))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_media_columns": op2_media_columns,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_url_filters": op10_url_filters,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_decontamination"] = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[k : k + 12], ' ') AS gram
  FROM b, unnest(range(1, greatest(2, len(words) - 11))) AS t(k) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT rid, k, s.size, array_to_string(words[k : k + s.size - 1], ' ') AS gram
  FROM w, sizes AS s, unnest(range(1, len(words) - s.size + 2)) AS t(k)),
hits AS (SELECT g.rid, g.k, g.size, win.item_id FROM grams AS g JOIN win ON g.size = win.size AND g.gram = win.gram),
hit_words AS (
  SELECT rid, count(DISTINCT p) AS n FROM hits, unnest(range(k, k + size)) AS t(p) GROUP BY rid),
hit_items AS (
  SELECT rid, count(*) AS n, array_to_string(list(item_id ORDER BY item_id), ',') AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w.words) AS contaminated
FROM w LEFT JOIN hit_words AS h ON w.rid = h.rid LEFT JOIN hit_items AS i ON w.rid = i.rid
"""

ORACLE_SQL["op7_chat"] = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY turn) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
  FROM t GROUP BY conv_id),
u AS (SELECT turns, n, text, min(conv_id) AS conv_id, count(*) AS n_logged FROM c GROUP BY turns, n, text),
p AS (SELECT DISTINCT turns[1 : k] AS turns FROM u, unnest(range(1, n)) AS x(k))
SELECT conv_id, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS part, n AS n_turns, n_logged, n AS chunk_turns, text
FROM u WHERE turns NOT IN (SELECT turns FROM p)
"""

ORACLE_SQL["op9_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS turn
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, 2 * source_size / [3, 1, 2][(place - 1) % 3 + 1] AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
t AS (
  SELECT source, source_size, place, coalesce(least(CAST(2 * source_size AS DOUBLE), (SELECT level FROM f) * weight), CAST(2 * source_size AS DOUBLE)) AS target FROM l),
b AS (
  SELECT greatest(1, CAST(floor(sum(target) / 65536) AS BIGINT)) AS block FROM t),
u AS (SELECT t.*, block, CASE WHEN block > 1 AND target < 64 * block THEN 1 ELSE block END AS unit FROM t, b),
seats AS (SELECT CAST(floor(coalesce(sum(target) FILTER (unit = block), 0) / any_value(block) + 0.5) AS BIGINT) AS seats FROM u),
q AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS seat
  FROM u, unnest(range(0, CAST(floor(target / block) AS BIGINT) + 3)) AS x(k) WHERE target > 0 AND unit = block),
h AS (SELECT place, CAST(floor((seat - 1) * 8 / seats) AS INTEGER) AS shard FROM q, seats WHERE seat <= seats),
g AS (SELECT place, count(*) AS blocks, list_transform(range(0, 8), lambda k: len(list_filter(list(shard), lambda s: s <= k))) AS upto FROM h GROUP BY place),
v AS (
  SELECT u.*, upto, least(CASE WHEN unit = block THEN coalesce(g.blocks, 0) * unit ELSE CAST(floor(target + 0.5) AS BIGINT) END, 2 * source_size) AS words,
         CASE WHEN source_size > 0 THEN CAST('0x' || substr(md5('17:' || coalesce(source, '')), 1, 15) AS BIGINT) % source_size // unit * unit ELSE 0 END AS start
  FROM u LEFT JOIN g ON u.place = g.place),
p AS (
  SELECT *, CASE WHEN unit = block THEN list_transform(upto, lambda e: e * unit) ELSE list_transform(range(1, 9), lambda k: CAST(floor(words * k / 8) AS BIGINT)) END AS ends FROM v),
o AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.words, p.start, p.ends,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY p.place ORDER BY d.turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, a + size AS z, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS rounds FROM o),
e AS (SELECT *, start + words - rounds * source_size AS stop FROM r),
m AS (
  SELECT doc_id, size, source_size, target, ends, CASE WHEN z > start THEN greatest(a, start) - start ELSE a + source_size - start END AS first,
         CAST(rounds * size + greatest(0, least(z, stop) - greatest(a, start)) + greatest(0, least(z, stop - source_size) - a) AS BIGINT) AS taken
  FROM e)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CAST(len(list_filter(ends, lambda x: x <= first)) AS INTEGER) END AS shard FROM m
"""

ORACLE_SQL["op10_url_filters"] = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS rid
  FROM pages),
r(rule, h, p, v) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
f AS (
  SELECT rid, rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, f.rule, coalesce(f.v, 'allow') AS verdict FROM u LEFT JOIN f ON u.rid = f.rid AND f.k = 1
"""
