"""The subpackage's queries over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.llm import ann, chat, decontaminate, neardup, packing, pages, quality, ring, substring, tokenscan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.predictions(quality.score(docs, model))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.occurrences(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op4_rotate_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenscan.count_documents(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.assign(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(substring.remove_repeats(_table(spark, sf_dir, "documents")))


def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


QUERIES = {
    "op1_quality_votes": op1_quality_votes,
    "op2_decontaminate": op2_decontaminate,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_rotate_chat": op4_rotate_chat,
    "op5_token_counts": op5_token_counts,
    "op6_pack": op6_pack,
    "op7_template_slots": op7_template_slots,
    "op8_ring_shards": op8_ring_shards,
    "op9_suffix_trees": op9_suffix_trees,
    "op10_kmeans_tree": op10_kmeans_tree,
}

ORACLE = {
    "op2_decontaminate": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[p + 1:p + k], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(0, greatest(0, len(ws) - least(10, len(ws)) + 1))) AS p FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, p, k, array_to_string(ws[p + 1:p + k], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(0, greatest(0, len(ws) - k + 1))) AS p FROM w CROSS JOIN (SELECT DISTINCT k FROM bw))),
hit AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN bw USING (k, win)),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_rotate_chat": r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role <> 'system'),
x AS (SELECT *, CASE WHEN turn IS NULL THEN md5(coalesce(role, '') || chr(10) || text) END AS loose FROM t),
r AS (
  SELECT t.*, perspective, CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS seat
  FROM x AS t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
s AS (SELECT *, CASE WHEN seat = 'user' THEN role END AS name FROM r),
h AS (SELECT *, '<|im_start|>' || seat || coalesce(' name=' || regexp_replace(regexp_replace(name, '[ \t\n\v\f\r]+', ' ', 'g'), '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g'), '') || chr(10) AS head FROM s),
g AS (SELECT *, head || regexp_replace(text, '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, loose, role NULLS LAST, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g)
SELECT conv_id, perspective, turn, seat, name, segment, start, start + length(segment) AS stop,
  CASE WHEN seat = 'assistant' THEN start + length(head) ELSE start + length(segment) END AS train_start, start + length(segment) AS train_stop
FROM o""",
    "op9_suffix_trees": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, p, md5(array_to_string(ws[p + 1:p + 20], ' ')) AS win
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(0, len(ws) - 19))) AS p FROM d)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS rn FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM f WHERE rn > 1),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM d) AS x
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.p = x.p)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_lsh_forest": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[p + 1:p + 5], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, len(ws) - 4))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * i >= 75 * (na.n + nb.n - i)),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT reach.doc_id, link.b AS c FROM reach JOIN link ON link.a = reach.c)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) USING (doc_id)""",
}
