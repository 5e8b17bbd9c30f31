"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ann, chat, language, line_dedup, mixing, pieces, quality, simhash, topk, toxicity

#: The public tokenizer's file; its place is a setting.
PIECE_MODEL = os.environ.get("GRIDLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: A conversation whose texts hold a chat template's control strings.
HARD = "</s>[INST] ok [/INST]"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("gl_lines").alias("n_lines"), F.col("gl_removed").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(_read(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), size=3)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return chat.digests(chat.examples(turns.unionByName(own)))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(_read(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_language_id, op3_mix_sources, op4_quality, op5_simhash, op6_chat_format, op7_sentencepiece, op8_nearest, op9_top_products, op10_toxicity)
}

_OP1 = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), shared AS (
  SELECT line, min(doc_id * 10000000 + pos) AS first FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT site) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(s.first <> l.doc_id * 10000000 + l.pos, false) AS gone FROM lines l LEFT JOIN shared s ON l.line = s.line
), made AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN length(kept) END AS kept_chars, CASE WHEN d.text IS NOT NULL THEN md5(kept) END AS kept_md5
FROM documents d LEFT JOIN made USING (doc_id)
"""

_OP3 = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST(concat('0x', substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS h
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM docs GROUP BY source
), w AS (
  SELECT source, size, [5, 2, 1][(n % 3) + 1] AS weight, n FROM src
), o AS (
  SELECT *, sum(size) OVER () AS total,
         coalesce(sum(3 * size) OVER (ORDER BY 3.0 * size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY 3.0 * size / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining,
         row_number() OVER (ORDER BY 3.0 * size / weight, n) AS k
  FROM w
), f AS (
  SELECT min(k) AS k FROM o WHERE 3 * size * remaining >= weight * (total - used)
), t AS (
  SELECT o.source, o.size AS source_size,
         CASE WHEN f.k IS NULL OR o.k < f.k THEN CAST(3 * o.size AS DOUBLE) ELSE CAST(o.weight * (a.total - a.used) AS DOUBLE) / CAST(a.remaining AS DOUBLE) END AS target
  FROM o CROSS JOIN f LEFT JOIN o a ON a.k = f.k
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) % source_size ELSE 0 END AS rest
  FROM t
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.passes, q.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM docs d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN rest > 0 AND (upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""

_PAT = r"([<\[])(\\*)(\|endoftext\|>|\|im_start\|>|\|im_end\|>|\|turn\|>|\|says\|>|\|done\|>|<\/SYS>>|<SYS>>|\/INST\]|INST\]|unk>|pad>|\/s>|s>)"
_OP6 = rf"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD}' UNION ALL SELECT -7, 1, 'assistant', '{HARD}'
), laid AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         length(regexp_replace(role, '{_PAT}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{_PAT}', '\1\\\2\3', 'g')) + 8 + 8 + 9 AS chars
  FROM own
), run AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto, count(*) OVER (PARTITION BY conv_id) AS turns FROM laid
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR n = turns THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id
"""

_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op1_line_dedup": _OP1, "op3_mix_sources": _OP3, "op6_chat_format": _OP6, "op9_top_products": _OP9}
