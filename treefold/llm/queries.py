"""The eleven queries of this subpackage over the tables of a folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l
), o AS (
  SELECT k, min(doc_id) AS owner FROM k WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.owner < k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.owner IS NULL OR o.owner >= k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o ON k.k = o.k GROUP BY k.doc_id
"""

def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_files
    from .tokenizing import vocabulary

    return token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM s WHERE i + 19 <= len(w)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), marks AS (
  SELECT doc_id, i, sum(m) AS m FROM (SELECT doc_id, i, 1 AS m FROM late UNION ALL SELECT doc_id, i + 20, -1 FROM late) GROUP BY doc_id, i
), cov AS (
  SELECT s.doc_id, s.i, s.w[s.i] AS word,
         coalesce(sum(m.m) OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS UNBOUNDED PRECEDING), 0) > 0 AS gone
  FROM s LEFT JOIN marks m ON m.doc_id = s.doc_id AND m.i = s.i
), g AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS k FROM cov GROUP BY doc_id
)
SELECT d.doc_id, coalesce(g.n, 0) AS n_words, coalesce(g.r, 0) AS n_removed, sha256(coalesce(g.k, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import written
    from .media import media_columns, payload_digests, texts_as_media

    stored = written(media_columns(texts_as_media(table(spark, sf_dir, "documents"))), "media")
    track = F.col("tracks")[0]
    found = payload_digests(stored.select("doc_id", "n_bytes", "media", track["codec"].alias("codec"), (track["duration"] / track["timescale"]).alias("seconds"), track["key_frames"].alias("key_frames")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "key_frames")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 6).alias("probability"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), p AS (
  SELECT conv_id, row_number() OVER w AS pos, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), x AS (
  SELECT conv_id, pos, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos) AS pre, max(pos) OVER (PARTITION BY conv_id) AS n FROM p
), whole AS (
  SELECT min(conv_id) AS conv_id, n, pre FROM x WHERE pos = n GROUP BY n, pre
)
SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(n AS BIGINT) AS n_turns, pre AS rendered FROM whole
WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.pos < x.n AND x.pos = whole.n AND x.pre = whole.pre)
"""


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokenizing import vocabulary

    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OPS = (
    op1_chat_format, op2_line_dedup, op3_pack_sequences, op4_media_columns, op5_substring_dedup, op6_quality_rules,
    op7_quality_classifier, op8_mix_sources, op9_simhash, op10_token_files, pipeline,
)
QUERIES = {f.__name__: f for f in _OPS}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op2_line_dedup": OP2_SQL, "op5_substring_dedup": OP5_SQL}
