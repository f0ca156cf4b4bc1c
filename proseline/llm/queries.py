"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm import chat, langid, licenses, media, mixing, packing, pages, quality, simhash, suffix
from proseline.llm.common import settings
from proseline.llm.common import table as read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settings(spark)
    return read(spark, sf_dir, name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by SimHash over three-word shingles, at three bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as grey images, read back, resized and hashed."""
    found = media.describe(media.text_images(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and isolation forest over all documents, calibrated on their labels."""
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "path"
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 3, 1, 2 and 150 % of their words, at most twice each source."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed best-fit into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that other documents have too, and where these stand."""
    return suffix.repeated(table(spark, sf_dir, "documents"))


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts and notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control one, formatted by the compiled template and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(turns.unionByName(chat.control_chat(spark))))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language mixtures of all documents, learned from those that aren't held out."""
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "langs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_suffix": op6_suffix,
    "op7_pages": op7_pages,
    "op8_licenses": op8_licenses,
    "op9_chat": op9_chat,
    "op10_langid": op10_langid,
}

#: In DuckDB, Sainte-Lague lists every quotient and takes the highest, and each block's extra turn is looked at alone.
OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
per_source AS (
  SELECT source, count(*) AS n_rows, sum(size) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2.0 * source_size AS cap FROM per_source),
ordered AS (
  SELECT *, sum(cap) OVER o - cap AS full_before, sum(w) OVER () - (sum(w) OVER o - w) AS w_left,
         1.5 * sum(source_size) OVER () AS budget
  FROM weighed WINDOW o AS (ORDER BY cap / w, i ROWS UNBOUNDED PRECEDING)),
unit AS (
  SELECT (SELECT min_by((budget - full_before) / w_left, cap / w) FROM ordered
          WHERE (budget - full_before) / w_left <= cap / w) AS u),
goal AS (SELECT weighed.*, CAST(least(cap, w * u) AS DOUBLE) AS target FROM weighed, unit),
seats AS (SELECT CAST(round(sum(target) / 16) AS BIGINT) AS n, sum(target) AS total FROM goal),
source_quotient AS (
  SELECT i, target / (2 * k + 1) AS quotient, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, i) AS place
  FROM goal, seats, LATERAL (SELECT unnest(range(CAST(ceil(target / total * n) AS BIGINT) + 2)) AS k)
  WHERE target > 0),
source_blocks AS (
  SELECT i, count(*) AS blocks_given FROM source_quotient, seats WHERE place <= n GROUP BY i),
dealt AS (
  SELECT s.doc_id, s.source, g.i, s.size, s.k, g.source_size, g.target,
         CAST('0x' || substr(md5(s.k || CAST(s.size AS VARCHAR)), 1, 8) AS BIGINT)
           % CAST(ceil(g.n_rows / 20000.0) AS BIGINT) AS shard
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
shards AS (
  SELECT i, shard, any_value(source) AS source, sum(size) AS shard_size,
         greatest(CAST(ceil(sum(size) / 16.0) AS BIGINT), 1) AS n_blocks
  FROM dealt GROUP BY i, shard),
shard_quotient AS (
  SELECT s.i, s.shard, row_number() OVER (PARTITION BY s.i ORDER BY s.shard_size / (2 * k + 1) DESC, s.shard) AS place
  FROM shards s JOIN goal g USING (i), LATERAL (
    SELECT unnest(range(CAST(ceil(s.shard_size * 2.0 / 16) AS BIGINT) + 3)) AS k)
  WHERE s.shard_size > 0),
quota AS (
  SELECT s.i, s.shard, s.n_blocks, CAST(least(coalesce(q.n, 0), 2 * ceil(s.shard_size / 16.0)) AS BIGINT) AS quota,
         CAST('0x' || substr(md5(concat_ws(':', 'mix', s.source, CAST(s.shard AS VARCHAR))), 1, 7) AS BIGINT)
           % s.n_blocks AS turn
  FROM shards s LEFT JOIN (
    SELECT i, shard, count(*) AS n FROM shard_quotient JOIN source_blocks USING (i)
    WHERE place <= blocks_given GROUP BY i, shard) q ON s.i = q.i AND s.shard = q.shard),
line AS (
  SELECT d.*, sum(size) OVER (PARTITION BY i, shard ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS e
  FROM dealt d),
parts AS (
  SELECT l.doc_id, l.size, l.source_size, l.target, l.e, q.quota, q.n_blocks, q.turn, b,
         greatest(0, least(l.e, (b + 1) * 16) - greatest(l.e - l.size, b * 16)) AS inside
  FROM line l JOIN quota q ON l.i = q.i AND l.shard = q.shard, LATERAL (
    SELECT unnest(range(CAST((l.e - l.size) // 16 AS BIGINT), CAST(l.e // 16 AS BIGINT) + 1)) AS b))
SELECT doc_id, any_value(size) AS size, CAST(any_value(source_size) AS BIGINT) AS source_size,
       round(any_value(target), 6) AS target,
       CAST(sum(inside * (quota // n_blocks
            + CASE WHEN (b * (quota % n_blocks) + turn) % n_blocks + quota % n_blocks >= n_blocks THEN 1 ELSE 0 END))
            AS BIGINT) AS taken
FROM parts GROUP BY doc_id, e
"""

#: The template's output and what is read back from it, told without the template.
OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(k)),
e AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM t),
f AS (SELECT *, replace(replace(r, '\', '\\'), '<|', '<\|') AS er, replace(replace(x, '\', '\\'), '<|', '<\|') AS ex FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(replace(er, chr(10), '\n')) + 1 + length(ex) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op4_mixing": OP4_SQL, "op8_licenses": licenses.oracle(), "op9_chat": OP9_SQL}
