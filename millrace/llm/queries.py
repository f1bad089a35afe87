"""The corpus operators bound to the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, conversation_repair, decontaminate, exact_dedup, langid, licenses, ngram_join, pieces, spelling, substring_dedup, toxicity, warc
from .common import crc_bucket, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.filter(crc_bucket("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").filter(crc_bucket("doc_id", 5) != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.audit(warc.archive(pages), warc.archive(warc.with_bit_rot(pages)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.with_faults(turns), turns)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"), faults=97)


ALL = (
    op1_decontaminate, op2_ngram_join, op3_chat, op4_language, op5_toxicity, op6_exact_dedup, op7_licenses, op8_bpe, op9_substring_dedup, op10_warc_fixity,
    op11_conversation_repair, op12_sentencepiece, op13_spelling_variants,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


OP3_SQL = """
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
upto AS (
  SELECT a.conv_id, a.k, a.n, string_agg(b.line, '' ORDER BY b.k) AS prefix
  FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.k <= a.k GROUP BY a.conv_id, a.k, a.n),
whole AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM upto WHERE k = n GROUP BY n, prefix)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS n_copies, prefix AS rendered
FROM whole w WHERE NOT EXISTS (SELECT 1 FROM upto u WHERE u.k < u.n AND u.k = w.n AND u.prefix = w.prefix)
"""

OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op7_sql() -> str:
    values = ", ".join(f"('{k}', {p}, [{', '.join(repr(b) for b in grams)}])" for (k, p), grams in licenses.template_sets(licenses.TEMPLATES).items())
    return rf"""
WITH templates(license, part, grams) AS (VALUES {values}),
norm AS (
  SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?]+[ \t]+', chr(1), 'g'), '[^\p{{L}}\p{{N}}\n\x01]+', ' ', 'g') AS norm FROM documents),
parts AS (SELECT doc_id, norm, string_split(norm, chr(10)) AS lines, string_split_regex(norm, '\n(?: ?\n)+') AS paragraphs FROM norm),
lines AS (SELECT doc_id, unnest(range(len(lines))) AS unit_no, unnest(lines) AS said FROM parts),
sentences AS (SELECT doc_id, unit_no, string_split(said, chr(1)) AS parts FROM lines WHERE contains(said, chr(1))),
units AS (
  SELECT doc_id, 'line' AS unit, unit_no, 0 AS sentence_no, said FROM lines
  UNION ALL SELECT doc_id, 'sentence', unit_no, unnest(range(len(parts))), unnest(parts) FROM sentences
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(paragraphs))), 0, unnest(paragraphs) AS said FROM parts) WHERE contains(said, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, 0, norm FROM parts WHERE len(paragraphs) > 1),
split AS (SELECT doc_id, unit, unit_no, sentence_no, string_split(trim(regexp_replace(said, '[ \n\x01]+', ' ', 'g')), ' ') AS w FROM units),
sized AS (
  SELECT doc_id, unit, unit_no, sentence_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM split WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, unit, unit_no, sentence_no, license, part, 2 * len(list_intersect(s.grams, t.grams)) / (len(s.grams) + len(t.grams)) AS dice
  FROM sized s JOIN templates t ON len(s.grams) BETWEEN len(t.grams) / 1.5 - 1e-9 AND len(t.grams) * 1.5 + 1e-9)
SELECT doc_id, unit, CAST(unit_no AS BIGINT) AS unit_no, CAST(sentence_no AS BIGINT) AS sentence_no, license, part, dice FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, unit_no, sentence_no ORDER BY dice DESC, license, part) = 1
"""


OP10_SQL = r"""
WITH both_sides AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         CASE WHEN length(html) > 0 AND (page_id % 2147483648 * 2654435761) % 4294967296 % 101 = 7 THEN '#' || substring(html, 2) ELSE coalesce(html, '') END AS rotten FROM pages),
r AS (
  SELECT page_id, url, CAST(floor(page_id / 256) AS BIGINT) AS file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
         || chr(13) || chr(10) || chr(13) || chr(10) AS head, html, rotten FROM both_sides),
s AS (
  SELECT page_id, url, file, strlen(head || html) + 4 AS length,
         sha256(head || html || chr(13) || chr(10) || chr(13) || chr(10)) AS left_digest, sha256(head || rotten || chr(13) || chr(10) || chr(13) || chr(10)) AS right_digest FROM r),
o AS (SELECT *, sum(length) OVER (PARTITION BY file ORDER BY page_id, url ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS record_offset FROM s)
SELECT file, CAST(record_offset AS BIGINT) AS record_offset, CAST(length AS BIGINT) AS length, page_id, 'corrupt' AS status, left_digest, right_digest
FROM o WHERE left_digest <> right_digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op7_licenses": op7_sql(), "op10_warc_fixity": OP10_SQL}
