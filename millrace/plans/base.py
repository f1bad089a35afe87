"""Registration of queries, and tables derived from the driver's ones that play the domain's.

Derivations are SQL that Spark and DuckDB read alike, so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The rows of shared SQL over the named tables."""
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


_THOUGHT = "'<think>' || text || '</think>' || chr(10) || '<answer>' || text || '</answer>'"
#: Completions of a model with their solutions, as training logs have them.
COMPLETIONS = f"""
SELECT conv_id * 100 + turn AS id, conv_id AS object_id, CAST(turn AS BIGINT) AS gen_idx, CAST(floor(conv_id / 16) AS BIGINT) AS step,
  CASE (conv_id + turn) % 8
    WHEN 0 THEN {_THOUGHT}
    WHEN 1 THEN {_THOUGHT} || ' '
    WHEN 2 THEN '<answer>' || text || '</answer>'
    WHEN 3 THEN text
    WHEN 4 THEN '<think>' || text || '</think><answer>Yes, ' || text || '</answer>'
    WHEN 5 THEN '<answer>' || CAST(conv_id % 7 AS STRING) || CASE WHEN conv_id % 2 = 0 THEN ' legs' ELSE '' END || '</answer>'
    WHEN 6 THEN '<think>a b. c</think><answer>x</answer> then <answer> ' || 'The ' || text || '.</answer>'
    ELSE '<think>one. two! three?</think> <answer>' || chr(10) || 'The answer is B.  Not A. ' || chr(10) || chr(10) || text || chr(13) || 'twelve</answer>' END AS content,
  CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN CAST(conv_id % 5 AS STRING) WHEN 2 THEN 'no' ELSE '<answer>B</answer>' END AS solution,
  CASE turn % 4 WHEN 0 THEN 'all_match' WHEN 1 THEN 'numeric' WHEN 2 THEN 'yes_no' ELSE 'mcq' END AS method,
  CASE turn % 4 WHEN 0 THEN 'partnext_object_identity' WHEN 1 THEN 'part_count' WHEN 2 THEN 'other' ELSE 'part_identity' END AS qa_type
FROM conversations
"""

#: Boxes: lines of an order are boxes of an image; the truth of a line is its box moved a little.
BOXES = """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS ord, l_returnflag AS label, l_discount AS score,
  CAST(l_linenumber * 10 AS DOUBLE) AS x1, CAST(l_partkey % 40 AS DOUBLE) AS y1,
  l_linenumber * 10 + l_quantity AS x2, l_partkey % 40 + l_quantity AS y2,
  CAST(l_linenumber * 10 + l_suppkey % 5 AS DOUBLE) AS gx1, CAST(l_partkey % 40 + l_suppkey % 3 AS DOUBLE) AS gy1,
  l_linenumber * 10 + l_suppkey % 5 + l_quantity AS gx2, l_partkey % 40 + l_suppkey % 3 + l_quantity AS gy2
FROM lineitem
"""

#: Replies of a judge, and what it cost.
JUDGED = """
SELECT d.doc_id AS object_id, CAST(d.doc_id % 12 AS BIGINT) AS ground_truth, d.lang AS truth_label, d.source AS category,
  CASE d.doc_id % 9
    WHEN 0 THEN CAST(d.doc_id % 12 AS STRING) || '#' || d.lang || '#fits'
    WHEN 1 THEN 'I say ' || CAST((d.doc_id + d.n_chars) % 14 AS STRING) || '#' || d.source || '#close'
    WHEN 2 THEN '99#x#y' WHEN 3 THEN '-1#NA#unsure' WHEN 4 THEN 'no hash' WHEN 5 THEN 'T#ok' WHEN 6 THEN 'f#no'
    WHEN 7 THEN CAST(d.n_chars % 130 AS STRING) || '#fine' ELSE '#x' END AS reply,
  CASE WHEN d.n_chars % 3 = 0 THEN 'gpt-4-0613' WHEN d.n_chars % 3 = 1 THEN 'gpt-3.5-turbo-0613' ELSE 'gpt-4.1' END AS model,
  CAST(d.n_chars % 300 AS BIGINT) AS prompt_tokens, CAST(d.n_chars % 70 AS BIGINT) AS completion_tokens,
  CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS predicted, l.quality AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

#: Points of objects: three dimensions of an embedding, by label.
POINTS = """
SELECT CAST(label AS BIGINT) AS object_id, vec_id AS point_id, CAST(embedding[{0}] AS DOUBLE) AS x, CAST(embedding[{1}] AS DOUBLE) AS y, CAST(embedding[{2}] AS DOUBLE) AS z
FROM embeddings
"""
#: Spark counts array elements from 0, DuckDB from 1.
POINTS_SPARK, POINTS_SQL = POINTS.format(0, 1, 2), POINTS.format(1, 2, 3)

#: A hierarchy: region, nation, customer; ids are texts with a letter for the level.
TREE = """
SELECT 'world' AS object_id, 'r' || CAST(r_regionkey AS STRING) AS node_id, CAST(NULL AS STRING) AS parent_id, r_regionkey AS ord, r_name AS label, CAST(NULL AS STRING) AS mask_id, CAST(5 AS BIGINT) AS points FROM region
UNION ALL SELECT 'world', 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'mn' || CAST(n_nationkey AS STRING) END, CAST(n_nationkey % 5 AS BIGINT) FROM nation
UNION ALL SELECT 'world', 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), CAST(c_custkey AS INT), c_name, CASE WHEN c_custkey % 3 = 0 THEN 'mc' || CAST(c_custkey AS STRING) END, CAST(c_custkey % 7 AS BIGINT) FROM customer
"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, COMPLETIONS, "conversations")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, BOXES, "lineitem")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, JUDGED, "documents", "labels")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, POINTS_SPARK, "embeddings")
