"""Inputs of the registered queries, derived from the driver's tables by SQL that Spark and DuckDB both run.

Texts have {table} slots: `view` fills them with DataFrames, `.format` with names for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import ingest

MESSAGES = """
SELECT 'u' || CAST(conv_id % 20 AS STRING) AS user_id, 's' || CAST(conv_id AS STRING) AS session_id,
  'r' || CAST(conv_id AS STRING) || '-' || CAST(CAST(floor(turn / 4) AS BIGINT) AS STRING) AS request_id,
  CAST(row_number() OVER (PARTITION BY conv_id, floor(turn / 4) ORDER BY turn) - 1 AS INT) AS source_index,
  CASE WHEN conv_id % 2 = 0 AND turn % 3 = 1 THEN 'user' ELSE role END AS role, text AS content,
  CASE WHEN turn % 5 = 3 THEN NULL ELSE 1700000000000 + conv_id * 86400000 + turn * 60000 END AS timestamp
FROM {conversations}
"""
MEMORIES = "SELECT 'm' || CAST(doc_id AS STRING) AS memory_id, source AS user_id, text FROM {documents}"
QUERIES = "SELECT 'q' || CAST(item_id AS STRING) AS query_id, 'src' || CAST(item_id % 20 AS STRING) AS user_id, text AS query, CAST(item_id % 7 AS INT) AS top_k FROM {benchmark}"
VECTORS = "SELECT 'm' || CAST(vec_id AS STRING) AS memory_id, 'src' || CAST(vec_id % 20 AS STRING) AS user_id, embedding AS dense FROM {embeddings}"
QUERY_VECTORS = """
SELECT q.query_id, q.user_id, q.query, q.top_k, e.embedding AS dense
FROM (SELECT 'q' || CAST(item_id AS STRING) AS query_id, 'src' || CAST(item_id % 20 AS STRING) AS user_id, text AS query, CAST(item_id % 7 AS INT) AS top_k,
  (item_id * 7) % (SELECT count(*) FROM {embeddings}) AS v FROM {benchmark}) q JOIN {embeddings} e ON e.vec_id = q.v
"""
#: Two queries a session, so that their number grows with the table: one has the even blocks, the other the odd ones.
CANDIDATES = """
SELECT query_id, memory_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY memory_id) - 1 AS INT) AS rank
FROM (SELECT 'q' || substr(session_id, 2) || '-' || CAST(local_index % 2 AS STRING) AS query_id, id AS memory_id FROM {blocks})
"""
#: Queries that end in 1-0 have a repeated index, those in 2-0 lack the score of rank 1.
RERANK_SCORES = """
SELECT query_id, CASE WHEN query_id LIKE '%1-0' AND rank = 0 THEN 1 ELSE rank END AS idx, CAST(rank * 37 % 101 AS DOUBLE) / 101 AS score
FROM {candidates} WHERE NOT (query_id LIKE '%2-0' AND rank = 1)
"""
SEARCHES = "SELECT 'q' || CAST(item_id AS STRING) AS query_id, 'u' || CAST(item_id % 20 AS STRING) AS user_id, text AS query, CAST(3 + item_id % 5 AS INT) AS top_k FROM {benchmark}"
BLOCK_FACTS = """
SELECT 'f-' || id AS id, id AS parent_memory_id, user_id,
  CASE WHEN n % 10 = 0 THEN 'Person ' || user_id ELSE 'I' END AS subject, CASE WHEN n % 10 = 0 THEN 'person ' || user_id ELSE 'i' END AS subject_key,
  CASE WHEN n % 10 = 0 THEN 'name' ELSE 'likes' END AS relation, CASE WHEN n % 10 = 0 THEN 'name' ELSE 'like' END AS relation_key,
  'thing ' || CAST(n % 5 AS STRING) AS object, 'thing ' || CAST(n % 5 AS STRING) AS object_key, 'I like ' || session_id AS statement,
  'Memory fact' || chr(10) || 'Statement: my ' || session_id || ' ' || CAST(local_index AS STRING) AS content,
  event_time, '2024-01-01' AS source_date, local_index = 1 AS supersedes, 'facts-v1' AS version
FROM (SELECT *, CAST(substr(session_id, 2) AS BIGINT) AS n FROM {blocks})
"""
FACTS = """
SELECT 'f' || CAST(event_id AS STRING) AS id, 'b' || CAST(user_id * 10 + event_id % 10 AS STRING) AS parent_memory_id, 'u' || CAST(user_id AS STRING) AS user_id,
  CASE WHEN event_id % 4 = 0 THEN 'I' ELSE 'User ' || CAST(user_id % 7 AS STRING) END AS subject,
  CASE WHEN event_id % 4 = 0 THEN 'i' ELSE 'user ' || CAST(user_id % 7 AS STRING) END AS subject_key,
  CASE WHEN event_id % 53 = 0 THEN 'name' WHEN event_id % 3 = 0 THEN 'works at' WHEN event_id % 3 = 1 THEN 'likes' ELSE 'cities' END AS relation,
  CASE WHEN event_id % 53 = 0 THEN 'name' WHEN event_id % 3 = 0 THEN 'work' WHEN event_id % 3 = 1 THEN 'like' ELSE 'city' END AS relation_key,
  event_type AS object, event_type AS object_key,
  CASE WHEN event_id % 5 = 0 THEN 'I know my ' || event_type ELSE 'It is My ' || event_type END AS statement,
  'Memory fact' || chr(10) || 'Statement: I''s ' || event_type || chr(10) || 'Source quotation: my own ' || CAST(event_id % 40 AS STRING) AS content,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 1700000000000 + (event_id * 7919 % 2592000) * 1000 END AS event_time,
  '2023-11-' || CAST(14 + event_id % 9 AS STRING) AS source_date, event_id % 10 = 0 AS supersedes, 'facts-v1' AS version
FROM {events}
"""
PARENTS = "SELECT DISTINCT 'b' || CAST(user_id * 10 + event_id % 10 AS STRING) AS id, 'u' || CAST(user_id AS STRING) AS user_id FROM {events} WHERE event_id % 10 < 9"
OBSERVATIONS = """
SELECT event_id, value AS latency_ms, CASE WHEN event_id % 3 = 0 THEN value * 2 END AS router_latency_ms, CASE WHEN event_id % 5 = 0 THEN value / 4 END AS multi_hop_latency_ms,
  event_id % 7 AS rerank_candidates, event_id % 3 AS neighbors_added, event_id % 11 = 0 AS truncated_by_top_k,
  CASE WHEN event_id % 2 = 0 THEN 'DEFAULT' ELSE 'MULTI_HOP' END AS route, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS stop_reason,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'ok' END AS fact_status
FROM {events}
"""
SENTENCES = """
SELECT event_id, '2024-03-' || CAST(10 + event_id % 20 AS STRING) AS day, CASE event_id % 8
  WHEN 0 THEN 'I went there yesterday with ' WHEN 1 THEN 'We met last night after ' WHEN 2 THEN 'This morning, Today and tonight: '
  WHEN 3 THEN 'It was the other day that ' WHEN 4 THEN 'See you TOMORROW at ' WHEN 5 THEN 'We moved last year for ' WHEN 6 THEN 'the board member and a member of '
  ELSE 'nothing relative in ' END || event_type AS text
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """The SQL over the driver's tables that it names and the frames given."""
    import re

    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: frames[n] if n in frames else table(spark, sf_dir, n) for n in names})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MESSAGES)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as add requests."""
    rows = F.sort_array(F.collect_list(F.struct("source_index", "role", "content", "timestamp")))
    bare = F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["timestamp"].alias("timestamp")))
    return messages(spark, sf_dir).groupBy("request_id", "user_id", "session_id").agg(bare.alias("messages")).withColumn("received_seq", F.lit(0).cast("long"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.compose_blocks(ingest.messages_of(requests(spark, sf_dir)))
