"""Registered queries of the memory operators and their DuckDB twins."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import dates
from mnemospark.functions import helpers as H
from mnemospark.functions import text as T
from mnemospark.operators import embed, facts, ingest, metrics, multihop, rank, retrieval, search, tables
from mnemospark.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NAMES = {t: t for t in _TABLES}

# ---------------------------------------------------------------- shared pieces of the DuckDB side

_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORD = r"\p{L}\p{N}\p{M}_"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{_WORD}]+')"


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[{_WORD}]+|[^{_WORD}{_SPACE[1:-1]}]'))"


def _sha(*parts: str) -> str:
    return "sha256(" + " || ".join(f"len({p}) || ':' || {p}" for p in parts) + ")"


_DAY = "coalesce(strftime(make_timestamp({0} * 1000), '%Y-%m-%d'), '')"
_RENDER = _strip("concat_ws(chr(10), CASE WHEN question <> '' THEN 'Q: ' || question END, CASE WHEN answer <> '' THEN 'A: ' || answer END)")

_M = f"m AS (SELECT * REPLACE ({_strip('content')} AS content) FROM ({V.MESSAGES.format(**_NAMES)}))"
_R = f"""{_M},
r1 AS (SELECT *, CASE WHEN coalesce(lag(role) OVER w <> role, TRUE) THEN 1 ELSE 0 END AS s FROM m WINDOW w AS (PARTITION BY request_id ORDER BY source_index)),
r2 AS (SELECT *, sum(s) OVER w - 1 AS run, sum(CASE WHEN s = 1 AND role = 'user' THEN 1 ELSE 0 END) OVER w AS asked FROM r1 WINDOW w AS (PARTITION BY request_id ORDER BY source_index))"""
_B = f"""{_R},
r3 AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY request_id ORDER BY asked, CASE WHEN asked = 0 THEN run ELSE 0 END) - 1 AS VARCHAR) AS li FROM r2),
r4 AS (SELECT *, {_sha('user_id', 'session_id', 'request_id', 'li')} AS parent_memory_id FROM r3),
b1 AS (SELECT parent_memory_id AS id, user_id, session_id, request_id, CAST(li AS INT) AS local_index,
    nullif(string_agg(content, chr(10) ORDER BY source_index) FILTER (role = 'user'), '') AS question,
    nullif(string_agg(CASE WHEN content <> '' THEN '[' || role || '] ' || content ELSE '[' || role || ']' END, chr(10) ORDER BY source_index) FILTER (role <> 'user'), '') AS answer,
    list(timestamp ORDER BY source_index)[1] AS event_time
  FROM r4 GROUP BY ALL),
b2 AS (SELECT *, question IS NOT NULL AND answer IS NOT NULL AS paired FROM b1),
b AS (SELECT id, user_id, session_id, request_id, local_index, CASE WHEN paired THEN lag(id) OVER w END AS prev_memory_id, CASE WHEN paired THEN lead(id) OVER w END AS next_memory_id,
    question, answer, 'complete' AS status, event_time FROM b2 WINDOW w AS (PARTITION BY request_id, paired ORDER BY local_index))"""
_J = f"""{_M}, j AS (SELECT request_id, user_id, session_id, '{{"messages":[' || string_agg('{{"content":' || to_json(content) || ',"role":' || to_json(role) || ',"timestamp":' || coalesce(CAST(timestamp AS VARCHAR), 'null') || '}}', ',' ORDER BY source_index)
  || '],"session_id":' || to_json(session_id) || ',"user_id":' || to_json(user_id) || '}}' AS body FROM m GROUP BY request_id, user_id, session_id), h AS (SELECT request_id, user_id, session_id, sha256(body) AS payload_hash FROM j)"""
_C = f"{_B}, c AS ({V.CANDIDATES.format(blocks='b')})"
_F = f"WITH f AS ({V.FACTS.format(**_NAMES)}), p AS ({V.PARENTS.format(**_NAMES)})"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table written once and read back, as blocks are when they are searched."""
    path = _folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- sources, tables


@_query(f"WITH {_M} SELECT request_id, user_id, session_id, count(*) AS n_messages, count(timestamp) AS n_times FROM m GROUP BY ALL")
def q01_read_requests(spark, sf_dir):
    """Requests written as JSON and read with the fixed schema."""
    from mnemospark.sources.requests import read_requests

    path = _folder(spark, "requests")
    V.requests(spark, sf_dir).write.json(path)
    times = F.size(F.filter("messages", lambda m: m["timestamp"].isNotNull())).cast("long")
    return read_requests(spark, path).select("request_id", "user_id", "session_id", F.size("messages").cast("long").alias("n_messages"), times.alias("n_times"))


@_query(f"""WITH {_M}, v AS (SELECT request_id, CAST(substr(session_id, 2) AS BIGINT) AS n, count(*) AS k FROM m GROUP BY ALL)
SELECT request_id, CASE WHEN n % 10 = 0 THEN 'user_id' WHEN n % 9 = 0 THEN 'messages' WHEN n % 8 = 0 THEN 'role' WHEN n % 7 = 0 THEN 'content' END AS reason FROM v""")
def q02_validate_requests(spark, sf_dir):
    n = F.expr("CAST(substr(session_id, 2) AS BIGINT)")
    bad = V.requests(spark, sf_dir).withColumns({
        "user_id": F.when(n % 10 == 0, "").otherwise(F.col("user_id")),
        "messages": F.when(n % 9 == 0, F.slice("messages", 1, 0)).otherwise(F.transform("messages", lambda m: F.struct(
            F.when(n % 8 == 0, "").otherwise(m["role"]).alias("role"), F.when(n % 7 == 0, " 　\x1f").otherwise(m["content"]).alias("content"), m["timestamp"].alias("timestamp")))),
    })
    valid, rejected = ingest.validate_requests(bad)
    return valid.select("request_id", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("request_id", "reason"))


_UPSERT = "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0"


def _upserted(spark, sf_dir, mode):
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    incoming = c.where("k % 2 = 0").withColumn("v", F.col("v") + 1)
    incoming = incoming.unionByName(incoming.where("k % 4 = 0").withColumn("v", F.col("v") + 1))
    return tables.upsert(c.where("k % 3 <> 0"), incoming, ["k"], mode)


@_query(f"{_UPSERT} UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def q03_upsert_ignore(spark, sf_dir):
    return _upserted(spark, sf_dir, "ignore")


@_query(f"{_UPSERT} AND c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END FROM customer WHERE c_custkey % 2 = 0")
def q03_upsert_replace(spark, sf_dir):
    return _upserted(spark, sf_dir, "replace")


def _stored_orders(spark, sf_dir):
    """Orders as a table of three commits, and changes of some of them."""
    from mnemospark.streaming.tables import Tables

    t = Tables(_folder(spark, "orders"), {"orders": ("k", 16)})
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    for i in range(3):
        t.commit(spark, f"load-{i}", {"orders": o.where(F.col("k") % 3 == i)})
    return t, o.where("k % 16 = 5").withColumn("v", F.col("v") + 1).unionByName(o.where("k % 16 = 5").withColumns({"k": -F.col("k"), "v": F.lit(None).cast("double")}))


_ORDERS = "SELECT o_orderkey AS k, o_totalprice AS v FROM orders"


@_query(f"""{_ORDERS} WHERE o_orderkey % 16 <> 5 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 16 = 5
UNION ALL SELECT -o_orderkey, NULL FROM orders WHERE o_orderkey % 16 = 5""")
def q03_merge_table(spark, sf_dir):
    """Changed and new rows merged into a stored table; only folders with a changed key are written anew."""
    t, changes = _stored_orders(spark, sf_dir)
    t.merge(spark, "orders", "change-0", changes, ["k"], "k bigint, v double")
    return t.read(spark, "orders", "k bigint, v double")


@_query(f"{_ORDERS} UNION ALL SELECT -o_orderkey, NULL FROM orders WHERE o_orderkey % 16 = 5")
def q08_compacted_table(spark, sf_dir):
    """A table of several commits after an insert and a compaction."""
    t, changes = _stored_orders(spark, sf_dir)
    t.merge(spark, "orders", "change-0", changes, ["k"], "k bigint, v double", "ignore")
    t.compact(spark, "orders", "k bigint, v double", most=1)
    return t.read(spark, "orders", "k bigint, v double")


@_query(f"WITH {_B} SELECT id, 'x' || id AS old_id, local_index, prev_memory_id, next_memory_id FROM b")
def q04_rekey_blocks(spark, sf_dir):
    legacy = V.blocks(spark, sf_dir).withColumns({"id": F.concat(F.lit("x"), "id"), "prev_memory_id": F.lit("old"), "next_memory_id": F.lit(None).cast("string")})
    return ingest.rekey_blocks(legacy).select("id", "old_id", "local_index", "prev_memory_id", "next_memory_id")


@_query(f"WITH {_B} SELECT id, request_id, local_index FROM b")
def q05_read_blocks(spark, sf_dir):
    return tables.read_blocks(V.blocks(spark, sf_dir)).select("id", "request_id", "local_index")


@_query(f"""WITH {_B}, l AS (SELECT user_id, list_append(list(id ORDER BY id DESC), 'unknown') AS ids FROM b WHERE local_index = 0 GROUP BY user_id)
SELECT x.user_id AS list_of, x.position, b.id, b.question FROM (SELECT user_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS position FROM l) x JOIN b USING (id)""")
def q06_fetch_by_ids(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    lists = blocks.where("local_index = 0").groupBy(F.col("user_id").alias("list_of")).agg(F.concat(F.sort_array(F.collect_list("id"), False), F.array(F.lit("unknown"))).alias("ids"))
    return tables.fetch_by_ids(blocks, lists).select("list_of", F.col("position").cast("long").alias("position"), "id", "question")


@_query(f"""WITH {_B}, l AS (SELECT user_id, list_append(list(id ORDER BY id DESC), 'unknown') AS ids FROM b WHERE local_index = 0 GROUP BY user_id)
SELECT x.user_id AS list_of, x.position, b.id, b.question FROM (SELECT user_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS position FROM l) x JOIN b USING (id)""")
def q06_fetch_from_folders(spark, sf_dir):
    """The same lists looked up in stored blocks, in the folders of their users only."""
    path, blocks = _folder(spark, "blocks"), V.blocks(spark, sf_dir)
    tables.write_table(blocks, path, buckets=16)
    lists = blocks.where("local_index = 0").groupBy(F.col("user_id").alias("list_of")).agg(F.concat(F.sort_array(F.collect_list("id"), False), F.array(F.lit("unknown"))).alias("ids"))
    return tables.fetch_by_ids(spark.read.parquet(path), lists, user_col="list_of", buckets=16).select("list_of", F.col("position").cast("long").alias("position"), "id", "question")


@_query(f"WITH {_B} SELECT user_id, count(*) AS n FROM b GROUP BY user_id")
def q07_index_count(spark, sf_dir):
    return tables.index_count(V.blocks(spark, sf_dir), per_user=True)


@_query(f"WITH {_B} SELECT * FROM b")
def q08_write_tables(spark, sf_dir):
    """Blocks written in folders by user bucket and read back."""
    path, blocks = _folder(spark, "blocks"), V.blocks(spark, sf_dir)
    tables.write_table(blocks, path, buckets=8)
    return spark.read.parquet(path).select(*blocks.columns)


# ---------------------------------------------------------------- add


@_query(f"WITH {_J} SELECT * FROM h")
def q09_payload_fingerprint(spark, sf_dir):
    return ingest.payload_fingerprint(V.requests(spark, sf_dir)).select("request_id", "user_id", "session_id", "payload_hash")


def _incoming(spark, sf_dir):
    """Requests, some of them again, some of them again and altered."""
    r, n = V.requests(spark, sf_dir), F.expr("CAST(substr(session_id, 2) AS BIGINT)")
    again = r.where(n % 7 == 0).withColumn("received_seq", F.lit(1).cast("long"))
    other = r.where(n % 11 == 0).withColumns({"received_seq": F.lit(2).cast("long"), "session_id": F.concat("session_id", F.lit("x"))})
    return r, ingest.payload_fingerprint(r.unionByName(again).unionByName(other))


def _resolved(spark, sf_dir):
    r, incoming = _incoming(spark, sf_dir)
    n = F.expr("CAST(substr(session_id, 2) AS BIGINT)")
    applied = ingest.payload_fingerprint(r.where(n % 3 == 0)).withColumn("payload_hash", F.when(n % 6 != 0, F.col("payload_hash")))
    return ingest.resolve_batches(incoming, applied.select("request_id", "payload_hash"))


_RESOLVED = f"""WITH {_J}, k AS (SELECT request_id, payload_hash, CAST(substr(session_id, 2) AS BIGINT) AS n FROM h),
i AS (SELECT request_id, n, 0 AS received_seq, FALSE AS altered FROM k UNION ALL SELECT request_id, n, 1, FALSE FROM k WHERE n % 7 = 0 UNION ALL SELECT request_id, n, 2, TRUE FROM k WHERE n % 11 = 0),
o AS (SELECT request_id, received_seq, CASE WHEN n % 3 <> 0 AND received_seq = 0 THEN 'new' WHEN n % 6 = 0 OR NOT altered THEN 'replay' ELSE 'conflict' END AS outcome FROM i)"""


@_query(f"{_RESOLVED} SELECT * FROM o")
def q10_resolve_batches(spark, sf_dir):
    return _resolved(spark, sf_dir).select("request_id", "received_seq", "outcome")


@_query(f"{_RESOLVED} SELECT * FROM o")
def q10_stored_registry(spark, sf_dir):
    """The same outcomes from a stored registry, of which the filters leave only what can hold one of the requests."""
    from mnemospark.operators import membership
    from mnemospark.streaming.jobs import known_requests
    from mnemospark.streaming.tables import Tables

    r, incoming = _incoming(spark, sf_dir)
    n, t = F.expr("CAST(substr(session_id, 2) AS BIGINT)"), Tables(_folder(spark, "registry"))
    known = ingest.payload_fingerprint(r.where(n % 3 == 0)).withColumn("payload_hash", F.when(n % 6 != 0, F.col("payload_hash")))
    known = known.select("request_id", "user_id", "session_id", "payload_hash", F.lit(0).cast("long").alias("applied_at"))
    t.commit(spark, "load-0", {"applied": known, "applied_filter": membership.filter_of(t.bucketed("applied", known), "request_id", 1)})
    incoming = _stored(incoming, "incoming")
    return ingest.resolve_batches(incoming, known_requests(spark, t, incoming)).select("request_id", "received_seq", "outcome")


@_query(f"{_RESOLVED} SELECT h.request_id, h.user_id, h.session_id, h.payload_hash, 5 AS applied_at FROM o JOIN h USING (request_id) WHERE outcome = 'new'")
def q11_record_batches(spark, sf_dir):
    return ingest.record_batches(_resolved(spark, sf_dir), 5)


@_query(f"WITH {_R} SELECT request_id, CAST(run AS BIGINT) AS run, role, min(source_index) AS first_index, max(source_index) AS last_index, count(*) AS n_messages, string_agg(content, chr(10) ORDER BY source_index) AS text FROM r2 GROUP BY request_id, run, role")
def q12_role_runs(spark, sf_dir):
    return ingest.role_runs(ingest.messages_of(V.requests(spark, sf_dir)))


@_query(f"WITH {_B} SELECT * FROM b")
def q13_compose_blocks(spark, sf_dir):
    """Blocks, their fields, links and ids."""
    return V.blocks(spark, sf_dir)


@_query(f"WITH {_B} SELECT id, substr(id, 1, 8) || '-' || substr(id, 9, 4) || '-' || substr(id, 13, 4) || '-' || substr(id, 17, 4) || '-' || substr(id, 21, 12) AS point_id FROM b")
def q16_point_ids(spark, sf_dir):
    return V.blocks(spark, sf_dir).select("id", T.point_id(F.col("id")).alias("point_id"))


@_query(f"""WITH {_B}, x AS (SELECT *, CAST(source_index AS VARCHAR) AS si FROM r4)
SELECT parent_memory_id, source_index, role, content, timestamp, sha256('14:source-message' || len(parent_memory_id) || ':' || parent_memory_id || len(si) || ':' || si) AS id FROM x""")
def q17_explode_messages(spark, sf_dir):
    return ingest.explode_messages(ingest.messages_of(V.requests(spark, sf_dir)))


# ---------------------------------------------------------------- texts


@_query(f"WITH {_B}, t AS (SELECT id, {_RENDER} AS text, {_DAY.format('event_time')} AS day FROM b) SELECT id, day, text, CASE WHEN text <> '' AND day <> '' THEN '[' || day || '] ' || text ELSE text END AS dated FROM t")
def q18_render_pair(spark, sf_dir):
    day = T.event_day(F.col("event_time"))
    q, a = F.col("question"), F.col("answer")
    return V.blocks(spark, sf_dir).select("id", day.alias("day"), T.render(q, a).alias("text"), T.render(q, a, day).alias("dated"))


def _fixed_dates() -> str:
    out, day = "text", "CAST(day AS DATE) + ({0})"
    for words, offset in ((r"yesterday", -1), (r"last night", -1), (r"this morning", 0), (r"today", 0), (r"tonight", 0), (r"the other day", -2), (r"tomorrow", 1)):
        out = f"regexp_replace({out}, '(?i)\\b({words})\\b', '\\1 (' || strftime({day.format(offset)}, '%B %-d, %Y') || ')', 'g')"
    out = f"regexp_replace({out}, '(?i)\\b(last year)\\b', '\\1 (' || (year(CAST(day AS DATE)) - 1) || ')', 'g')"
    return f"SELECT event_id, {out} AS text FROM ({V.SENTENCES.format(**_NAMES)})"


@_query(_fixed_dates())
def q20_relative_dates(spark, sf_dir):
    s = V.view(spark, sf_dir, V.SENTENCES)
    return s.select("event_id", dates.annotate_relative_dates(F.col("text"), F.col("day")).alias("text"))


_SALES = "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS STRING) AS q, CAST(floor(l_extendedprice) AS BIGINT) % 90000 + 1 AS cents FROM {lineitem}"
_NOTED = "CAST(cents * CAST(q AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(cents * CAST(q AS BIGINT) % 100 AS VARCHAR), 2, '0')"


@_query(f"""WITH s AS (SELECT *, CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS p FROM ({_SALES.format(**_NAMES)}))
SELECT l_orderkey, l_linenumber, '{{"record_kind":"reported sale","user_quotation":"I sold ' || q || ' boxes for $' || p || ' each (calculated sale total: ' || q || ' × $' || p || ' = $' || regexp_replace({_NOTED}, '[.]?0+$', '') || ') today","quantity":"' || q || '","unit_price":"' || p || '","currency_symbol":"$"}}' AS content FROM s""")
def q21_unit_totals(spark, sf_dir):
    """Sales of lineitem as JSON records with their exact totals noted."""
    cents = F.col("cents")
    sales = V.view(spark, sf_dir, _SALES).repartition("l_orderkey", "l_linenumber")  # few bytes and much work a row: all cores, however few the files
    sale = sales.withColumn("p", F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
    quote = F.concat(F.lit("I sold "), "q", F.lit(" boxes for $"), "p", F.lit(" each today"))
    record = F.to_json(F.struct(F.lit("reported sale").alias("record_kind"), quote.alias("user_quotation"), F.col("q").alias("quantity"), F.col("p").alias("unit_price"), F.lit("$").alias("currency_symbol")))
    sale = sale.select("l_orderkey", "l_linenumber", record.alias("content"))  # a column of its own, so that it is made once
    return sale.select("l_orderkey", "l_linenumber", H.annotate_unit_totals(F.col("content")).alias("content"))


@_query("SELECT doc_id, CAST(" + _tokens("text") + " AS BIGINT) AS n_tokens FROM documents")
def q22_token_count(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


_PIECES = f"regexp_extract_all(text, '{_SPACE}+|[{_WORD}]+|[^{_WORD}{_SPACE[1:-1]}]')"


@_query(f"""SELECT doc_id, CASE WHEN len(p) > 400 THEN array_to_string(p[1:189], '') || chr(10) || '...' || chr(10) || array_to_string(p[len(p) - 189 :], '') ELSE text END AS middle,
  array_to_string(p[1:100], '') AS head FROM (SELECT doc_id, text, {_PIECES} AS p FROM documents)""")
def q23_truncate(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", H.truncate_middle(F.col("text"), 400).alias("middle"), H.truncate_head(F.col("text"), 100).alias("head"))


@_query("SELECT item_id, 'Instruct: find memories' || chr(10) || 'Query: ' || text AS dense_query, text AS lexical_query FROM benchmark")
def q24_query_instruction(spark, sf_dir):
    b, q = V.table(spark, sf_dir, "benchmark"), F.col("text")
    return b.select("item_id", T.query_instruction(q, "find memories").alias("dense_query"), T.query_instruction(q, "").alias("lexical_query"))


@_query(f"""{_F} SELECT id, 'Memory fact' || chr(10) || 'Statement: ' || statement || chr(10) || 'Source record date: ' || source_date || CASE WHEN supersedes THEN '' ELSE chr(10) || 'Source quotation: ' || object END AS evidence,
  '{{"source_id":' || to_json(id) || ',"source_record_date":' || to_json(source_date) || ',"user_quotation":' || to_json(statement) || ',"kind":' || to_json(object) || '}}' AS record FROM f""")
def q25_render_evidence(spark, sf_dir):
    f, c = V.view(spark, sf_dir, V.FACTS), F.col
    return f.select("id", T.render_evidence(c("statement"), c("source_date"), c("object"), c("supersedes")).alias("evidence"), T.render_record_evidence(c("id"), c("source_date"), c("statement"), kind=c("object")).alias("record"))


# ---------------------------------------------------------------- embeddings


def _toy_vectors(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for an embedder: lengths of the text in characters and bytes, and its first code point."""
    return [[float(len(t)), float(len(t.encode())), float(ord(t[0])) if t else 0.0] for t in texts]


def _cache(spark, sf_dir):
    known = ingest.messages_of(V.requests(spark, sf_dir)).where("char_length(content) % 3 = 0").select("content").distinct()
    one = F.array(*[F.lit(x).cast("float") for x in (1, 2, 3)])
    return known.select(F.lit("c").alias("coordinate"), embed.content_hash(F.col("content")).alias("content_hash"), F.lit(3).alias("dim"), one.alias("vec"), F.lit(0).cast("long").alias("created_at"))


@_query(f"""WITH {_M} SELECT substr(sha256('{{"dim":3,"model":"toy","template":"v1"}}'), 1, 16) AS coordinate, '3' AS dims, count(DISTINCT content) AS n FROM m""")
def q26_embedding_coordinate(spark, sf_dir):
    """New cache rows under their coordinate, and the dimensions in use."""
    texts = ingest.messages_of(V.requests(spark, sf_dir)).select(F.col("content").alias("text"))
    new = embed.embed_missing(texts, _cache(spark, sf_dir), _toy_vectors, embed.embedding_coordinate("toy", embed.template_version(False), 3))[1]
    return embed.dimension_report(new).withColumn("dims", F.array_join("dims", ","))


@_query(f"WITH {_M} SELECT request_id, source_index, CASE WHEN len(content) % 3 = 0 THEN 1 ELSE len(content) END AS a, CASE WHEN len(content) % 3 = 0 THEN 2 ELSE strlen(content) END AS b FROM m")
def q27_embed_missing(spark, sf_dir):
    texts = ingest.messages_of(V.requests(spark, sf_dir)).select("request_id", "source_index", F.col("content").alias("text"))
    got, _ = embed.embed_missing(texts, _cache(spark, sf_dir), _toy_vectors, "c")
    return got.select("request_id", "source_index", F.get("vec", F.lit(0)).cast("long").alias("a"), F.get("vec", F.lit(1)).cast("long").alias("b"))


@_query(f"WITH {_M} SELECT sha256(content) AS content_hash FROM m WHERE len(content) % 3 <> 0 GROUP BY ALL")
def q27_embedding_cache_rows(spark, sf_dir):
    texts = ingest.messages_of(V.requests(spark, sf_dir)).select(F.col("content").alias("text"))
    return embed.embed_missing(texts, _cache(spark, sf_dir), _toy_vectors, "c")[1].select("content_hash")


@_query("SELECT vec_id, len(embedding) = 64 AND vec_id % 10 <> 0 AS good FROM embeddings")
def q28_check_dimensions(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vec"))
    good, bad = embed.check_dimensions(e, 64)
    return good.select("vec_id", F.lit(True).alias("good")).unionByName(bad.select("vec_id", F.lit(False).alias("good")))


@_query(f"WITH {_B}, t AS (SELECT id AS memory_id, user_id, {_RENDER} AS text FROM b) SELECT memory_id, user_id, CAST(len({_terms('text')}) AS BIGINT) AS n_terms, len(text) AS a FROM t WHERE text <> ''")
def q29_build_index(spark, sf_dir):
    empty = _cache(spark, sf_dir).limit(0)
    index, _ = embed.build_index(V.blocks(spark, sf_dir), empty, _toy_vectors, embed.embedding_coordinate("toy", "v1", 3))
    return index.select("memory_id", "user_id", F.size("terms").cast("long").alias("n_terms"), F.get("dense", F.lit(0)).cast("long").alias("a"))


# ---------------------------------------------------------------- retrieval

_BM25 = f"""d AS ({V.MEMORIES.format(**_NAMES)}), q AS ({V.QUERIES.format(**_NAMES)}),
t AS (SELECT memory_id, user_id, unnest({_terms('text')}) AS term FROM d),
tf AS (SELECT memory_id, user_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT memory_id, user_id, count(*) AS len FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
g AS (SELECT count(*) AS n, avg(len) AS mean FROM dl),
qt AS (SELECT DISTINCT query_id, user_id, unnest({_terms('query')}) AS term FROM q),
ls AS (SELECT query_id, qt.user_id, tf.memory_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM qt JOIN df ON df.term = qt.term JOIN tf ON tf.term = qt.term AND tf.user_id = qt.user_id JOIN dl ON dl.memory_id = tf.memory_id AND dl.user_id = tf.user_id, g GROUP BY query_id, qt.user_id, tf.memory_id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM ls QUALIFY rank < 200)"""
_DENSE = f"""qv AS ({V.QUERY_VECTORS.format(**_NAMES)}), iv AS ({V.VECTORS.format(**_NAMES)}),
dn AS (SELECT query_id, user_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM
  (SELECT query_id, qv.user_id, memory_id, round(list_cosine_similarity(CAST(qv.dense AS DOUBLE[]), CAST(iv.dense AS DOUBLE[])), 6) AS score FROM qv JOIN iv USING (user_id)) QUALIFY rank < 200)"""
_RRF = """fs AS (SELECT query_id, memory_id, CAST(round(sum(CAST(CAST(0.5 AS DOUBLE) / (rank + 61) AS DECIMAL(20, 12))), 10) AS DOUBLE) AS score FROM
  (SELECT query_id, memory_id, rank FROM lex UNION ALL SELECT query_id, memory_id, rank FROM dn) GROUP BY ALL),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM fs QUALIFY rank < 400)"""


def _lexical(spark, sf_dir):
    return retrieval.bm25_topk(V.view(spark, sf_dir, V.QUERIES), retrieval.bm25_index(V.view(spark, sf_dir, V.MEMORIES), save=_stored))


def _dense(spark, sf_dir):
    return retrieval.dense_topk(V.view(spark, sf_dir, V.QUERY_VECTORS), V.view(spark, sf_dir, V.VECTORS))


def _arms(spark, sf_dir):
    return [_lexical(spark, sf_dir), _dense(spark, sf_dir)]


@_query(f"WITH {_BM25} SELECT * FROM lex")
def q30_bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir)


@_query(f"WITH {_BM25} SELECT * FROM lex")
def q30_block_topk(spark, sf_dir):
    """The same answers from postings in blocks with maxima, of which only those are opened that can matter."""
    index = retrieval.block_index(retrieval.bm25_index(V.view(spark, sf_dir, V.MEMORIES), save=_stored), _stored)
    return retrieval.bm25_topk(V.view(spark, sf_dir, V.QUERIES), index)


@_query(f"WITH {_DENSE} SELECT * FROM dn")
def q31_dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir)


@_query(f"WITH {_BM25}, {_DENSE}, {_RRF} SELECT * FROM fu")
def q32_rrf_fuse(spark, sf_dir):
    return retrieval.rrf_fuse(_arms(spark, sf_dir))


_LISTS = """ar AS (SELECT query_id, coalesce(array_to_string(list(memory_id ORDER BY rank) FILTER (arm = 0), ','), '') AS lexical, coalesce(array_to_string(list(memory_id ORDER BY rank) FILTER (arm = 1), ','), '') AS dense
  FROM (SELECT query_id, memory_id, rank, 0 AS arm FROM lex UNION ALL SELECT query_id, memory_id, rank, 1 FROM dn) WHERE rank < 10 GROUP BY query_id)"""


@_query(f"WITH {_BM25}, {_DENSE}, {_LISTS} SELECT * FROM ar")
def q33_arm_rankings(spark, sf_dir):
    r = retrieval.arm_rankings(*_arms(spark, sf_dir), n=10)
    return r.select("query_id", F.array_join("lexical", ",").alias("lexical"), F.array_join("dense", ",").alias("dense"))


@_query(f"WITH {_BM25}, {_DENSE}, {_RRF} SELECT fu.query_id, fu.memory_id, fu.score, fu.rank, qv.user_id FROM fu JOIN qv USING (query_id) WHERE rank < qv.top_k")
def q34_hybrid_search(spark, sf_dir):
    return retrieval.hybrid_search(V.view(spark, sf_dir, V.QUERY_VECTORS), retrieval.bm25_index(V.view(spark, sf_dir, V.MEMORIES), save=_stored), V.view(spark, sf_dir, V.VECTORS))


@_query(f"WITH {_C}, x AS (SELECT query_id, memory_id, min(rank) AS a_ FROM (SELECT query_id, memory_id, rank * 2 AS rank FROM c UNION ALL SELECT query_id, memory_id, 9 - rank FROM c WHERE rank < 9) GROUP BY ALL) SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY a_, memory_id) - 1 AS rank FROM x")
def q35_dedup_candidates(spark, sf_dir):
    c = V.view(spark, sf_dir, V.CANDIDATES, blocks=V.blocks(spark, sf_dir))
    twice = c.withColumn("rank", F.col("rank") * 2).unionByName(c.where("rank < 9").withColumn("rank", 9 - F.col("rank")))
    return retrieval.dedup_candidates(twice)


_CONSISTENT = f"""WITH {_BM25}, {_DENSE}, x AS (SELECT query_id, coalesce(list(memory_id ORDER BY rank) FILTER (arm = 0), []) AS l, coalesce(list(memory_id ORDER BY rank) FILTER (arm = 1), []) AS d
  FROM (SELECT query_id, memory_id, rank, 0 AS arm FROM lex UNION ALL SELECT query_id, memory_id, rank, 1 FROM dn) GROUP BY query_id),
y AS (SELECT query_id, len(l) > 0 AND len(d) > 0 AND (l[1] = d[1] OR len(list_intersect(l[:5], d[:5])) >= 3 OR list_contains(d[:3], l[1])) AS consistent FROM x)"""


@_query(f"{_CONSISTENT} SELECT query_id, coalesce(consistent, FALSE) AS consistent FROM y")
def q36_rank_consistency(spark, sf_dir):
    return retrieval.rank_consistency(retrieval.arm_rankings(*_arms(spark, sf_dir))).select("query_id", "consistent")


@_query(f"{_CONSISTENT} SELECT round(avg(CASE WHEN coalesce(consistent, FALSE) THEN 0 ELSE 1 END), 6) AS rate FROM y")
def q37_would_trigger_rate(spark, sf_dir):
    return retrieval.would_trigger_rate(q36_rank_consistency(spark, sf_dir))


# ---------------------------------------------------------------- ranking


def _candidates(spark, sf_dir):
    blocks = _stored(V.blocks(spark, sf_dir), "blocks")
    return blocks, V.view(spark, sf_dir, V.CANDIDATES, blocks=blocks)


@_query(f"""WITH {_C}, s AS ({V.RERANK_SCORES.format(candidates='c')})
SELECT c.query_id, c.memory_id, CASE WHEN bad THEN c.rank ELSE row_number() OVER (PARTITION BY c.query_id ORDER BY s.score DESC, c.rank) - 1 END AS rank,
  CASE WHEN bad THEN 'degraded' ELSE 'called' END AS status
FROM (SELECT *, query_id LIKE '%1-0' OR (query_id LIKE '%2-0' AND count(*) OVER (PARTITION BY query_id) > 1) AS bad FROM c) c LEFT JOIN s ON s.query_id = c.query_id AND s.idx = c.rank AND NOT bad""")
def q38_apply_rerank(spark, sf_dir):
    _, c = _candidates(spark, sf_dir)
    return rank.apply_rerank(c, V.view(spark, sf_dir, V.RERANK_SCORES, candidates=c))


_EXPAND = """lk AS (SELECT id AS memory_id, unnest([prev_memory_id, next_memory_id]) AS near FROM b),
h0 AS (SELECT query_id, memory_id, CAST(rank AS BIGINT) AS rank, 0 AS hop FROM c),
h1 AS (SELECT DISTINCT query_id, near AS memory_id, CAST(NULL AS BIGINT) AS rank, 1 AS hop FROM h0 JOIN lk USING (memory_id) WHERE near IS NOT NULL AND rank < 1000 AND NOT EXISTS (SELECT 1 FROM h0 z WHERE z.query_id = h0.query_id AND z.memory_id = near)),
h01 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
h2 AS (SELECT DISTINCT query_id, near AS memory_id, CAST(NULL AS BIGINT) AS rank, 2 AS hop FROM h1 JOIN lk USING (memory_id) WHERE near IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h01 z WHERE z.query_id = h1.query_id AND z.memory_id = near)),
sel AS (SELECT * FROM h01 UNION ALL SELECT * FROM h2)"""


@_query(f"WITH {_C}, {_EXPAND} SELECT query_id, memory_id, rank, hop, FALSE AS missing FROM sel")
def q39_expand_neighbors(spark, sf_dir):
    blocks, c = _candidates(spark, sf_dir)
    return rank.expand_neighbors(c, blocks, save=_stored)


_SEGMENTS = f"""pl AS (SELECT sel.*, b.* EXCLUDE (id), {_RENDER} AS text FROM sel JOIN b ON b.id = sel.memory_id),
jn AS (SELECT *, CASE WHEN coalesce(lag(next_memory_id) OVER w = memory_id, FALSE) THEN 0 ELSE 1 END AS s FROM pl WINDOW w AS (PARTITION BY query_id, request_id ORDER BY local_index)),
rn AS (SELECT *, sum(s) OVER (PARTITION BY query_id, request_id ORDER BY local_index) AS run FROM jn),
sg AS (SELECT query_id, array_to_string(list(memory_id ORDER BY local_index), ',') AS source_memory_ids, user_id, session_id, request_id, min(local_index) AS start_local_index, max(local_index) AS end_local_index,
  list(memory_id ORDER BY coalesce(rank, 1152921504606846976), local_index)[1] AS anchor_memory_id, coalesce(min(rank), 1152921504606846976) AS best_rank,
  list(event_time ORDER BY coalesce(rank, 1152921504606846976), local_index)[1] AS anchor_event_time, {_strip("string_agg(text, chr(10) ORDER BY local_index)")} AS content, count(rank) AS rerank_member_count
  FROM rn GROUP BY query_id, user_id, session_id, request_id, run),
se AS (SELECT *, CAST({_tokens('content')} AS BIGINT) AS token_count FROM sg)"""


def _segments(spark, sf_dir):
    blocks, c = _candidates(spark, sf_dir)
    return rank.merge_segments(_stored(rank.expand_neighbors(c, blocks, save=_stored), "expanded"), blocks)


@_query(f"WITH {_C}, {_EXPAND}, {_SEGMENTS} SELECT * FROM se")
def q40_merge_segments(spark, sf_dir):
    return _segments(spark, sf_dir).withColumn("source_memory_ids", F.array_join("source_memory_ids", ","))


_PACKED = """pk AS (SELECT query_id, row_number() OVER w - 1 AS position, anchor_memory_id AS id, content, {day} AS created_at, token_count, sum(token_count) OVER w AS used FROM se WINDOW w AS (PARTITION BY query_id ORDER BY best_rank, anchor_memory_id)),
it AS (SELECT query_id, position, id, content, created_at, 1 / (position + 1.0) AS score, token_count FROM pk WHERE position < 2 AND used <= 300)""".format(day=_DAY.format("anchor_event_time"))


@_query(f"WITH {_C}, {_EXPAND}, {_SEGMENTS}, {_PACKED} SELECT query_id, position, id, content, created_at, round(CAST(score AS DOUBLE), 6) AS score, token_count FROM it")
def q41_package(spark, sf_dir):
    return rank.package(_segments(spark, sf_dir), 2, 300).withColumn("score", F.round("score", 6))


@_query(f"""WITH {_C}, {_EXPAND}, {_SEGMENTS}, {_PACKED}, g AS (SELECT query_id, count(*) AS n, sum(token_count) AS t FROM it GROUP BY query_id)
SELECT query_id, count(*) AS considered_segments, count(*) > 2 AS truncated_by_top_k, coalesce(max(g.n), 0) < least(count(*), 2) AS truncated_by_budget, CAST(coalesce(max(g.t), 0) AS BIGINT) AS output_tokens FROM se LEFT JOIN g USING (query_id) GROUP BY query_id""")
def q41_package_summary(spark, sf_dir):
    s = _stored(_segments(spark, sf_dir), "segments")
    return rank.package_summary(s, rank.package(s, 2, 300), 2)


# ---------------------------------------------------------------- facts


@_query(f"""WITH {_B}, x AS (SELECT parent_memory_id, source_index, role, content, timestamp FROM r4 JOIN b ON b.id = parent_memory_id WHERE local_index % 2 = 0),
y AS (SELECT id AS parent_memory_id, 0 AS source_index, 'user' AS role, question AS content, event_time AS timestamp FROM b WHERE local_index % 2 = 1 AND question IS NOT NULL
  UNION ALL SELECT id, 1, 'assistant', answer, event_time FROM b WHERE local_index % 2 = 1 AND answer IS NOT NULL)
SELECT *, CASE WHEN role = 'user' THEN 'question' ELSE 'answer' END AS side FROM (SELECT * FROM x UNION ALL SELECT * FROM y)""")
def q42_extraction_records(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    stored = ingest.explode_messages(ingest.messages_of(V.requests(spark, sf_dir)))
    stored = stored.join(blocks.where("local_index % 2 = 0").select(F.col("id").alias("parent_memory_id")), "parent_memory_id", "left_semi")
    return facts.extraction_records(blocks, stored).select("parent_memory_id", "source_index", "role", "content", "timestamp", "side")


LEXICON = [("board member", "work"), ("member", "work"), ("yesterday", "time"), ("met", "social"), ("night", "time"), ("moved", "life"), ("year", "time"), ("purchase", "shop"), ("the other day", "time")]


def _scored(spark, sf_dir):
    s = V.view(spark, sf_dir, V.SENTENCES).select(F.col("event_id").alias("parent_memory_id"), F.lit(0).alias("source_index"), F.col("text").alias("content"))
    return facts.lexicon_score(s, [t for t, _ in LEXICON], 2)


_HITS = " UNION ALL ".join(f"SELECT event_id, '{t}' AS term, '{d}' AS domain FROM s WHERE regexp_matches(lower(text), '(^|[^0-9a-z]){t}([^0-9a-z]|$)')" for t, d in LEXICON)
_HITS = f"WITH s AS ({V.SENTENCES.format(**_NAMES)}), hit AS ({_HITS})"


@_query(f"{_HITS} SELECT s.event_id AS parent_memory_id, coalesce(string_agg(term, ',' ORDER BY term), '') AS terms, count(term) AS n_terms, count(term) >= 2 AS admitted FROM s LEFT JOIN hit USING (event_id) GROUP BY s.event_id")
def q43_lexicon_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("parent_memory_id", F.array_join("terms", ",").alias("terms"), "n_terms", "admitted")


@_query(f"{_HITS} SELECT domain, count(DISTINCT event_id) AS records, count(*) AS hits FROM hit GROUP BY domain")
def q44_domain_profile(spark, sf_dir):
    return facts.domain_profile(_scored(spark, sf_dir), spark.createDataFrame(LEXICON, "term string, domain string"))


def _fact_replies(spark, sf_dir):
    """Records with valid, fenced and broken replies by id."""
    blocks = V.blocks(spark, sf_dir)
    records = facts.extraction_records(blocks, ingest.explode_messages(ingest.messages_of(V.requests(spark, sf_dir))))
    word = F.regexp_extract("content", r"^[^ \t\r\n]+", 0)
    item = F.to_json(F.struct(F.lit("I").alias("subject"), F.lit("works  at").alias("relation"), F.concat(F.lit("place "), F.col("source_index").cast("string")).alias("object"), word.alias("quote"), (F.col("local_index") == 0).alias("supersedes")))
    n = (F.col("local_index") + F.col("source_index")) % 4
    reply = F.when(n == 0, F.concat(F.lit("["), item, F.lit(","), item, F.lit("]"))).when(n == 1, F.concat(F.lit("```json\n["), item, F.lit("]\n```"))).when(n == 2, "null").otherwise(F.concat(F.lit("{"), item))
    return blocks, records.withColumn("reply", reply)


_REPLIED = f"""WITH {_B}, fx AS (SELECT parent_memory_id, user_id, request_id, CAST(li AS INT) AS local_index, source_index, CASE WHEN role = 'user' THEN 'question' ELSE 'answer' END AS side, timestamp,
    regexp_extract(content, '^[^ \\t\\r\\n]+') AS quote, 'place ' || source_index AS object FROM r4 WHERE (CAST(li AS INT) + source_index) % 4 < 2),
fy AS (SELECT *, 'I' AS subject, 'works at' AS relation, local_index = 0 AS supersedes, {_DAY.format('timestamp')} AS day,
  'model:' || source_index || ':' || (row_number() OVER (PARTITION BY request_id ORDER BY local_index, source_index) - 1) || ':works at:' || object AS place FROM fx)"""


@_query(f"{_REPLIED} SELECT parent_memory_id, source_index, 0 AS item, subject, relation, object, quote, supersedes FROM fy")
def q45_parse_fact_replies(spark, sf_dir):
    _, records = _fact_replies(spark, sf_dir)
    return facts.parse_fact_replies(records).select("parent_memory_id", "source_index", "item", "subject", "relation", "object", "quote", "supersedes")


@_query(f"""{_REPLIED} SELECT {_sha("'facts-v1'", 'user_id', 'parent_memory_id', 'side', 'place')} AS id, parent_memory_id, user_id, subject, 'i' AS subject_key, relation, 'work' AS relation_key, object, object AS object_key,
  side AS source_side, quote AS source_quote, 'I — works at — ' || object || '.' AS statement,
  'Memory fact' || chr(10) || 'Statement: I — works at — ' || object || '.' || chr(10) || 'Source record date: ' || day || chr(10) || 'Source quotation: ' || quote AS content,
  timestamp AS event_time, day AS source_date, supersedes, 'facts-v1' AS version FROM fy""")
def q46_make_facts(spark, sf_dir):
    _, records = _fact_replies(spark, sf_dir)
    return facts.make_facts(facts.parse_fact_replies(records)).drop("qualifiers")


@_query("""WITH k AS (SELECT DISTINCT event_type AS v FROM events UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT DISTINCT p_type FROM part)
SELECT v, regexp_replace(lower(v), '^[ ?.!]+|[ ?.!]+$', '', 'g') AS k,
  CASE WHEN lower(v) LIKE '%ies' THEN regexp_replace(lower(v), 'ies$', 'y') WHEN regexp_matches(lower(v), '(ss|sh|ch|x|z)es$') THEN regexp_replace(lower(v), 'es$', '') WHEN regexp_matches(lower(v), '[^s]s$') THEN regexp_replace(lower(v), 's$', '') ELSE lower(v) END AS r FROM k""")
def q47_fact_keys(spark, sf_dir):
    names = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("v"))
    names = names.union(V.table(spark, sf_dir, "customer").select("c_mktsegment")).union(V.table(spark, sf_dir, "part").select("p_type")).distinct()
    return names.select("v", H.fact_key(F.col("v")).alias("k"), H.relation_key(F.col("v")).alias("r"))


def _facts(spark, sf_dir):
    f = V.view(spark, sf_dir, V.FACTS)
    return f.withColumns({"qualifiers": F.create_map(F.lit("supersedes"), F.col("supersedes").cast("string")), "source_side": F.lit("question"), "source_quote": F.col("object")})


@_query(f"""{_F} SELECT id, CASE WHEN p.id IS NULL THEN 'parent' WHEN i % 13 = 0 THEN 'side' WHEN i % 12 = 0 THEN 'quote' WHEN i % 9 = 0 THEN 'item_quote' WHEN i % 8 = 0 THEN 'old' ELSE 'new' END AS outcome
FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS i FROM f) f LEFT JOIN (SELECT id, user_id FROM p) p ON p.id = f.parent_memory_id AND p.user_id = f.user_id""".replace("SELECT id, CASE", "SELECT f.id, CASE"))
def q48_insert_facts(spark, sf_dir):
    i, f = F.expr("CAST(substr(id, 2) AS BIGINT)"), _facts(spark, sf_dir)
    incoming = f.withColumns({
        "source_side": F.when(i % 13 == 0, "neither").otherwise("question"), "source_quote": F.when(i % 12 == 0, "").otherwise("x"),
        "qualifiers": F.when(i % 9 == 0, F.create_map(F.lit("item_quote"), F.lit(""))).otherwise(F.col("qualifiers")),
    })
    good = (i % 13 != 0) & (i % 12 != 0) & (i % 9 != 0)
    parents = V.view(spark, sf_dir, V.PARENTS)
    known = f.join(parents.select(F.col("id").alias("parent_memory_id"), "user_id"), ["parent_memory_id", "user_id"], "left_semi").select(*f.columns)
    existing = known.where(good & (i % 8 == 0)).withColumn("source_quote", F.lit("old"))
    after, rejected = facts.insert_facts(incoming, parents, existing)
    return after.select("id", F.when(F.col("source_quote") == "old", "old").otherwise("new").alias("outcome")).unionByName(rejected.select("id", F.col("reason").alias("outcome")))


@_query(f"WITH {_B} SELECT id FROM b WHERE NOT (local_index = 0 AND CAST(substr(session_id, 2) AS BIGINT) % 2 = 0)")
def q49_unindexed_blocks(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    done = blocks.where("local_index = 0 and CAST(substr(session_id, 2) AS BIGINT) % 2 = 0").select(F.col("id").alias("parent_memory_id"), "user_id", F.lit(facts.VERSION).alias("version"))
    stale = blocks.select(F.col("id").alias("parent_memory_id"), "user_id", F.lit("older").alias("version"))
    return facts.unindexed_blocks(blocks, done.unionByName(stale)).select("id")


@_query(f"{_F} SELECT DISTINCT p.id AS parent_memory_id, 'facts-v1' AS version FROM f JOIN p ON p.id = f.parent_memory_id AND p.user_id = f.user_id")
def q49_mark_coverage(spark, sf_dir):
    empty = spark.createDataFrame([], "parent_memory_id string, user_id string, version string")
    return facts.mark_coverage(empty, _facts(spark, sf_dir), V.view(spark, sf_dir, V.PARENTS)).select("parent_memory_id", "version")


_CURRENT = """cu AS (SELECT user_id, subject_key, relation_key, max(event_time) AS cutoff FROM f WHERE supersedes AND event_time IS NOT NULL GROUP BY ALL),
cr AS (SELECT DISTINCT f.user_id, f.subject_key, f.relation_key, f.object_key FROM f JOIN cu ON cu.user_id = f.user_id AND cu.subject_key = f.subject_key AND cu.relation_key = f.relation_key AND f.event_time = cutoff WHERE supersedes),
now AS (SELECT f.* FROM f LEFT JOIN cu USING (user_id, subject_key, relation_key) LEFT JOIN (SELECT *, TRUE AS cur FROM cr) cr USING (user_id, subject_key, relation_key, object_key)
  WHERE cutoff IS NULL OR event_time IS NULL OR (event_time >= cutoff AND cur))"""


@_query(f"{_F}, {_CURRENT} SELECT id FROM now")
def q50_apply_supersession(spark, sf_dir):
    return facts.apply_supersession(V.view(spark, sf_dir, V.FACTS)).select("id")


_OWNERS = "ow AS (SELECT user_id, list(subject ORDER BY source_date, id)[1] AS owner, list(subject_key ORDER BY source_date, id)[1] AS owner_key FROM f WHERE relation_key = 'name' GROUP BY user_id)"


@_query(f"{_F}, {_OWNERS} SELECT * FROM ow")
def q51_owner_names(spark, sf_dir):
    return facts.owner_names(V.view(spark, sf_dir, V.FACTS))


_ASKED = "SELECT 'q' || CAST(n AS STRING) AS query_id, 'u' || CAST(n AS STRING) AS user_id, n FROM (SELECT DISTINCT user_id AS n FROM {events})"


def _entity_queries(spark, sf_dir):
    q = V.view(spark, sf_dir, _ASKED)
    entities = F.when(F.col("n") % 3 == 0, F.array(F.lit(" User "))).when(F.col("n") % 3 == 1, F.array(F.lit("PURCHASE?"), F.lit("purchase"), F.lit(" "))).otherwise(F.array(F.concat(F.lit("user "), (F.col("n") % 7).cast("string"))))
    return q.select("query_id", "user_id", entities.alias("entities"), F.lit(8).alias("limit"))


_FOUND = f"""qe AS ({_ASKED.format(**_NAMES)}), kk AS (
  SELECT query_id, user_id, unnest(CASE WHEN n % 3 = 0 THEN ['user', 'i', '我'] WHEN n % 3 = 1 THEN ['purchase'] ELSE ['user ' || (n % 7)] END) AS k FROM qe),
gg AS (SELECT DISTINCT query_id, kk.user_id, subject_key, relation_key FROM kk JOIN f ON f.user_id = kk.user_id AND (f.subject_key = k OR f.object_key = k) WHERE EXISTS (SELECT 1 FROM p WHERE p.id = f.parent_memory_id AND p.user_id = f.user_id)),
fo AS (SELECT query_id, now.*, row_number() OVER (PARTITION BY query_id ORDER BY event_time IS NULL, event_time, parent_memory_id, id) AS n FROM gg JOIN now USING (user_id, subject_key, relation_key) QUALIFY n <= 8)"""


def _found(spark, sf_dir):
    return facts.facts_for_entities(_entity_queries(spark, sf_dir), V.view(spark, sf_dir, V.FACTS), V.view(spark, sf_dir, V.PARENTS), save=_stored)


@_query(f"{_F}, {_CURRENT}, {_FOUND} SELECT query_id, id, n FROM fo")
def q52_facts_for_entities(spark, sf_dir):
    return _found(spark, sf_dir).select("query_id", "id", "n")


@_query(f"""{_F}, {_OWNERS} SELECT f.id, CASE WHEN owner IS NOT NULL AND f.subject_key = 'i' THEN owner ELSE subject END AS subject,
  CASE WHEN owner IS NULL THEN statement ELSE regexp_replace(statement, '\\b(My|my)\\b', owner || '''s') END AS statement,
  CASE WHEN owner IS NULL THEN content ELSE replace(content, 'I''s ', owner || '''s ') END AS content FROM f LEFT JOIN ow USING (user_id)""")
def q53_rebind_owner(spark, sf_dir):
    f = V.view(spark, sf_dir, V.FACTS)
    return facts.rebind_owner(f, facts.owner_names(f)).select("id", "subject", "statement", "content")


def _replies(spark, sf_dir, cases: list[str], salt: int = 0) -> DataFrame:
    """benchmark items as queries, each with one of the literal replies by its number; {x} in a reply becomes that number."""
    b = V.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), "item_id", "text")
    pick = F.get(F.array(*[F.lit(c) for c in cases]), F.pmod(F.col("item_id") + salt, F.lit(len(cases))).cast("int"))
    return b.withColumn("reply", F.replace(pick, F.lit("{x}"), F.col("item_id").cast("string")))


ENTITY_CASES = ['["Anna", " anna ", "Board  member {x}"]', '```json\n["x{x}"]\n```', " NULL ", "no list", '[1, "", {}]', 'I think ["a", "b"] fits']


def _by_case(*values: str) -> str:
    """SQL of the value for an item's case; the values are hand-made, in the order of the cases."""
    return f"[{', '.join(values)}][item_id % {len(values)} + 1]"


@_query(f"""SELECT 'q' || item_id AS query_id, {_by_case("'entities'", "'entities'", "'null'", "'invalid'", "'empty'", "'entities'")} AS status,
  {_by_case("'Anna|Board member ' || item_id", "'x' || item_id", "''", "''", "''", "'a|b'")} AS entities FROM benchmark""")
def q54_parse_entities(spark, sf_dir):
    return facts.parse_entities(_replies(spark, sf_dir, ENTITY_CASES)).select("query_id", "status", F.array_join("entities", "|").alias("entities"))


_SNIPPETS = f"""sn AS (SELECT query_id, n, {_strip('content')} AS content, parent_memory_id FROM fo), s1 AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY query_id, lower(regexp_replace(content, '\\s+', ' ', 'g')) ORDER BY n) = 1),
s2 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS position, content, parent_memory_id FROM s1 QUALIFY position < 6)"""


@_query(f"{_F}, {_CURRENT}, {_FOUND}, {_SNIPPETS} SELECT * FROM s2")
def q55_fact_snippets(spark, sf_dir):
    return facts.fact_snippets(_found(spark, sf_dir), 6)


_ITEMS = "SELECT 'q' || CAST(user_id AS STRING) AS query_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS position, 'e' || CAST(event_id AS STRING) AS id, event_type AS content, '' AS created_at, CAST(0.5 AS DOUBLE) AS score FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM {events} GROUP BY user_id, event_type)"


@_query(f"""{_F}, {_CURRENT}, {_FOUND}, {_SNIPPETS}, im AS (SELECT * FROM ({_ITEMS.format(**_NAMES)}) WHERE position < 4), tk AS (SELECT query_id, count(*) AS t FROM im GROUP BY query_id),
ap AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY position) - 1 + coalesce(t, 0) AS at_position, content FROM s2 LEFT JOIN tk USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM im WHERE im.query_id = s2.query_id AND im.content = s2.content))
SELECT * FROM im UNION ALL SELECT query_id, at_position, 'fact:' || at_position, content, '', 0.0 FROM ap WHERE at_position < 6""")
def q56_append_facts(spark, sf_dir):
    items = V.view(spark, sf_dir, _ITEMS).where("position < 4")
    return facts.append_facts(items, facts.fact_snippets(_found(spark, sf_dir), 6), 6)


# ---------------------------------------------------------------- routes and multi-hop

ROUTE_CASES = ["MULTI_HOP", " default\n", "Multi_Hop", "maybe"]


@_query("""WITH x AS (SELECT 'q' || item_id AS query_id, item_id, CASE WHEN item_id % 9 = 0 THEN 'timeout' END AS error, CASE WHEN item_id % 5 = 0 OR item_id % 9 = 0 THEN NULL ELSE item_id % 4 END AS n FROM benchmark)
SELECT query_id, CASE WHEN n IN (0, 2) THEN 'MULTI_HOP' ELSE 'DEFAULT' END AS route, CASE WHEN n < 3 THEN 'success' ELSE 'degraded' END AS route_status,
  CASE WHEN error IS NOT NULL THEN 'llm_' || error WHEN n IS NULL THEN 'model_none' WHEN n = 3 THEN 'invalid_output' END AS reason FROM x""")
def q57_parse_routes(spark, sf_dir):
    r = _replies(spark, sf_dir, ROUTE_CASES)
    failed = F.col("item_id") % 9 == 0
    r = r.withColumns({"error": F.when(failed, "timeout"), "reply": F.when(~failed & (F.col("item_id") % 5 != 0), F.col("reply"))})
    return multihop.parse_routes(r).select("query_id", "route", "route_status", "reason")


OBJECT_CASES = ['{"a": {x}}', 'first {"a": 1} then {"b": "}{", "c": {"d": {x}}} end', "none", '[1, {"a": {x}}]', '{"broken": }']


_FIRST_OBJECT, _LAST_OBJECT, _INNER_OBJECT = ("'{\"a\": ' || item_id || '}'", "'{\"b\": \"}{\", \"c\": {\"d\": ' || item_id || '}}'", "'{\"a\": ' || item_id || '}'")


@_query(f"""SELECT 'q' || item_id AS query_id, {_by_case(_FIRST_OBJECT, _LAST_OBJECT, 'NULL', _INNER_OBJECT, 'NULL')} AS json,
  {_by_case("'direct'", "'recovered'", 'NULL', "'recovered'", 'NULL')} AS extraction FROM benchmark""")
def q58_extract_json_object(spark, sf_dir):
    return multihop.extract_json_object(_replies(spark, sf_dir, OBJECT_CASES)).select("query_id", "json", "extraction")


PLAN_CASES = [
    '{"steps": [{"id": "s1", "query": "who is {x}", "depends_on": []}, {"id": "s2", "query": "where does {{s1}} live", "depends_on": []}]}',
    'plan: {"steps": [{"id": "s1", "query": "one {x}", "depends_on": []}]}',
    '{"steps": [{"id": "s1", "query": "{{s2}}", "depends_on": []}]}',
    '{"steps": []}',
    '{"steps": [{"id": "s1", "query": "a", "depends_on": []}, {"id": "s2", "query": "b", "depends_on": ["s1"]}]}',
]


@_query("""WITH e(c, plan_status, extraction, step_no, id, query, depends_on, repaired, unused) AS (VALUES
  (0, 'valid', 'direct', 0, 's1', 'who is {x}', '', FALSE, ''), (0, 'valid', 'direct', 1, 's2', 'where does {{s1}} live', 's1', TRUE, ''), (1, 'valid', 'recovered', 0, 's1', 'one {x}', '', FALSE, ''),
  (2, 'invalid', NULL, NULL, NULL, NULL, NULL, NULL, NULL), (3, 'invalid', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  (4, 'valid', 'direct', 0, 's1', 'a', '', FALSE, ''), (4, 'valid', 'direct', 1, 's2', 'b', '', TRUE, 's1'))
SELECT 'q' || item_id AS query_id, e.* EXCLUDE (c) REPLACE (replace(query, '{x}', CAST(item_id AS VARCHAR)) AS query) FROM benchmark JOIN e ON item_id % 5 = c""")
def q59_parse_plans(spark, sf_dir):
    p = multihop.parse_plans(_replies(spark, sf_dir, PLAN_CASES))
    return p.withColumns({"depends_on": F.array_join("depends_on", ","), "unused": F.array_join("unused", ",")})


@_query("SELECT 'q' || item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'where is {{s2}} of ' || item_id || ' and {{s9}}' ELSE 'where is {{s2}} of {{s1}} and {{s9}}' END AS executed_query, CASE WHEN item_id % 2 = 0 THEN 's9' ELSE 's1,s9' END AS unbound FROM benchmark")
def q60_bind_placeholders(spark, sf_dir):
    """An answer that looks like a slot stays as it is."""
    b = V.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.lit("where is {{s2}} of {{s1}} and {{s9}}").alias("query"),
        F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("s1"), F.col("item_id").cast("string"), F.lit("s2"), F.lit("{{s2}}"))).otherwise(F.create_map(F.lit("s2"), F.lit("{{s2}}"))).alias("answers"))
    return multihop.bind_placeholders(b).select("query_id", "executed_query", F.array_join("unbound", ",").alias("unbound"))


ANSWER_CASES = [
    '{"status": "answered", "answer": "a{x}", "evidence": [{"document_index": 0, "quote": " the "}, {"document_index": 1, "quote": "zzzz"}]}',
    '{"status": "unresolved", "answer": null, "evidence": []}', 'so {"status": "conflict", "answer": "x", "evidence": []}', '{"status": "answered", "answer": " ", "evidence": []}',
]


_CHECKED = """'[{"document_index":0,"quote":" the ","verified":true},{"document_index":1,"quote":"zzzz","verified":false}]'"""


@_query(f"""SELECT 'q' || item_id AS query_id, item_id % 4 < 3 AS valid, {_by_case("'answered'", "'unresolved'", "'conflict'", 'NULL')} AS status,
  {_by_case("'a' || item_id", 'NULL', "'x'", 'NULL')} AS answer, {_by_case(_CHECKED, "'[]'", "'[]'", "'[]'")} AS evidence, {_by_case("'direct'", "'direct'", "'recovered'", 'NULL')} AS extraction FROM benchmark""")
def q61_parse_step_answers(spark, sf_dir):
    r = _replies(spark, sf_dir, ANSWER_CASES).withColumn("documents", F.array(F.concat(F.lit("the "), "text"), F.col("text")))
    out = multihop.parse_step_answers(r)
    return out.select("query_id", "valid", "status", "answer", F.to_json("evidence").alias("evidence"), "extraction")


DECISION_CASES = [
    '{"is_sufficient": true, "evidence_indices": [0, 0, 2], "new_query": "", "confidence_score": 0.9}', '{"is_sufficient": false, "evidence_indices": [], "new_query": "next {x}", "confidence_score": 0}',
    '{"is_sufficient": true, "evidence_indices": [3], "new_query": "", "confidence_score": 0.9}', '{"is_sufficient": 1, "evidence_indices": [], "new_query": "", "confidence_score": 0.9}',
    '{"is_sufficient": true, "evidence_indices": [], "new_query": "q", "confidence_score": 0.4}',
]


def _decisions(spark, sf_dir):
    return multihop.parse_react_decisions(_replies(spark, sf_dir, DECISION_CASES).withColumn("n_documents", F.lit(3)))


@_query(f"""SELECT 'q' || item_id AS query_id, item_id % 5 NOT IN (2, 3) AS valid, {_by_case('TRUE', 'FALSE', 'NULL', 'NULL', 'TRUE')} AS is_sufficient, {_by_case("'0,2'", "''", "''", "''", "''")} AS evidence_indices,
  {_by_case("''", "'next ' || item_id", 'NULL', 'NULL', "'q'")} AS new_query, CAST({_by_case('0.9', '0', 'NULL', 'NULL', '0.4')} AS DOUBLE) AS confidence_score, CASE WHEN item_id % 5 NOT IN (2, 3) THEN 'direct' END AS extraction FROM benchmark""")
def q62_parse_react_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select("query_id", "valid", "is_sufficient", F.array_join("evidence_indices", ",").alias("evidence_indices"), "new_query", "confidence_score", "extraction")


_ROUNDS = "SELECT 'q' || CAST(user_id AS STRING) AS query_id, CAST(event_id % 3 AS INT) AS round, event_type || CAST(event_id % 50 AS STRING) AS memory_id, CAST(row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) - 1 AS INT) AS position, value FROM {events}"


@_query(f"""WITH r AS ({_ROUNDS.format(**_NAMES)}), x AS (SELECT query_id, memory_id, min(round * 100000 + position) AS a_ FROM r WHERE position < 20 GROUP BY ALL)
SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY a_, memory_id) - 1 AS rank FROM x""")
def q63_round_pool(spark, sf_dir):
    return multihop.round_pool(V.view(spark, sf_dir, _ROUNDS))


@_query(f"""WITH r AS ({_ROUNDS.format(**_NAMES)}), e AS (SELECT query_id, memory_id, min(round * 100000 + position) AS a_ FROM r WHERE position < 3 GROUP BY ALL), j AS (SELECT query_id, string_agg('step ' || round, chr(10) ORDER BY round) AS query FROM (SELECT DISTINCT query_id, round FROM r) GROUP BY query_id)
SELECT query_id, query, evidence FROM (SELECT query_id, string_agg(memory_id, ',' ORDER BY a_, memory_id) AS evidence FROM e GROUP BY query_id) JOIN j USING (query_id)""")
def q63_joint_queries_and_evidence(spark, sf_dir):
    r = V.view(spark, sf_dir, _ROUNDS)
    executed = r.select("query_id", "round").distinct().withColumn("query", F.concat(F.lit("step "), "round"))
    evidence = multihop.cited_evidence(r.where("position < 3").select("query_id", "round", "position", "memory_id"))
    return multihop.joint_queries(executed).join(evidence.withColumn("evidence", F.array_join("evidence", ",")), "query_id")


@_query("""WITH x AS (SELECT event_id, event_id % 5 + 1 AS round, event_id % 3 = 0 AS ok, event_id % 10 / 10.0 AS score, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' Who  is SHE ' ELSE 'new ' || event_id END AS q FROM events)
SELECT event_id, CASE WHEN ok AND score >= 0.8 THEN 'sufficient' WHEN event_id % 4 < 2 AND ok THEN 'low_confidence' WHEN q = '' THEN 'empty_query' WHEN event_id % 4 = 1 THEN 'duplicate_query' WHEN round >= 4 THEN 'max_rounds' END AS stop_reason FROM x""")
def q64_react_stop(spark, sf_dir):
    e, n = V.table(spark, sf_dir, "events"), F.col("event_id")
    d = e.select("event_id", (n % 5 + 1).alias("round"), (n % 3 == 0).alias("is_sufficient"), (n % 10 / 10.0).alias("confidence_score"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, " Who  is SHE ").otherwise(F.concat(F.lit("new "), n.cast("string"))).alias("new_query"), F.array(F.lit("who is she")).alias("used"))
    return multihop.react_stop(d).select("event_id", "stop_reason")


def _plan_runs(spark, sf_dir):
    """Per user: a plan of three steps (five for every eleventh user), some steps going wrong by number."""
    n = F.col("n")
    users = V.view(spark, sf_dir, "SELECT DISTINCT user_id AS n FROM {events}").select("n", F.concat(F.lit("q"), "n").alias("query_id"))
    steps = users.select("*", F.explode(F.sequence(F.lit(0), F.when(n % 11 == 0, 4).otherwise(2))).alias("step_no"))
    at1 = F.col("step_no") == 1
    return steps.select("query_id", F.when(n % 13 == 0, "invalid").otherwise("valid").alias("plan_status"), "step_no",
        F.when(at1 & (n % 5 == 0), F.array(F.lit("s1"))).otherwise(F.array().cast("array<string>")).alias("unbound"), (~(at1 & (n % 7 == 0))).alias("valid"),
        F.when(at1 & (n % 3 == 0), "unresolved").when((F.col("step_no") == 2) & (n % 4 == 0), "conflict").otherwise("answered").alias("status"))


_STOPS = """st AS (SELECT 'q' || n AS query_id, CASE WHEN n % 13 = 0 THEN 'plan_invalid' WHEN n % 5 = 0 THEN 'unbound_placeholder' WHEN n % 7 = 0 THEN 'invalid_output' WHEN n % 3 = 0 THEN 'dependency_unresolved' WHEN n % 4 = 0 THEN 'binding_conflict' WHEN n % 11 = 0 THEN 'max_rounds' ELSE 'plan_complete' END AS stop_reason FROM (SELECT DISTINCT user_id AS n FROM events))"""
_TRIGGERS = "('dependency_unresolved', 'binding_conflict', 'invalid_output', 'llm_unavailable', 'plan_invalid')"


@_query(f"WITH {_STOPS} SELECT * FROM st")
def q65_plan_stop(spark, sf_dir):
    return multihop.plan_stop(_plan_runs(spark, sf_dir))


@_query(f"""WITH {_STOPS}, r AS ({_ROUNDS.format(**_NAMES)}), pl AS (SELECT query_id, memory_id, min(position) AS rank FROM r WHERE round = 0 AND position < 4 GROUP BY ALL), po AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, memory_id) - 1 AS rank FROM pl),
fd AS (SELECT query_id, memory_id, min(position) AS rank FROM r WHERE round = 1 GROUP BY ALL), sz AS (SELECT query_id, count(*) AS n FROM po GROUP BY query_id),
ad AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, memory_id) - 1 + coalesce(n, 0) AS at_rank FROM fd JOIN st USING (query_id) LEFT JOIN sz USING (query_id)
  WHERE stop_reason IN {_TRIGGERS} AND NOT EXISTS (SELECT 1 FROM po WHERE po.query_id = fd.query_id AND po.memory_id = fd.memory_id))
SELECT * FROM po UNION ALL SELECT * FROM ad WHERE at_rank < 6""")
def q65_recovery_fill(spark, sf_dir):
    r = V.view(spark, sf_dir, _ROUNDS)
    pool = retrieval.dedup_candidates(r.where("round = 0 and position < 4").withColumnRenamed("position", "rank"))
    found = r.where("round = 1").groupBy("query_id", "memory_id").agg(F.min("position").alias("at"))
    found = retrieval.dedup_candidates(found.withColumnRenamed("at", "rank"))
    return multihop.recovery_fill(pool, multihop.plan_stop(_plan_runs(spark, sf_dir)), found, 6)[0]


@_query()
def q66_multi_hop_search(spark, sf_dir):
    """Planned search over the document memories with literal plans and answers."""

    memories = V.view(spark, sf_dir, V.MEMORIES)
    index = retrieval.bm25_index(memories, save=_stored)
    queries = V.view(spark, sf_dir, V.QUERIES).select("query_id", "user_id", "query")
    plans = _replies(spark, sf_dir, [c.replace("who is {x}", "who is the").replace("one {x}", "the and of") for c in PLAN_CASES]).select("query_id", "reply")

    def answer(asked):
        n = F.pmod(F.xxhash64("query_id", "round"), F.lit(5))
        return asked.withColumn("reply", F.when(n == 0, '{"status": "unresolved", "answer": null, "evidence": []}').otherwise('{"status": "answered", "answer": "of the", "evidence": []}'))

    bodies = memories.select("memory_id", F.lit("").alias("day"), F.col("text").alias("body"))
    found, _ = multihop.multi_hop_search(queries, lambda q: retrieval.bm25_topk(q, index), plans, answer, bodies, _stored)
    return found


_TWO = "array_to_string(list_slice({terms}, 1, 2), ' ')"
_REACT = f"""WITH {_BM25},
q2 AS (SELECT lex.query_id, lex.user_id, {_TWO.format(terms=_terms('text'))} AS query FROM lex JOIN d USING (memory_id) JOIN q USING (query_id)
  WHERE rank = 0 AND {_TWO.format(terms=_terms('text'))} <> lower(trim(q.query))),
qt2 AS (SELECT DISTINCT query_id, user_id, unnest({_terms('query')}) AS term FROM q2),
ls2 AS (SELECT query_id, qt.user_id, tf.memory_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM qt2 qt JOIN df ON df.term = qt.term JOIN tf ON tf.term = qt.term AND tf.user_id = qt.user_id JOIN dl ON dl.memory_id = tf.memory_id AND dl.user_id = tf.user_id, g GROUP BY query_id, qt.user_id, tf.memory_id),
lex2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM ls2),
p AS (SELECT query_id, memory_id, min(place) AS place FROM (SELECT query_id, memory_id, rank AS place FROM lex WHERE rank < 20 UNION ALL SELECT query_id, memory_id, 100 + rank FROM lex2 WHERE rank < 20) GROUP BY ALL)
SELECT query_id, memory_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, memory_id) - 1 AS BIGINT) AS rank FROM p"""


@_query(_REACT)
def q66_react_search(spark, sf_dir):
    """Two rounds of search and decision; the stand-in for the model asks for the first two words of the best document, then has enough."""
    memories = V.view(spark, sf_dir, V.MEMORIES)
    index = retrieval.bm25_index(memories, save=_stored)
    queries = V.view(spark, sf_dir, V.QUERIES).select("query_id", "user_id", "query")
    two = memories.select(F.col("memory_id").alias("best"), F.array_join(F.slice(T.terms(F.col("text")), 1, 2), " ").alias("words"))

    def decide(asked):
        best = asked.withColumn("best", F.get("ids", F.lit(0))).join(two, "best", "left")
        picked = F.when(F.col("best").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
        first = F.to_json(F.struct(F.lit(False).alias("is_sufficient"), picked.alias("evidence_indices"), F.coalesce("words", F.lit("")).alias("new_query"), F.lit(0.2).alias("confidence_score")))
        enough = F.lit('{"is_sufficient": true, "evidence_indices": [], "new_query": "", "confidence_score": 0.9}')
        return best.withColumn("reply", F.when(F.col("round") == 0, first).otherwise(enough)).drop("best", "words")

    bodies = memories.select("memory_id", F.lit("").alias("day"), F.col("text").alias("body"))
    found, _ = multihop.react_search(queries, lambda q: retrieval.bm25_topk(q, index), decide, bodies, _stored)
    return found.select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@_query(f"""WITH r AS ({_ROUNDS.format(**_NAMES)}), x AS (SELECT *, row_number() OVER (PARTITION BY query_id, round ORDER BY position) - 1 AS i FROM r WHERE position < 3 AND value >= 20)
SELECT query_id, round, string_agg('[' || i || ']' || CASE WHEN position = 1 THEN ' Time: 2024-01-02' ELSE '' END || chr(10) || memory_id, chr(10) || chr(10) ORDER BY i) AS documents FROM x GROUP BY ALL""")
def q67_render_documents(spark, sf_dir):
    r = V.view(spark, sf_dir, _ROUNDS).where("position < 3")
    shown = r.select("query_id", "round", "position", "memory_id", F.when(F.col("position") == 1, "2024-01-02").otherwise("").alias("day"), F.when(F.col("value") >= 20, F.col("memory_id")).alias("body"))
    return multihop.render_documents(shown).select("query_id", "round", F.array_join("documents", "\n\n").alias("documents"))


@_query("""WITH u AS (SELECT DISTINCT user_id AS n FROM events)
SELECT 'q' || n AS query_id, 's1: find ' || n || chr(10) || 's2: next {{s1}}  (depends on s1)' AS plan, CASE WHEN n % 3 = 0 THEN '(none yet)' ELSE 's1 question: find ' || n || chr(10) || 's1 answer: a' || n || chr(10) || 's1 sources: ' || CASE WHEN n % 2 = 0 THEN 'm1, m2' ELSE '(none)' END END AS history FROM u""")
def q67_plan_and_history(spark, sf_dir):
    n = F.col("n")
    u = V.view(spark, sf_dir, "SELECT DISTINCT user_id AS n FROM {events}").select(F.concat(F.lit("q"), "n").alias("query_id"), "n")
    none = F.array().cast("array<string>")
    first = u.select("query_id", F.lit(0).alias("step_no"), F.lit("s1").alias("id"), F.concat(F.lit("find "), "n").alias("query"), none.alias("depends_on"), F.when(n % 3 != 0, F.concat(F.lit("a"), "n")).alias("answer"), F.when(n % 2 == 0, F.array(F.lit("m1"), F.lit("m2"))).otherwise(none).alias("sources"))
    second = u.select("query_id", F.lit(1).alias("step_no"), F.lit("s2").alias("id"), F.lit("next {{s1}}").alias("query"), F.array(F.lit("s1")).alias("depends_on"), F.lit(None).cast("string").alias("answer"), none.alias("sources"))
    steps = first.unionByName(second).withColumn("executed_query", F.col("query"))
    return multihop.render_plan(steps).join(multihop.completed_history(steps), "query_id")


# ---------------------------------------------------------------- metrics, streams

_COUNTERS = ["rerank_candidates", "neighbors_added", "truncated_by_top_k"]
_OBS = f"WITH o AS ({V.OBSERVATIONS.format(**_NAMES)})"
_METRICS = "SELECT count(*) AS searches, " + ", ".join(f"CAST(sum(CAST({c} AS BIGINT)) AS BIGINT) AS {c}" for c in _COUNTERS) + ", " + ", ".join(f"count({c}) AS {c}_calls, round(avg({c}), 3) AS {c}_mean, max({c}) AS {c}_max" for c in metrics.LATENCIES) + " FROM o"


@_query(f"{_OBS} {_METRICS}")
def q68_search_metrics(spark, sf_dir):
    return metrics.search_metrics(V.view(spark, sf_dir, V.OBSERVATIONS), _COUNTERS)


@_query(f"""{_OBS} SELECT dimension, value, count(*) AS n FROM (SELECT 'route' AS dimension, route AS value FROM o UNION ALL SELECT 'stop_reason', stop_reason FROM o UNION ALL SELECT 'fact_status', fact_status FROM o) WHERE value <> '' GROUP BY ALL""")
def q69_category_counts(spark, sf_dir):
    return metrics.category_counts(V.view(spark, sf_dir, V.OBSERVATIONS), ["route", "stop_reason", "fact_status"])


@_query(f"WITH {_B} SELECT * FROM b")
def q70_ingest_stream(spark, sf_dir):
    """The blocks table after a stream of requests, replays and conflicts among them."""
    from mnemospark.schemas import BLOCK
    from mnemospark.sources.requests import read_requests
    from mnemospark.streaming.jobs import Tables, ingest_stream

    r, incoming = _incoming(spark, sf_dir)
    path, out = _folder(spark, "stream"), Tables(_folder(spark, "memory"))
    incoming.drop("payload_hash").write.json(path)
    ingest_stream(read_requests(spark, path, stream=True), out, _folder(spark, "stream-checkpoint")).awaitTermination()
    return out.read(spark, "blocks", BLOCK)


@_query(f"{_OBS} {_METRICS}")
def q71_metrics_stream(spark, sf_dir):
    from mnemospark.streaming.jobs import metrics_stream

    name, path = f"metrics_{uuid.uuid4().hex}", _folder(spark, "observations")
    observations = V.view(spark, sf_dir, V.OBSERVATIONS)
    observations.write.parquet(path)
    stream = spark.readStream.schema(observations.schema).option("maxFilesPerTrigger", 1).parquet(path)
    metrics_stream(stream, _COUNTERS, _folder(spark, "metrics-checkpoint"), name).awaitTermination()
    return spark.table(name)


@_query(f"{_OBS} {_METRICS}")
def q71_metrics_sink(spark, sf_dir):
    """The same row from stored sums of micro-batches."""
    from mnemospark.streaming.jobs import metrics_sink, metrics_snapshot
    from mnemospark.streaming.tables import Tables

    path, t = _folder(spark, "observations"), Tables(_folder(spark, "metrics"))
    observations = V.view(spark, sf_dir, V.OBSERVATIONS)
    observations.repartition(3, "event_id").write.parquet(path)
    stream = spark.readStream.schema(observations.schema).option("maxFilesPerTrigger", 1).parquet(path)
    metrics_sink(stream, _COUNTERS, t, _folder(spark, "metrics-checkpoint"), compact_every=2).awaitTermination()
    return metrics_snapshot(spark, t, _COUNTERS)


def _toy_scores(queries: list[str], texts: list[str]) -> list[float]:
    """A deterministic stand-in for a reranker."""
    return [len(t) * 37 % 101 / 101 for t in texts]


_TOY = "[CAST(len({0}) AS DOUBLE), CAST(strlen({0}) AS DOUBLE), CAST(unicode({0}) AS DOUBLE)]"
_DATED = _SEGMENTS.replace(f"{_RENDER} AS text", f"CASE WHEN {_RENDER} <> '' AND event_time IS NOT NULL THEN '[' || {_DAY.format('event_time')} || '] ' || {_RENDER} ELSE {_RENDER} END AS text")
_FLAGSHIP = f"""WITH {_B}, q AS ({V.SEARCHES.format(**_NAMES)}), d AS (SELECT id AS memory_id, user_id, {_RENDER} AS text FROM b),
{_BM25[_BM25.index("t AS (SELECT memory_id"):]},
qv AS (SELECT *, {_TOY.format('query')} AS dense FROM q), iv AS (SELECT *, {_TOY.format('text')} AS dense FROM d WHERE text <> ''),
{_DENSE[_DENSE.index("dn AS"):]}, {_RRF},
c0 AS (SELECT fu.query_id, memory_id, rank FROM fu JOIN q USING (query_id) WHERE rank < top_k),
c AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(len(text) * 37 % 101 AS DOUBLE) / 101 DESC, rank) - 1 AS rank FROM c0 JOIN d USING (memory_id)),
{_EXPAND}, {_DATED},
pk AS (SELECT query_id, row_number() OVER w - 1 AS position, anchor_memory_id AS id, content, {_DAY.format("anchor_event_time")} AS created_at, sum(token_count) OVER w AS used FROM se WINDOW w AS (PARTITION BY query_id ORDER BY best_rank, anchor_memory_id)),
it AS (SELECT query_id, position, id, content, created_at, 1 / (position + 1.0) AS score FROM pk JOIN q USING (query_id) WHERE position < top_k AND used <= 900),
f AS ({V.BLOCK_FACTS.format(blocks="b")}), {_CURRENT}, {_OWNERS},
rm AS (SELECT q.query_id, q.user_id, top_k, count(it.id) AS taken FROM q LEFT JOIN it ON it.query_id = q.query_id GROUP BY ALL),
fo AS (SELECT query_id, now.user_id, content, row_number() OVER (PARTITION BY query_id ORDER BY event_time IS NULL, event_time, parent_memory_id, now.id) AS n, top_k - taken AS room
  FROM rm JOIN now ON now.user_id = rm.user_id AND subject_key = 'i' WHERE taken < top_k QUALIFY n <= room),
sn AS (SELECT query_id, n, CASE WHEN owner IS NULL THEN content ELSE replace(content, 'Statement: my ', 'Statement: ' || owner || chr(39) || 's ') END AS content FROM fo LEFT JOIN ow USING (user_id)),
s1 AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY query_id, lower(content) ORDER BY n) = 1),
ap AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 + taken AS at_position, content, top_k FROM s1 JOIN rm USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.query_id = s1.query_id AND it.content = s1.content))
SELECT query_id, position, id, content, created_at, round(CAST(score AS DOUBLE), 6) AS score FROM it
UNION ALL SELECT query_id, at_position, 'fact:' || at_position, content, '', 0.0 FROM ap WHERE at_position < top_k"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to evidence: blocks, both arms, fusion, rerank, neighbours, dated segments, packaging, facts."""
    blocks = _stored(V.blocks(spark, sf_dir), "blocks")
    encoded = lambda df, key, text: embed.encode_distinct(df.select(F.col(key).alias("content_hash"), F.col(text).alias("text")), _toy_vectors, 64).select(F.col("content_hash").alias(key), F.col("vec").alias("dense"))
    texts = blocks.select(F.col("id").alias("memory_id"), "user_id", T.render(F.col("question"), F.col("answer")).alias("text")).where("text <> ''")
    vectors = _stored(encoded(texts, "memory_id", "text").join(texts.select("memory_id", "user_id"), "memory_id"), "vectors")
    asked = V.view(spark, sf_dir, V.SEARCHES)
    asked = asked.join(encoded(asked, "query_id", "query"), "query_id")
    memory = search.Memory(blocks, retrieval.bm25_index(texts, save=_stored), vectors, V.view(spark, sf_dir, V.BLOCK_FACTS, blocks=blocks))
    items, _ = search.search(
        asked, memory, _stored, search.Options(with_day=True, annotate=dates.annotate_relative_dates, max_tokens=900),
        rerank=lambda candidates, queries: rank.score_pairs(candidates, queries, memory.texts, _toy_scores),
        entities=asked.select("query_id", F.array(F.lit("User")).alias("entities")),
    )
    return items.withColumn("score", F.round("score", 6))


ORACLES["flagship_search"] = _FLAGSHIP
QUERIES["flagship_search"] = flagship
assert all(re.match(r"q\d\d_|flagship", n) for n in QUERIES)
