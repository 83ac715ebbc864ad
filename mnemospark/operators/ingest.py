"""Add requests to memory tables: validation, idempotency, blocks, links, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.schemas import COMPLETE


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): ids and roles not empty, contents not blank, at least one message; rejected rows say why."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(empty("request_id"), "request_id")
        .when(empty("user_id"), "user_id")
        .when(empty("session_id"), "session_id")
        .when(F.coalesce(F.size("messages"), F.lit(0)) < 1, "messages")
        .when(F.exists("messages", lambda m: F.coalesce(m["role"], F.lit("")) == ""), "role")
        .when(F.exists("messages", lambda m: T.is_blank(m["content"])), "content")
    )
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def payload_fingerprint(df: DataFrame) -> DataFrame:
    """The requests with `payload_hash`."""
    return df.withColumn("payload_hash", F.sha2(T.canonical_request(F.col("user_id"), F.col("session_id"), F.col("messages")), 256))


def resolve_batches(incoming: DataFrame, applied: DataFrame) -> DataFrame:
    """Fingerprinted requests with `outcome`: new, replay or conflict.

    A request id already applied is a replay if the stored hash is equal or null, else a conflict. Of several requests with
    one unseen id the first received is new and decides about the others; of requests received at once the one with the least hash
    is the first, so the outcome is the same under any partitioning.
    """
    stored = applied.select("request_id", F.lit(True).alias("_seen"), F.col("payload_hash").alias("_stored"))
    w = Window.partitionBy("request_id").orderBy("received_seq", "payload_hash")
    first = F.first("payload_hash").over(w.rowsBetween(Window.unboundedPreceding, 0))
    known = F.when(F.col("_seen"), F.col("_stored")).otherwise(first)
    outcome = (
        F.when(F.col("_seen").isNull() & (F.row_number().over(w) == 1), "new")
        .when(known.isNull() | (known == F.col("payload_hash")), "replay")
        .otherwise("conflict")
    )
    return incoming.join(stored, "request_id", "left").withColumn("outcome", outcome).drop("_seen", "_stored")


def record_batches(resolved: DataFrame, applied_at: int | None = None) -> DataFrame:
    """Registry rows of the new requests."""
    at = F.lit(applied_at).cast("long") if applied_at is not None else F.unix_millis(F.current_timestamp())
    return resolved.where("outcome = 'new'").select("request_id", "user_id", "session_id", "payload_hash", at.alias("applied_at"))


def messages_of(requests: DataFrame) -> DataFrame:
    """One row a message, contents stripped, with its index in the request."""
    rows = requests.select("user_id", "session_id", "request_id", F.posexplode("messages").alias("source_index", "m"))
    return rows.select("user_id", "session_id", "request_id", "source_index", "m.role", T.strip(F.col("m.content")).alias("content"), "m.timestamp")


def _runs(messages: DataFrame) -> DataFrame:
    """Messages with `run`, the number of their run of equal roles, and `starts`, whether they begin it."""
    w = Window.partitionBy("request_id").orderBy("source_index")
    before = F.lag("role").over(w)
    marked = messages.withColumn("starts", before.isNull() | (before != F.col("role")))
    return marked.withColumn("run", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def role_runs(messages: DataFrame) -> DataFrame:
    """Consecutive messages of one role: (request_id, run, role, first_index, last_index, n_messages, text)."""
    rows = F.sort_array(F.collect_list(F.struct("source_index", "content")))
    return (
        _runs(messages).groupBy("request_id", "run", "role")
        .agg(F.min("source_index").alias("first_index"), F.max("source_index").alias("last_index"), F.count("*").alias("n_messages"), F.array_join(F.transform(rows, lambda x: x["content"]), "\n").alias("text"))
    )


def block_messages(messages: DataFrame) -> DataFrame:
    """Messages with the `local_index` and the id of their block.

    A user run and all runs of others after it are one block; each run of others before the first user run is its own. All
    windows share the request as their only key, so one exchange serves them and the aggregation after them.
    """
    w = Window.partitionBy("request_id").orderBy("source_index")
    asked = F.sum((F.col("starts") & (F.col("role") == "user")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = _runs(messages).withColumn("asked", asked)
    block = F.struct("asked", F.when(F.col("asked") == 0, F.col("run")).otherwise(F.lit(0)))
    rows = rows.withColumn("local_index", F.dense_rank().over(Window.partitionBy("request_id").orderBy(block)) - 1)
    ident = T.memory_id(*(F.col(c) for c in ("user_id", "session_id", "request_id", "local_index")))
    return rows.withColumn("parent_memory_id", ident).drop("starts", "run", "asked")


def compose_blocks(messages: DataFrame) -> DataFrame:
    """Linked question/answer blocks of stripped messages."""
    rows = F.sort_array(F.collect_list(F.struct("source_index", "role", "content")))
    line = lambda x: F.when(x["content"] != "", F.concat(F.lit("["), x["role"], F.lit("] "), x["content"])).otherwise(F.concat(F.lit("["), x["role"], F.lit("]")))
    side = lambda keep, show: F.nullif(F.array_join(F.transform(F.filter("rows", keep), show), "\n"), F.lit(""))
    blocks = (
        block_messages(messages).groupBy("user_id", "session_id", "request_id", "local_index", F.col("parent_memory_id").alias("id"))
        .agg(rows.alias("rows"), F.min_by(F.struct("timestamp"), "source_index").getField("timestamp").alias("event_time"))
        .select(
            "id", "user_id", "session_id", "request_id", "local_index",
            side(lambda x: x["role"] == "user", lambda x: x["content"]).alias("question"),
            side(lambda x: x["role"] != "user", line).alias("answer"),
            F.lit(COMPLETE).alias("status"), "event_time",
        )
    )
    return link_blocks(blocks)


def link_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with prev and next ids, set only among blocks of a request that have both sides; the others are skipped."""
    paired = F.col("question").isNotNull() & F.col("answer").isNotNull()
    w = Window.partitionBy("request_id", "user_id", "session_id", "_paired").orderBy("local_index")
    linked = blocks.drop("prev_memory_id", "next_memory_id").withColumn("_paired", paired)
    linked = linked.withColumns({"prev_memory_id": F.when(paired, F.lag("id").over(w)), "next_memory_id": F.when(paired, F.lead("id").over(w))})
    return linked.select("id", "user_id", "session_id", "request_id", "local_index", "prev_memory_id", "next_memory_id", "question", "answer", "status", "event_time")


def rekey_blocks(blocks: DataFrame) -> DataFrame:
    """A legacy table with ids and links computed anew, and the id each block had."""
    old = blocks.withColumn("old_id", F.col("id"))
    new = old.withColumn("id", T.memory_id(*(F.col(c) for c in ("user_id", "session_id", "request_id", "local_index"))))
    keys = ["user_id", "session_id", "request_id", "local_index"]
    return link_blocks(new).join(new.select(*keys, "old_id"), keys)


def explode_messages(messages: DataFrame) -> DataFrame:
    """Source messages with their block and their own id."""
    rows = block_messages(messages)
    return rows.select("parent_memory_id", "source_index", "role", "content", "timestamp", T.source_message_id(F.col("parent_memory_id"), F.col("source_index")).alias("id"))
