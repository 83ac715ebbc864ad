"""Streams: replay-safe ingest of add requests, and running metrics."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemospark import schemas
from mnemospark.operators import ingest, membership, metrics
from mnemospark.operators.tables import one_of_each
from mnemospark.streaming.tables import KEPT, ConflictError, Snapshot, Tables


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and dies with the checkpoint: batches of another or a renewed checkpoint never take its folders."""
    path = f"{checkpoint.rstrip('/')}/ingest-run"
    if not _exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex[:12],)], "run string").coalesce(1).write.json(path)
    return spark.read.schema("run string").json(path).first()["run"]


def known_requests(spark: SparkSession, tables: Tables, requests: DataFrame, at: Snapshot | None = None) -> DataFrame:
    """The part of the registry that can hold one of these requests: the buckets of ids that the registry's filters don't rule out.

    For new ids that is, but for some in a thousand, nothing; of the filters one row of 4 KB is met for each id and folder. What is
    read depends on the batch and not on the size of the registry.
    """
    at = at or tables.snapshot(spark)
    ids = tables.bucketed("applied", requests.select("request_id").distinct())
    touched = [r.bucket for r in ids.select("bucket").distinct().collect()]  # at most the registry's buckets
    filters = tables.scan(spark, "applied_filter", membership.FILTER, touched, at)
    seen = [r.bucket for r in membership.may_hold(ids, "request_id", filters).select("bucket").distinct().collect()]
    return tables.scan(spark, "applied", schemas.APPLIED, seen, at).drop("bucket")


def _filter_chunks(at: Snapshot) -> int:
    return int(at.notes.get(f"{KEPT}filter chunks", 1))


def ingest_batch(requests: DataFrame, tables: Tables, batch: str, after: Callable[[DataFrame], None] | None = None) -> None:
    """One batch of requests into the tables; applying it again changes nothing.

    Source tables, registry and its filter are one commit. Requests of other batches are known from the registry, so a request is
    never stored twice, whichever stream brings it. `after` (facts, index) runs on the new blocks, and again when a committed batch is
    repeated, as the job may have broken off before it; its failure does not fail the ingest.
    """
    spark = requests.sparkSession
    at = tables.snapshot(spark)
    if not tables.committed(spark, batch, at):  # else it was committed before the stream could note that
        valid, rejected = ingest.validate_requests(requests)
        marked = ingest.payload_fingerprint(valid)
        # read by all writes below; kept in the shared folder, so a lost executor costs nothing
        work = tables.path(f"work/{uuid.uuid4().hex}")
        ingest.resolve_batches(marked, known_requests(spark, tables, marked, at)).write.parquet(work)
        resolved = spark.read.parquet(work)
        messages = ingest.messages_of(resolved.where("outcome = 'new'"))
        applied = ingest.record_batches(resolved, 0)
        tables.commit(spark, batch, {
            "blocks": ingest.compose_blocks(messages),
            "messages": ingest.explode_messages(messages),
            "rejected": rejected.drop("messages"),
            "conflicts": resolved.where("outcome = 'conflict'").drop("messages"),
            "applied": applied,
            "applied_filter": membership.filter_of(tables.bucketed("applied", applied), "request_id", _filter_chunks(at)),
        }, base=at)
        path = spark._jvm.org.apache.hadoop.fs.Path(work)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if after is not None:
        try:
            after(tables.of_commit(spark, "blocks", schemas.BLOCK, batch))
        except Exception as error:  # derived data can be rebuilt; the memory must not be lost
            spark.createDataFrame([(batch, repr(error)[:500])], "batch string, error string").write.mode("append").json(tables.path("derived_errors"))


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema; those that an older table lacks are null."""
    kinds = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds))


def adopt_legacy(spark: SparkSession, tables: Tables, blocks: DataFrame, applied: DataFrame, messages: DataFrame | None = None) -> bool:
    """Take over tables of an older layout, in one commit: ids and links are computed anew, messages follow their block's new id, and a
    registry without `payload_hash` gets it as null, so its requests are replays whatever they hold. Of repeated request ids one row counts.

    Facts, coverage and index hang on the old ids and are derived again. False if this was done before.
    """
    now = tables.snapshot(spark)
    if tables.committed(spark, "legacy-0", now):
        return False
    renamed = ingest.rekey_blocks(_shaped(blocks, schemas.BLOCK))
    known = one_of_each(_shaped(applied, schemas.APPLIED), ["request_id"], "ignore", ["applied_at", "payload_hash", "user_id", "session_id"])
    frames = {
        "blocks": renamed.drop("old_id"), "applied": known,
        "applied_filter": membership.filter_of(tables.bucketed("applied", known), "request_id", _filter_chunks(now)),
    }
    if messages is not None:
        ids = renamed.select(F.col("old_id").alias("parent_memory_id"), F.col("id").alias("new_id"))
        frames["messages"] = _shaped(messages, schemas.BLOCK_MESSAGE).join(ids, "parent_memory_id").withColumn("parent_memory_id", F.col("new_id")).drop("new_id")
    return tables.commit(spark, "legacy-0", frames, base=now)


#: Schemas of the tables that `maintain` compacts.
MAINTAINED = {
    "blocks": schemas.BLOCK, "messages": schemas.BLOCK_MESSAGE, "applied": schemas.APPLIED, "facts": schemas.FACT, "coverage": schemas.COVERAGE,
    "extracted": schemas.EXTRACTED, "replies": schemas.REPLY, "cache": schemas.CACHE, "index": schemas.INDEX,
}


def maintain(spark: SparkSession, tables: Tables, most: int = 4) -> int:
    """Compact every table whose buckets have more than `most` folders, and make the registry's filter larger when ids have less
    than 16 bits each; how many folders were replaced. Streams may go on meanwhile; `Tables.vacuum` deletes what is replaced."""
    gone = sum(tables.compact(spark, name, schema, most) for name, schema in MAINTAINED.items())
    at = tables.snapshot(spark)
    buckets = tables.layouts["applied"][1]
    wanted = membership.chunks_for(tables.read(spark, "applied", schemas.APPLIED, at).count(), buckets)
    if wanted <= _filter_chunks(at):
        return gone + tables.compact(spark, "applied_filter", membership.FILTER, most, membership.merged)
    ids = tables.scan(spark, "applied", schemas.APPLIED, at=at)
    old = list(at.folders.get("applied_filter", {}))
    try:
        tables.commit(spark, f"filter-{uuid.uuid4().hex[:8]}", {"applied_filter": membership.filter_of(ids, "request_id", wanted)}, {"applied_filter": old}, {f"{KEPT}filter chunks": str(wanted)}, at)
    except ConflictError:
        return gone
    return gone + len(old)


def ingest_stream(requests: DataFrame, tables: Tables, checkpoint: str, after: Callable[[DataFrame], None] | None = None, maintain_every: int = 20) -> StreamingQuery:
    """A stream of requests into the tables, all that is there now. What is known of a request lives in the tables, not in
    stream state, so replays and conflicts are seen however late they come, under this checkpoint or another.

    One stream at a time writes to a set of tables. Every `maintain_every` batches the tables are compacted (0: never).
    """
    spark, run = requests.sparkSession, run_id(requests.sparkSession, checkpoint)

    def apply(df: DataFrame, n: int) -> None:
        ingest_batch(df, tables, f"{run}-{n}", after)
        if maintain_every and n % maintain_every == maintain_every - 1:
            maintain(spark, tables)

    return requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics_stream(observations: DataFrame, counters: list[str], checkpoint: str, name: str, latencies: tuple[str, ...] = metrics.LATENCIES) -> StreamingQuery:
    """The running snapshot of search_metrics as the in-memory table `name` (one row), which ends with the session; metrics_sink keeps it."""
    snapshot = metrics.search_metrics(observations, counters, latencies)
    out = snapshot.writeStream.outputMode("complete").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return out.format("memory").start()


def metrics_sink(observations: DataFrame, counters: list[str], tables: Tables, checkpoint: str, latencies: tuple[str, ...] = metrics.LATENCIES, compact_every: int = 20) -> StreamingQuery:
    """Sums of each micro-batch into the table `metrics`, a commit each; metrics_snapshot merges them.

    A replayed batch changes nothing, as its commit is there; a reader sees whole batches only, also while one is written. The sums
    of all batches become one folder every `compact_every` batches (0: never).
    """
    spark, run = observations.sparkSession, run_id(observations.sparkSession, checkpoint)

    def add(df: DataFrame, n: int) -> None:
        tables.commit(spark, f"metrics-{run}-{n}", {"metrics": metrics.partial_metrics(df, counters, latencies)})
        if compact_every and n % compact_every == compact_every - 1:
            tables.compact(spark, "metrics", metrics.PARTIAL, 1, lambda rows: metrics.added_partials(rows).withColumn("bucket", F.lit(0)))

    return observations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics_snapshot(spark: SparkSession, tables: Tables, counters: list[str], latencies: tuple[str, ...] = metrics.LATENCIES) -> DataFrame:
    """search_metrics over all batches that are committed now."""
    return metrics.merged_metrics(tables.read(spark, "metrics", metrics.PARTIAL), counters, latencies)
