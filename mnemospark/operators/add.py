"""The whole Add job over memory tables: facts and index of new blocks and of blocks that were left behind.

Every step is one commit of streaming.tables.Tables, and takes what it works on from stored tables only: model replies; then, all
at once, facts, rejected facts, coverage and the note that a block was dealt with; then vectors; then index records. A job that
breaks off anywhere leaves whole steps behind, and the next run goes on after the last of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators import embed, facts

RECORD = ("parent_memory_id", "source_index")
REJECTED = schemas.FACT + ", reason string"


def admitted_records(blocks: DataFrame, messages: DataFrame, terms: list[str], gate: int = facts.GATE) -> DataFrame:
    """The records of blocks that the lexicon lets through to the model."""
    scored = facts.lexicon_score(facts.extraction_records(blocks, messages), terms, gate)
    return scored.where("admitted").drop("terms", "n_terms", "admitted")


def extract_facts(blocks: DataFrame, messages: DataFrame, terms: list[str], extract: Callable[[DataFrame], DataFrame], gate: int = facts.GATE) -> DataFrame:
    """Fact rows of blocks: records that the lexicon admits go to `extract`, which adds `reply`."""
    return facts.make_facts(facts.parse_fact_replies(extract(admitted_records(blocks, messages, terms, gate))))


def derive(
    spark: SparkSession, tables, encode: embed.Encode, coordinate: str, save: Callable[[DataFrame, str], DataFrame], terms: list[str] | None = None, extract: Callable[[DataFrame], DataFrame] | None = None, limit: int | None = None
) -> None:
    """Facts and index records of all blocks that have none. Give `lambda blocks: derive(blocks.sparkSession, ...)` to ingest_stream as `after`.

    Facts: blocks that were not dealt with (at most `limit` of them, in the order of their ids, if given) send those records to the model of which
    no reply is stored. A null reply is a failure and is not stored: its request waits for the next run, as facts are numbered over
    their request. Blocks with facts get a coverage row, from stored facts too. Index: blocks without a record are embedded,
    each distinct text once, and indexed. A repeated run adds nothing and calls no model. A failure of the model leaves the index to the
    next run, as facts come first.
    """
    run = uuid.uuid4().hex[:12]

    def commit(step: str, frames: dict[str, DataFrame]) -> None:
        tables.commit(spark, f"{step}-{run}-0", frames, notes={"run": run, "step": step})

    if extract is not None:
        blocks, messages = tables.read(spark, "blocks", schemas.BLOCK), tables.read(spark, "messages", schemas.BLOCK_MESSAGE)
        extracted = tables.read(spark, "extracted", schemas.EXTRACTED)
        coverage, known = tables.read(spark, "coverage", schemas.COVERAGE), tables.read(spark, "facts", schemas.FACT)
        left = save(facts.unindexed_blocks(facts.unindexed_blocks(blocks, coverage), extracted, limit=limit), "left")
        if not left.isEmpty():
            replies = lambda: tables.read(spark, "replies", schemas.REPLY).where(F.col("version") == facts.VERSION)
            records = save(admitted_records(left, messages, terms or []), "records")
            if not (asked := records.join(replies().select(*RECORD), list(RECORD), "left_anti")).isEmpty():
                new = extract(asked).where("reply is not null").withColumn("version", F.lit(facts.VERSION))
                commit("replies", {"replies": new.select(*replies().columns)})
            stored = replies().join(left.select(F.col("id").alias("parent_memory_id")), "parent_memory_id", "left_semi")
            waiting = records.join(stored.select(*RECORD), list(RECORD), "left_anti").select("request_id").distinct()
            ready = left.join(waiting, "request_id", "left_anti")
            made = facts.make_facts(facts.parse_fact_replies(stored.drop("version").join(waiting, "request_id", "left_anti")))
            good, rejected = facts.insert_facts(save(made, "facts"), blocks, known.limit(0))
            good = save(good.join(known.select("id"), "id", "left_anti").select(*known.columns), "new-facts")
            mine = known.join(left.select(F.col("id").alias("parent_memory_id")), "parent_memory_id", "left_semi")
            done = ready.select(F.col("id").alias("parent_memory_id"), "user_id", F.lit(facts.VERSION).alias("version"))
            commit("facts", {
                "facts": good, "rejected_facts": rejected, "extracted": done,
                "coverage": facts.mark_coverage(coverage.limit(0), good.select("parent_memory_id", "user_id").unionByName(mine.select("parent_memory_id", "user_id")), left),
            })
    index = tables.read(spark, "index", schemas.INDEX)
    missing = save(tables.read(spark, "blocks", schemas.BLOCK).join(index.select(F.col("memory_id").alias("id")), "id", "left_anti"), "unindexed")
    if missing.isEmpty():
        return
    cache = tables.read(spark, "cache", schemas.CACHE)
    _, new = embed.build_index(missing, cache, encode, coordinate)
    commit("vectors", {"cache": new})
    # every vector is stored now: nothing is encoded here
    records, _ = embed.build_index(missing, tables.read(spark, "cache", schemas.CACHE), encode, coordinate)
    commit("index", {"index": records.select(*index.columns)})
