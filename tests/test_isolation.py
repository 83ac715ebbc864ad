"""One failing query does not fail the others: scorers, encoders, rounds of search; metrics that outlive a restart."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import embed, ingest, metrics, multihop, rank, retrieval, search
from mnemospark.streaming.jobs import metrics_sink, metrics_snapshot
from mnemospark.streaming.tables import Tables
from tests.test_memory import requests


@pytest.fixture
def save(spark, tmp_path):
    def go(df, name):
        path = f"{tmp_path}/{random.random()}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return go


def test_a_failing_scorer_leaves_its_query_as_it_was(spark):
    candidates = spark.createDataFrame([(q, m, i) for q in ("good", "bad", "fine") for i, m in enumerate(("a", "bb"))], "query_id string, memory_id string, rank int").coalesce(1)
    queries = spark.createDataFrame([(q, q) for q in ("good", "bad", "fine")], "query_id string, query string")
    texts = spark.createDataFrame([("a", "a"), ("bb", "bb")], "memory_id string, text string")

    def scorer(qs, ts):
        if "bad" in qs:
            raise TimeoutError("model")
        return [float(len(t)) for t in ts]

    got = rank.apply_rerank(candidates, rank.score_pairs(candidates, queries, texts, scorer)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.memory_id, r.status) for r in got] == [("bad", "a", "degraded"), ("bad", "bb", "degraded"), ("fine", "bb", "called"), ("fine", "a", "called"), ("good", "bb", "called"), ("good", "a", "called")]


def encode(texts):
    if any("bad" in t for t in texts):
        raise ConnectionError("no vector")
    return [[float(len(t)), 1.0] for t in texts]


def test_queries_that_cannot_be_embedded_say_why(spark, save):
    queries = spark.createDataFrame([("q1", "u", "red fox", 3), ("q2", "u", "bad fox", 3), ("q3", "u", "blue", 3)], "query_id string, user_id string, query string, top_k int")
    made = {r.query_id: r for r in embed.embed_queries(queries.coalesce(1), encode).collect()}
    assert made["q1"].dense == [7.0, 1.0] and made["q1"].error is None and made["q3"].dense == [4.0, 1.0]
    assert made["q2"].dense is None and made["q2"].error == "ConnectionError: no vector"
    blocks = ingest.compose_blocks(ingest.messages_of(requests(spark, ("r", [("user", "red fox", 1), ("assistant", "yes", 2), ("user", "blue sky", 3), ("assistant", "no", 4)], 0)))).withColumn("user_id", F.lit("u"))
    texts = blocks.select(F.col("id").alias("memory_id"), "user_id", T.render(F.col("question"), F.col("answer")).alias("text"))
    vectors = texts.select("memory_id", "user_id", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("dense"))
    memory = search.Memory(blocks, retrieval.bm25_index(texts), vectors)
    found = search.retrieve_isolated(queries, memory, search.Options(), encode, save).collect()
    assert {r.query_id for r in found if r.error is None} == {"q1", "q3"} and [(r.query_id, r.memory_id) for r in found if r.error] == [("q2", None)]
    items, notes = search.search(save(embed.embed_queries(queries, encode), "vectors"), memory, save)
    assert {r.query_id for r in items.collect()} == {"q1", "q3"}
    assert {r.query_id: r.error for r in notes.collect()} == {"q1": None, "q2": "ConnectionError: no vector", "q3": None}


DOCS = [("m1", "u", "the mayor is anna"), ("m2", "u", "anna lives in oslo"), ("m3", "u", "where the other is")]


def failing(index, words):
    """A search whose queries with one of the words fail."""
    def go(asked):
        ill = F.lit(False)
        for w in words:
            ill = ill | F.contains("query", F.lit(w))
        found = retrieval.bm25_topk(asked.where(~ill), index).select("query_id", "memory_id", "rank", F.lit(None).cast("string").alias("error"))
        return found.unionByName(asked.where(ill).select("query_id", F.lit(None).cast("string").alias("memory_id"), F.lit(None).cast("int").alias("rank"), F.lit("timeout").alias("error")))

    return go


def test_a_failed_search_stops_its_plan_only(spark, save):
    docs = spark.createDataFrame(DOCS, "memory_id string, user_id string, text string")
    index = retrieval.bm25_index(docs)
    queries = spark.createDataFrame([("q1", "u", "where"), ("q2", "u", "where"), ("q3", "u", "where")], "query_id string, user_id string, query string")
    plan = lambda *qs: json.dumps({"steps": [{"id": f"s{i}", "query": q, "depends_on": [f"s{i - 1}"] if i else []} for i, q in enumerate(qs)]})
    plans = spark.createDataFrame([("q1", plan("mayor", "{{s0}} lives")), ("q2", plan("mayor", "{{s0}} lives ill")), ("q3", plan("ill mayor"))], "query_id string, reply string")
    asked_of = []

    def answer(asked):
        asked_of.extend((r.query_id, r["round"]) for r in asked.collect())
        return asked.withColumn("reply", F.lit('{"status": "answered", "answer": "anna", "evidence": [{"document_index": 0, "quote": "anna"}]}'))

    bodies = docs.select("memory_id", F.lit("").alias("day"), F.col("text").alias("body"))
    found, stops = multihop.multi_hop_search(queries, failing(index, ["ill"]), plans, answer, bodies, save)
    assert {r.query_id: (r.stop_reason, r.recovery) for r in stops.collect()} == {"q1": ("plan_complete", "not_triggered"), "q2": ("retrieval_error", "not_triggered"), "q3": ("retrieval_error", "not_triggered")}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    assert got == {"q1": ["m1", "m2"], "q2": ["m1"]}
    assert set(asked_of) == {("q1", 0), ("q1", 1), ("q2", 0)}  # no model is asked about a search that failed


def test_a_failed_search_stops_its_rounds_only(spark, save):
    docs = spark.createDataFrame(DOCS, "memory_id string, user_id string, text string")
    index = retrieval.bm25_index(docs)
    queries = spark.createDataFrame([("q1", "u", "mayor"), ("q2", "u", "mayor too"), ("q3", "u", "ill")], "query_id string, user_id string, query string")
    say = lambda done, picks, query, score: F.lit(json.dumps({"is_sufficient": done, "evidence_indices": picks, "new_query": query, "confidence_score": score}))

    def decide(asked):
        again = F.when(F.col("query_id") == "q1", say(False, [0], "anna lives", 0.1)).otherwise(say(False, [0], "ill again", 0.1))
        return asked.withColumn("reply", F.when(F.col("round") == 0, again).otherwise(say(True, [0], "", 0.9)))

    bodies = docs.select("memory_id", F.lit("").alias("day"), F.col("text").alias("body"))
    found, stops = multihop.react_search(queries, failing(index, ["ill"]), decide, bodies, save)
    assert {r.query_id: (r.stop_reason, r.rounds, r.evidence) for r in stops.collect()} == {"q1": ("sufficient", 2, ["m1", "m2"]), "q2": ("retrieval_error", 2, ["m1"]), "q3": ("retrieval_error", 1, [])}
    assert {r.query_id for r in found.collect()} == {"q1", "q2"}


def test_stored_metrics_survive_replays_and_restarts(spark, tmp_path):
    schema = "latency_ms double, router_latency_ms double, multi_hop_latency_ms double, hits int"
    rows = [(float(i), float(i) if i % 2 else None, None, i % 3 if i % 5 else None) for i in range(60)]
    for n in range(6):
        spark.createDataFrame(rows[10 * n : 10 * n + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = metrics.search_metrics(spark.createDataFrame(rows, schema), ["hits"]).first()
    t = Tables(f"{tmp_path}/t")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    metrics_sink(stream(), ["hits"], t, f"{tmp_path}/cp", compact_every=4).awaitTermination()
    assert metrics_snapshot(spark, t, ["hits"]).first() == want and len(t.snapshot(spark).folders["metrics"]) == 3
    before = t.snapshot(spark)
    # a batch again, as after a crash between its commit and the stream's own note
    run = spark.read.json(f"{tmp_path}/cp/ingest-run").first()["run"]
    assert not t.commit(spark, f"metrics-{run}-5", {"metrics": metrics.partial_metrics(spark.createDataFrame(rows[:10], schema), ["hits"])})
    spark.createDataFrame(rows[:10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    metrics_sink(stream(), ["hits"], t, f"{tmp_path}/cp").awaitTermination()
    assert metrics_snapshot(spark, t, ["hits"]).first() == metrics.search_metrics(spark.createDataFrame(rows + rows[:10], schema), ["hits"]).first()
    assert metrics.merged_metrics(t.read(spark, "metrics", metrics.PARTIAL, before), ["hits"]).first() == want  # a reader from before
    assert metrics_snapshot(spark, Tables(f"{tmp_path}/none"), ["hits"]).first().searches == 0
