"""Memory operators on hand-made tables, and their properties."""

import json
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.functions import text as T
from mnemospark.operators import add, embed, facts, ingest, metrics, multihop, rank, retrieval, search, tables
from mnemospark.sources.requests import read_requests
from mnemospark.streaming.jobs import Tables, ingest_batch, ingest_stream

LETTERS = {"s": "system", "a": "assistant", "u": "user", "t": "tool"}


def requests(spark, *rows):
    """rows: (request_id, roles as letters or messages, received_seq)"""
    out = []
    for rid, roles, seq in rows:
        messages = [(LETTERS[r], f"{r}{i}", 1000 * i) for i, r in enumerate(roles)] if isinstance(roles, str) else roles
        out.append((rid, "user1", "session1", messages, seq))
    return spark.createDataFrame(out, schemas.REQUEST)


def blocks_of(spark, roles):
    return sorted(ingest.compose_blocks(ingest.messages_of(requests(spark, ("r", roles, 0)))).collect(), key=lambda b: b.local_index)


def test_leading_runs_are_blocks_of_their_own(spark):
    got = blocks_of(spark, "sauuatu")
    assert [(b.question, b.answer) for b in got] == [(None, "[system] s0"), (None, "[assistant] a1"), ("u2\nu3", "[assistant] a4\n[tool] t5"), ("u6", None)]
    assert all(b.prev_memory_id is None and b.next_memory_id is None for b in got)


def test_links_skip_unpaired_blocks_and_are_mutual(spark):
    got = blocks_of(spark, "uauauau")
    assert [b.next_memory_id for b in got] == [got[1].id, got[2].id, None, None]
    assert [b.prev_memory_id for b in got] == [None, got[0].id, got[1].id, None]


def test_empty_contents_and_null_times(spark):
    got = blocks_of(spark, [("user", " ", None), ("assistant", "", 7), ("user", "q", 9)])
    assert [(b.question, b.answer, b.event_time) for b in got] == [(None, "[assistant]", None), ("q", None, 9)]


def test_ids_do_not_depend_on_partitioning(spark):
    df = requests(spark, *[(f"r{i}", "".join(random.Random(i).choices("saut", k=12)), 0) for i in range(20)])
    one = ingest.compose_blocks(ingest.messages_of(df.coalesce(1)))
    many = ingest.compose_blocks(ingest.messages_of(df.repartition(7)))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_role_runs(spark):
    got = sorted(ingest.role_runs(ingest.messages_of(requests(spark, ("r", "uuat", 0)))).collect(), key=lambda r: r.run)
    assert [(r.role, r.first_index, r.last_index, r.text) for r in got] == [("user", 0, 1, "u0\nu1"), ("assistant", 2, 2, "a2"), ("tool", 3, 3, "t3")]


def test_validation_reasons(spark):
    rows = [("", "u", "s", [("user", "x", 1)], 0), ("r", None, "s", [("user", "x", 1)], 0), ("r", "u", "s", [], 0), ("r", "u", "s", None, 0), ("r", "u", "s", [("", "x", 1)], 0), ("r", "u", "s", [("user", "　", 1)], 0), ("r", "u", "s", [("user", "x", None)], 0)]
    valid, rejected = ingest.validate_requests(spark.createDataFrame(rows, schemas.REQUEST))
    assert valid.count() == 1 and sorted(r.reason for r in rejected.collect()) == ["content", "messages", "messages", "request_id", "role", "user_id"]


def test_batches(spark):
    incoming = ingest.payload_fingerprint(requests(spark, ("new", "u", 0), ("new", "u", 1), ("new", "a", 2), ("same", "u", 3), ("other", "a", 4), ("old", "a", 5)))
    known = ingest.payload_fingerprint(requests(spark, ("same", "u", 0), ("other", "u", 0))).select("request_id", "payload_hash")
    applied = known.unionByName(spark.createDataFrame([("old", None)], "request_id string, payload_hash string"))
    got = {(r.request_id, r.received_seq): r.outcome for r in ingest.resolve_batches(incoming, applied).collect()}
    assert got == {("new", 0): "new", ("new", 1): "replay", ("new", 2): "conflict", ("same", 3): "replay", ("other", 4): "conflict", ("old", 5): "replay"}


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], "replace").collect())) == [(1, "a"), (2, "x"), (3, "z")]
    with pytest.raises(ValueError):
        tables.upsert(old, new, ["k"], "merge")


def test_written_tables_read_back(spark, tmp_path):
    blocks = ingest.compose_blocks(ingest.messages_of(requests(spark, ("r", "uaua", 0))))
    tables.write_table(blocks, f"{tmp_path}/blocks", buckets=4)
    back = spark.read.parquet(f"{tmp_path}/blocks")
    assert back.count() == 2 and "bucket" in back.columns
    tables.write_metrics(spark.createDataFrame([(1,)], "searches int"), f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/metrics").first().searches == 1


# ---------------------------------------------------------------- streams


def snapshot(spark, out):
    return {name: sorted(map(str, out.read(spark, name, schema).collect())) for name, schema in (("blocks", schemas.BLOCK), ("messages", schemas.BLOCK_MESSAGE), ("applied", schemas.APPLIED))}


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    df = requests(spark, ("r1", "uaua", 0), ("r2", "suat", 0), ("r1", "uaua", 1), ("r2", "u", 2))
    df.write.json(f"{tmp_path}/in")
    batch, out = Tables(f"{tmp_path}/batch"), Tables(f"{tmp_path}/stream")
    ingest_batch(df, batch, "0")
    ingest_stream(read_requests(spark, f"{tmp_path}/in", stream=True), out, f"{tmp_path}/cp").awaitTermination()
    before = snapshot(spark, out)
    assert before == snapshot(spark, batch) and len(before["blocks"]) == 4
    df.write.mode("append").json(f"{tmp_path}/in")
    ingest_stream(read_requests(spark, f"{tmp_path}/in", stream=True), out, f"{tmp_path}/cp").awaitTermination()
    assert snapshot(spark, out) == before
    ingest_batch(df, batch, "0")  # the same batch again, after a failure
    assert snapshot(spark, batch) == before


def test_another_checkpoint_takes_nothing_away(spark, tmp_path):
    """Two streams one after another into the same tables, a renewed checkpoint, and what a broken batch leaves."""
    out = Tables(f"{tmp_path}/t")
    for n, rows in enumerate([("r1", "ua", 0), ("r2", "uaua", 0), ("r1", "ua", 0)]):
        requests(spark, rows).write.json(f"{tmp_path}/in{n}")
        ingest_stream(read_requests(spark, f"{tmp_path}/in{n}", stream=True), out, f"{tmp_path}/cp{n}").awaitTermination()
    assert {r.request_id for r in out.read(spark, "applied", schemas.APPLIED).collect()} == {"r1", "r2"}
    before = snapshot(spark, out)
    assert len(before["blocks"]) == 3
    shutil.rmtree(f"{tmp_path}/cp0")
    requests(spark, ("r2", "uaua", 0), ("r3", "u", 0)).write.json(f"{tmp_path}/in4")
    ingest_stream(read_requests(spark, f"{tmp_path}/in4", stream=True), out, f"{tmp_path}/cp0").awaitTermination()
    after = snapshot(spark, out)
    assert len(after["blocks"]) == 4 and set(before["blocks"]) < set(after["blocks"])
    spark.createDataFrame([("x",) * 4 + (0,) + ("x",) * 5 + (0,)], schemas.BLOCK).write.parquet(out.path("blocks/batch=broken-0"))
    assert snapshot(spark, out) == after


def test_add_job_catches_up(spark, tmp_path):
    """Facts and index of all blocks, of those too for which an earlier run failed; a repeated run adds nothing."""
    def save(df, name):
        path = f"{tmp_path}/{random.random()}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    out = Tables(f"{tmp_path}/t")
    reply = json.dumps([{"subject": "Anna", "relation": "likes", "object": "tea", "quote": "likes"}])
    extract = lambda records: records.withColumn("reply", F.when(F.col("content").contains("Anna"), reply).otherwise("[]"))
    job = lambda encode: add.derive(spark, out, encode, "toy", save, ["anna", "tea", "likes"], extract)

    def broken(texts):
        raise RuntimeError("no encoder")

    ingest_batch(requests(spark, ("r1", [("user", "Anna likes tea", 5), ("assistant", "ok", 6)], 0)), out, "0", lambda _: job(broken))
    assert out.plain(spark, "index", schemas.INDEX).count() == 0 and out.plain(spark, "facts", schemas.FACT).count() == 1
    ingest_batch(requests(spark, ("r2", [("user", "other", 7)], 0)), out, "1", lambda _: job(lambda texts: [[float(len(t))] for t in texts]))
    for _ in range(2):
        index = {r.memory_id: r.text for r in out.plain(spark, "index", schemas.INDEX).collect()}
        assert sorted(index.values()) == ["Q: Anna likes tea\nA: [assistant] ok", "Q: other"]
        (fact,) = out.plain(spark, "facts", schemas.FACT).collect()
        assert fact.subject_key == "anna" and fact.parent_memory_id in index
        assert [r.parent_memory_id for r in out.plain(spark, "coverage", schemas.COVERAGE).collect()] == [fact.parent_memory_id]
        job(broken)  # nothing is left to encode


def test_failing_derived_data_does_not_fail_the_ingest(spark, tmp_path):
    out = Tables(f"{tmp_path}/t")

    def fail(_):
        raise RuntimeError("index is down")

    ingest_batch(requests(spark, ("r1", "ua", 0)), out, "0", fail)
    assert len(snapshot(spark, out)["blocks"]) == 1
    assert "index is down" in spark.read.json(out.path("derived_errors")).first().error


# ---------------------------------------------------------------- embeddings


def encode(texts):
    assert len(texts) <= 2
    return [[float(len(t)), 1.0] for t in texts]


def test_each_distinct_miss_is_encoded_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, "known")], "id int, text string")
    key = embed.embedding_coordinate("m", embed.template_version(False), 2)
    cache = spark.createDataFrame([("known",)], "t string").select(F.lit(key).alias("coordinate"), embed.content_hash(F.col("t")).alias("content_hash"), F.lit(2).alias("dim"), F.array(F.lit(9.0), F.lit(9.0)).cast("array<float>").alias("vec"), F.lit(0).cast("long").alias("created_at"))
    got, new = embed.embed_missing(texts, cache, encode, key, batch_size=2)
    assert {r.id: r.vec[0] for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 9} and new.count() == 2
    assert key != embed.embedding_coordinate("m", embed.template_version(True), 2) and len(key) == 16
    other, new = embed.embed_missing(texts, cache, encode, key, batch_size=2, query=True)
    assert new.count() == 3


def test_dimensions(spark):
    df = spark.createDataFrame([("c", [1.0, 2.0]), ("c", [1.0]), ("c", []), ("c", None), ("c", [1.0, float("nan")])], "coordinate string, vec array<float>")
    good, bad = embed.check_dimensions(df, 2)
    assert good.count() == 1 and bad.count() == 4
    assert embed.dimension_report(df.where("vec is not null")).first().dims == [0, 1, 2]


# ---------------------------------------------------------------- retrieval and ranking


def arm(spark, *ids, query="q"):
    return spark.createDataFrame([(query, m, i) for i, m in enumerate(ids)], "query_id string, memory_id string, rank int")


def test_fusion_from_zero_is_the_textbook_one_from_one(spark):
    got = {r.memory_id: r.score for r in retrieval.rrf_fuse([arm(spark, "a", "b", "c"), arm(spark, "c", "d")]).collect()}
    want = {"a": 0.5 / 61, "b": 0.5 / 62, "c": 0.5 / 63 + 0.5 / 61, "d": 0.5 / 62}
    assert got == pytest.approx(want, abs=1e-9)
    order = [r.memory_id for r in retrieval.rrf_fuse([arm(spark, "b"), arm(spark, "a")]).orderBy("rank").collect()]
    assert order == ["a", "b"]
    for bad in ({"k": 60}, {"weights": (0, 0)}, {"weights": (1,)}, {"weights": (1, -1)}, {"prefetch": 0}, {"top_k": 0}):
        with pytest.raises(ValueError):
            retrieval.rrf_fuse([arm(spark, "a"), arm(spark, "b")], **bad)


@pytest.mark.parametrize(("lexical", "dense", "want"), [("abc", "axy", True), ("abcde", "xcbay", True), ("axy", "bca", True), ("axyzw", "bcdea", False), ("", "abc", False), ("abc", "", False)])
def test_consistency(spark, lexical, dense, want):
    rows = spark.createDataFrame([("q", list(lexical), list(dense))], "query_id string, lexical array<string>, dense array<string>")
    assert retrieval.rank_consistency(rows).first().consistent is want


def test_users_never_mix_and_only_common_terms_count(spark):
    docs = spark.createDataFrame([("m1", "u1", "red fox"), ("m2", "u2", "red fox"), ("m3", "u1", "blue sky")], "memory_id string, user_id string, text string")
    queries = spark.createDataFrame([("q", "u1", "RED moon")], "query_id string, user_id string, query string")
    for scope in ("corpus", "user"):
        assert [r.memory_id for r in retrieval.bm25_topk(queries, retrieval.bm25_index(docs, scope)).collect()] == ["m1"]
    index = spark.createDataFrame([("m1", "u1", [1.0, 0.0]), ("m2", "u2", [1.0, 0.0]), ("m3", "u1", [0.0, 0.0])], "memory_id string, user_id string, dense array<float>")
    asked = queries.withColumn("dense", F.array(F.lit(2.0), F.lit(0.0)).cast("array<float>")).withColumn("top_k", F.lit(1))
    assert [(r.memory_id, r.score) for r in retrieval.dense_topk(asked, index).orderBy("rank").collect()] == [("m1", 1.0), ("m3", 0.0)]
    assert retrieval.dense_topk(asked.limit(0), index).count() == 0
    assert retrieval.hybrid_search(asked, retrieval.bm25_index(docs), index).count() == 1
    assert retrieval.hybrid_search(asked.withColumn("query", F.lit(" ")), retrieval.bm25_index(docs), index).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    index = spark.createDataFrame([(f"m{i}", "u", [float(i), 1.0]) for i in range(300)], "memory_id string, user_id string, dense array<float>")
    asked = spark.createDataFrame([(f"q{i}", "u", [1.0, float(i)]) for i in range(9)], "query_id string, user_id string, dense array<float>")
    whole = sorted(map(str, retrieval.dense_topk(asked, index, 3).collect()))
    for name, n in (("BLOCK_BYTES", 1), ("QUERY_CHUNK", 2), ("HELD_QUERIES", 1)):
        monkeypatch.setattr(retrieval, name, n)
    assert sorted(map(str, retrieval.dense_topk(asked, index, 3).collect())) == whole and len(whole) == 27


def test_vectors_that_cannot_be_compared(spark):
    index = spark.createDataFrame([("m1", "u", [1.0, 0.0]), ("m2", "u", None), ("m3", "u", [None, 1.0]), ("m4", "u", []), ("m5", "u", [1.0]), ("m6", "u", [float("nan"), 1.0])], "memory_id string, user_id string, dense array<float>")
    asked = spark.createDataFrame([("q1", "u", [1.0, 1.0]), ("q2", "u", None), ("q3", "u", [2.0]), ("q4", "v", [1.0, 1.0])], "query_id string, user_id string, dense array<float>")
    assert sorted((r.query_id, r.memory_id, r.score) for r in retrieval.dense_topk(asked, index).collect()) == [("q1", "m1", 0.707107), ("q3", "m5", 1.0)]


def test_dense_arm_of_many_users(spark):
    """5,000 users of 50 vectors: every query meets its user's vectors only, and the result equals numpy's."""
    index = spark.range(250_000).select(F.concat(F.lit("m"), "id").alias("memory_id"), F.concat(F.lit("u"), F.col("id") % 5000).alias("user_id"), F.array(*[F.sin(F.col("id") * k).cast("float") for k in (1, 2, 3)]).alias("dense"))
    asked = spark.range(5000).select(F.concat(F.lit("q"), "id").alias("query_id"), F.concat(F.lit("u"), "id").alias("user_id"), F.array(*[F.cos(F.col("id") * k).cast("float") for k in (1, 2, 3)]).alias("dense"))
    got = retrieval.dense_topk(asked, index, 5)
    rows = got.where("query_id in ('q7', 'q4999')").collect()
    assert got.count() == 25_000
    x = np.stack([np.sin(np.arange(250_000) * k).astype(np.float32) for k in (1, 2, 3)], axis=1).astype(float)
    for q in (7, 4999):
        v = np.cos(q * np.array([1, 2, 3])).astype(np.float32).astype(float)
        mine = np.arange(q, 250_000, 5000)
        scores = np.round(x[mine] @ v / np.linalg.norm(x[mine], axis=1) / np.linalg.norm(v), 6)
        want = sorted((-s, f"m{i}") for s, i in zip(scores, mine, strict=True))[:5]
        assert [(-r.score, r.memory_id) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == f"q{q}"] == want


@pytest.mark.parametrize(
    ("scores", "order", "status"),
    [([(0, 0.1), (1, 0.9), (2, 0.1)], "bac", "called"), ([(0, 0.1), (1, 0.9)], "abc", "degraded"), ([(0, 0.1), (1, 0.9), (1, 0.3)], "abc", "degraded"), ([(0, 0.1), (1, float("nan")), (2, 1.0)], "abc", "degraded"), ([(0, 0.1), (1, 0.2), (3, 0.9)], "abc", "degraded"), ([(0, None), (1, 0.2), (2, 0.9)], "abc", "degraded"), ([], "abc", "degraded"), (None, "abc", "disabled")],
)
def test_rerank_is_all_or_nothing(spark, scores, order, status):
    table = None if scores is None else spark.createDataFrame([("q", i, s) for i, s in scores], "query_id string, idx int, score double")
    got = rank.apply_rerank(arm(spark, "a", "b", "c"), table).orderBy("rank").collect()
    assert "".join(r.memory_id for r in got) == order and {r.status for r in got} == {status}


def chain(spark, n=7):
    return ingest.compose_blocks(ingest.messages_of(requests(spark, ("r", "ua" * n, 0))))


def test_expansion(spark):
    blocks = chain(spark)
    ids = [b.id for b in blocks.orderBy("local_index").collect()]
    for radius, want in ((0, {3}), (1, {2, 3, 4}), (2, {1, 2, 3, 4, 5})):
        got = rank.expand_neighbors(arm(spark, ids[3]), blocks, radius=radius).collect()
        assert {ids.index(r.memory_id) for r in got} == want
    assert rank.expand_neighbors(arm(spark, ids[3], ids[5]), blocks, seed_limit=1).count() == 5
    counts = rank.expansion_counts(rank.expand_neighbors(arm(spark, ids[3], "gone"), blocks, radius=1)).first()
    assert (counts.neighbors_added, counts.missing_rows) == (2, 1)


def test_segments_and_placement(spark):
    blocks = chain(spark)
    ids = [b.id for b in blocks.orderBy("local_index").collect()]
    chosen = spark.createDataFrame([("q", ids[1], 4), ("q", ids[2], 1), ("q", ids[0], None), ("q", ids[5], 2)], "query_id string, memory_id string, rank bigint")
    text = [f"Q: u{2 * i}\nA: [assistant] a{2 * i + 1}" for i in range(7)]
    for placement, first in (("keep", [0, 1, 2]), ("front", [2, 0, 1]), ("echo", [2, 0, 1, 2])):
        got = rank.merge_segments(chosen, blocks, placement).orderBy("best_rank").collect()
        assert [(s.anchor_memory_id, s.best_rank, s.rerank_member_count, len(s.source_memory_ids)) for s in got] == [(ids[2], 1, 2, 3), (ids[5], 2, 1, 1)]
        assert got[0].content == "\n".join(text[i] for i in first) and got[0].anchor_event_time == 4000
    lone = rank.merge_segments(chosen.withColumn("rank", F.lit(None).cast("long")), blocks).orderBy("start_local_index").first()
    assert lone.anchor_memory_id == ids[0] and lone.best_rank == rank.NO_RANK
    with pytest.raises(ValueError):
        rank.merge_segments(chosen, blocks, "middle")


def test_packaging_is_a_prefix(spark):
    rows = [("q", f"m{i}", i, t, f"c{i}", None) for i, t in enumerate((5, 9, 1))]
    segments = spark.createDataFrame(rows, "query_id string, anchor_memory_id string, best_rank bigint, token_count bigint, content string, anchor_event_time bigint")
    items = rank.package(segments, 3, 10)
    assert [(r.id, r.score, r.created_at) for r in items.collect()] == [("m0", 1.0, "")]
    s = rank.package_summary(segments, items, 3).first()
    assert (s.considered_segments, s.truncated_by_top_k, s.truncated_by_budget, s.output_tokens) == (3, False, True, 5)
    assert rank.package(segments, 2, 100, 1).count() == 2 and rank.package(segments, 0).count() == 0
    assert rank.package_summary(segments, rank.package(segments, 2, 100, 1), 2, 1).first().output_tokens == 15


# ---------------------------------------------------------------- facts


def fact_rows(spark, *rows):
    """rows: (id, object, time, supersedes)"""
    return spark.createDataFrame([(i, "p", "u", "performer", "a", o, t, s) for i, o, t, s in rows], "id string, parent_memory_id string, user_id string, subject_key string, relation_key string, object_key string, event_time bigint, supersedes boolean")


def current(df):
    return {r.id for r in facts.apply_supersession(df).collect()}


def test_supersession(spark):
    assert current(fact_rows(spark, ("1", "x", 1, False), ("2", "y", 10, True), ("3", "y", 33, False))) == {"2", "3"}
    extra = fact_rows(spark, ("1", "x", 1, False), ("2", "y", 10, True), ("3", "z", 12, False), ("4", "z", None, False), ("5", "w", 10, True), ("6", "w", 11, False), ("7", "v", None, True), ("8", "o", 5, True))
    kept = facts.apply_supersession(extra)
    assert current(extra) == {"2", "4", "5", "6", "7"} == {r.id for r in facts.apply_supersession(kept).collect()}
    plain = fact_rows(spark, ("1", "x", 1, False), ("2", "y", None, True))
    assert current(plain) == {"1", "2"}


def test_rebinding(spark):
    cases = [("It is My cup and my tea", "It is Ann's cup and my tea"), ("I'm", "I'm"), ("I’s and I's", "Ann's and I's"), ("I like it", "Ann like it"), ("Is it? I like", "Is it? I like"), ("a\nSource quotation: my own", "a\nSource quotation: my own"), ("x my\nSource quotation: my", "x Ann's\nSource quotation: my"), ("$1 my \\ x", "$1 Ann's \\ x")]
    df = spark.createDataFrame([(a, b, "Ann") for a, b in cases], "t string, want string, owner string")
    for r in df.select("want", facts.rebind(F.col("t"), F.col("owner")).alias("got"), facts.rebind(F.col("t"), F.lit(None)).alias("same"), "t").collect():
        assert r.got == r.want and r.same == r.t


def test_make_facts_number_over_the_request(spark):
    records = spark.createDataFrame(
        [("b1", "u", "r", 0, 0, "user", "Anna likes tea", 0, "question", json.dumps([{"subject": "Anna", "relation": "likes", "object": "tea", "quote": "likes"}] * 2)), ("b2", "u", "r", 1, 2, "assistant", "ok", None, "answer", json.dumps([{"subject": "I", "relation": "said", "object": "ok", "quote": "ok", "supersedes": True}]))],
        "parent_memory_id string, user_id string, request_id string, local_index int, source_index int, role string, content string, timestamp bigint, side string, reply string",
    )
    got = {r.subject: r for r in facts.make_facts(facts.parse_fact_replies(records)).collect()}
    position = "model:2:1:said:ok"
    want = T.identity(*(F.lit(x) for x in (facts.VERSION, "u", "b2", "answer", position)))
    assert got["I"].id == spark.range(1).select(want.alias("x")).first().x
    assert got["Anna"].content == "Memory fact\nStatement: Anna — likes — tea.\nSource record date: 1970-01-01\nSource quotation: likes"
    assert got["I"].supersedes and got["I"].source_date == "" and got["I"].event_time is None


def test_coverage(spark):
    blocks = spark.createDataFrame([("b1", "u"), ("b2", "u"), ("b3", "v")], "id string, user_id string")
    empty = spark.createDataFrame([], schemas.COVERAGE)
    done = facts.mark_coverage(empty, spark.createDataFrame([("b1", "u"), ("b3", "u")], "parent_memory_id string, user_id string"), blocks)
    assert [r.parent_memory_id for r in done.collect()] == ["b1"] and facts.has_coverage(done, "b1") and not facts.has_coverage(done, "b2")
    assert [r.id for r in facts.unindexed_blocks(blocks, done, limit=1).collect()] == ["b2"]


def test_snippets_and_room(spark):
    found = spark.createDataFrame([("q", 1, " A fact. ", "p1"), ("q", 2, "a FACT", "p2"), ("q", 3, "", "p3"), ("q", 4, "other", "p4")], "query_id string, n int, content string, parent_memory_id string")
    snippets = facts.fact_snippets(found, 5)
    assert [(r.position, r.content) for r in snippets.orderBy("position").collect()] == [(0, "A fact."), (1, "other")]
    items = spark.createDataFrame([("q", 0, "m", "other", "", 1.0)], "query_id string, position int, id string, content string, created_at string, score double")
    got = facts.append_facts(items, snippets, 2).orderBy("position").collect()
    assert [(r.id, r.content) for r in got] == [("m", "other"), ("fact:1", "A fact.")]
    assert facts.append_facts(items, snippets, 1).count() == 1


# ---------------------------------------------------------------- multi-hop, metrics


def test_multi_hop_rounds(spark, tmp_path):
    def save(df, name):
        path = f"{tmp_path}/{random.random()}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    docs = spark.createDataFrame([("m1", "u", "the mayor is anna"), ("m2", "u", "anna lives in oslo"), ("m3", "u", "where the other is")], "memory_id string, user_id string, text string")
    index = retrieval.bm25_index(docs)
    queries = spark.createDataFrame([("q1", "u", "where does the mayor live"), ("q2", "u", "other"), ("q3", "u", "mayor")], "query_id string, user_id string, query string")
    plan = {"steps": [{"id": "s1", "query": "mayor", "depends_on": []}, {"id": "s2", "query": "{{s1}} lives", "depends_on": ["s1"]}]}
    plans = spark.createDataFrame([("q1", json.dumps(plan)), ("q2", "no plan"), ("q3", json.dumps(plan))], "query_id string, reply string")

    def answer(asked):
        good = F.when(F.col("query_id") == "q3", '{"status": "unresolved", "answer": null, "evidence": []}').otherwise('{"status": "answered", "answer": "anna", "evidence": [{"document_index": 0, "quote": "anna"}]}')
        return asked.withColumn("reply", good)

    bodies = docs.select("memory_id", F.lit("2024-01-01").alias("day"), F.col("text").alias("body"))
    found, stops = multihop.multi_hop_search(queries, lambda q: retrieval.bm25_topk(q, index), plans, answer, bodies, save)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    assert got["q1"] == ["m1", "m2"] and got["q2"] == ["m3"] and got["q3"] == ["m1"]
    assert {r.query_id: (r.stop_reason, r.recovery) for r in stops.collect()} == {"q1": ("plan_complete", "not_triggered"), "q2": ("plan_invalid", "success"), "q3": ("dependency_unresolved", "empty")}


def test_react_rounds(spark, tmp_path):
    def save(df, name):
        path = f"{tmp_path}/{random.random()}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    docs = spark.createDataFrame([("m1", "u", "the mayor is anna"), ("m2", "u", "anna lives in oslo"), ("m3", "u", "straße other")], "memory_id string, user_id string, text string")
    index = retrieval.bm25_index(docs)
    queries = spark.createDataFrame([("q1", "u", "mayor"), ("q2", "u", "Straße other"), ("q3", "u", "mayor"), ("q4", "u", "mayor"), ("q5", "u", "nothing here"), ("q6", "u", "mayor")], "query_id string, user_id string, query string")
    say = lambda done, picks, query, score: F.lit(json.dumps({"is_sufficient": done, "evidence_indices": picks, "new_query": query, "confidence_score": score}))
    shown = []

    def decide(asked):
        shown.extend(asked.collect())
        first = F.col("round") == 0
        reply = (
            F.when((F.col("query_id") == "q1") & first, say(False, [0], " anna lives ", 0.2)).when(F.col("query_id") == "q1", say(True, [1, 0], "", 0.9))
            .when(F.col("query_id") == "q2", say(False, [0], "STRASSE  other", 0.2)).when(F.col("query_id") == "q3", "no object").when(F.col("query_id") == "q5", say(True, [], "", 0.1))
            .when(F.col("query_id") == "q6", F.concat(F.lit('{"is_sufficient": false, "evidence_indices": [], "confidence_score": 0, "new_query": "anna '), F.col("round").cast("string"), F.lit('"}')))
        )
        return asked.withColumn("reply", reply).withColumn("error", F.when(F.col("query_id") == "q4", "timeout"))

    bodies = docs.select("memory_id", F.lit("").alias("day"), F.col("text").alias("body"))
    found, stops = multihop.react_search(queries, lambda q: retrieval.bm25_topk(q, index), decide, bodies, save)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    assert got["q1"] == ["m1", "m2"] and got["q2"] == ["m3"] and got["q3"] == ["m1"] and "q5" not in got
    by = {r.query_id: r for r in stops.collect()}
    assert {q: (r.stop_reason, r.rounds) for q, r in by.items()} == {
        "q1": ("sufficient", 2), "q2": ("duplicate_query", 1), "q3": ("invalid_output", 1), "q4": ("llm_error", 1), "q5": ("low_confidence", 1), "q6": ("max_rounds", 4)
    }
    second = next(r for r in shown if r.query_id == "q1" and r["round"] == 1)
    assert second.ids == ["m2", "m1"] and list(second.used_queries) == ["mayor", "anna lives"]  # new documents, then those picked before
    assert by["q1"].evidence == ["m1", "m2"] and by["q1"].rerank_query == "mayor\nanna lives"


def test_multi_hop_faults_and_rerank(spark, tmp_path):
    def save(df, name):
        path = f"{tmp_path}/{random.random()}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    docs = spark.createDataFrame([("m1", "u", "mayor anna"), ("m2", "u", "mayor bert bert"), ("m3", "u", "where")], "memory_id string, user_id string, text string")
    index = retrieval.bm25_index(docs)
    queries = spark.createDataFrame([(f"q{i}", "u", "where mayor") for i in range(1, 5)], "query_id string, user_id string, query string")
    plan = json.dumps({"steps": [{"id": "s1", "query": "mayor", "depends_on": []}]})
    plans = spark.createDataFrame([("q1", plan, None), ("q2", plan, None), ("q3", None, "timeout")], "query_id string, reply string, error string")  # none for q4

    def answer(asked):
        return asked.withColumn("reply", F.lit('{"status": "answered", "answer": "anna", "evidence": []}')).withColumn("error", F.when(F.col("query_id") == "q2", "unavailable"))

    bodies = docs.select("memory_id", F.lit("").alias("day"), F.col("text").alias("body"))
    rerank = lambda c, q: rank.score_pairs(c, q, docs, lambda qs, ts: [float(len(t)) for t in ts])
    found, stops = multihop.multi_hop_search(queries, lambda q: retrieval.bm25_topk(q, index), plans, answer, bodies, save, rerank=rerank)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    assert got["q1"] == ["m2", "m1"] and got["q2"] == ["m2", "m1", "m3"] and set(got["q4"]) == {"m1", "m2", "m3"} and "q3" not in got
    assert {r.query_id: (r.stop_reason, r.recovery, r.rerank_query) for r in stops.collect()} == {
        "q1": ("plan_complete", "not_triggered", "mayor"), "q2": ("llm_unavailable", "success", "where mayor"), "q3": ("llm_error", "not_triggered", "where mayor"), "q4": ("llm_unavailable", "success", "where mayor"),
    }


def test_search_with_routes(spark, tmp_path):
    """Default, multi-hop and unusable queries in one search; reranked, expanded, packed, facts appended."""
    def save(df, name):
        path = f"{tmp_path}/{random.random()}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    blocks = ingest.compose_blocks(ingest.messages_of(requests(spark, ("r", [("user", "red fox", 1), ("assistant", "yes", 2), ("user", "blue sky", 3), ("assistant", "no", 4)], 0)))).cache()
    memory = search.Memory(blocks, retrieval.bm25_index(blocks.select(F.col("id").alias("memory_id"), "user_id", T.render(F.col("question"), F.col("answer")).alias("text"))))
    queries = spark.createDataFrame([("q1", "user1", "fox", 3), ("q2", "user1", "hop", 3), ("q3", "user1", " ", 3), ("q4", "user1", "fox", 0), ("q5", "other", "fox", 3), ("q6", "user1", "sky", 3)], "query_id string, user_id string, query string, top_k int")
    routes = spark.createDataFrame([("q2", "MULTI_HOP"), ("q6", "MULTI_HOP")], "query_id string, route string")
    second = blocks.where("question = 'blue sky'").select(F.lit("q2").alias("query_id"), F.col("id").alias("memory_id"), F.lit(0).alias("rank"))
    stops = spark.createDataFrame([("q2", "sufficient", "joint"), ("q6", "llm_error", "sky")], "query_id string, stop_reason string, rerank_query string")
    seen = []
    rerank = lambda c, q: (seen.extend(q.collect()), rank.score_pairs(c, q, memory.texts, lambda qs, ts: [1.0] * len(ts)))[1]
    items, notes = search.search(queries, memory, save, rerank=rerank, routes=routes, multi_hop=lambda q: (second, stops))
    got = {(r.query_id, r.position): r.content for r in items.collect()}
    both = "Q: red fox\nA: [assistant] yes\nQ: blue sky\nA: [assistant] no"
    assert got == {("q1", 0): both, ("q2", 0): both, ("q6", 0): both}
    by = {r.query_id: r for r in notes.collect()}
    assert by["q1"].rerank_status == "called" and by["q1"].route == "DEFAULT" and by["q2"].stop_reason == "sufficient" and by["q5"].rerank_status == "disabled"
    assert {r.query_id: r.query for r in seen}["q2"] == "joint"
    blocks.unpersist()


def test_metrics_count_only_calls(spark):
    df = spark.createDataFrame([(1.0, None, None, 1, "a"), (2.0, 4.0, None, 2, "")], "latency_ms double, router_latency_ms double, multi_hop_latency_ms double, n int, route string")
    m = metrics.search_metrics(df, ["n"]).first()
    assert (m.searches, m.n, m.latency_ms_mean, m.router_latency_ms_calls, m.router_latency_ms_mean, m.multi_hop_latency_ms_mean) == (2, 3, 1.5, 1, 4.0, None)
    assert [tuple(r) for r in metrics.category_counts(df, ["route"]).collect()] == [("route", "a", 1)]
