"""Tables under the commit log: commits, pruning, merge, compaction, the registry's filters, and jobs that break off anywhere."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators import add, facts, ingest, membership, tables
from mnemospark.streaming import jobs
from mnemospark.streaming import tables as stored
from mnemospark.streaming.jobs import ingest_batch, known_requests, maintain
from mnemospark.streaming.tables import ConflictError, Tables
from tests.test_memory import requests

KV = "k bigint, v string, user_id string"


def kv(spark, *rows):
    return spark.createDataFrame([(k, v, f"u{k % 5}") for k, v in rows], KV)


def make(tmp_path, **layouts):
    return Tables(f"{tmp_path}/t", stored.LAYOUTS | {"kv": ("user_id", 8)} | layouts)


def content(spark, t, name="kv", schema=KV, at=None):
    return sorted(map(tuple, t.read(spark, name, schema, at).collect()))


def files(t, name="kv"):
    return sorted(os.path.relpath(os.path.join(d, f), t.path(name)) for d, _, fs in os.walk(t.path(name)) for f in fs if f.endswith(".parquet"))


def live_files(spark, t, name="kv", schema=KV):
    return sorted(t.read(spark, name, schema).inputFiles())


# ---------------------------------------------------------------- commits and readers


def test_a_commit_counts_whole_and_once(spark, tmp_path, monkeypatch):
    t = make(tmp_path)
    assert t.commit(spark, "a-0", {"kv": kv(spark, (1, "x")), "other": kv(spark, (7, "o"))})
    assert not t.commit(spark, "a-0", {"kv": kv(spark, (2, "again"))})
    assert t.commit(spark, "a-1", {"kv": kv(spark, (2, "y"))}) and not t.commit(spark, "a-0", {"kv": kv(spark, (3, "late"))})
    # what a job leaves that breaks before its log entry is never read
    with monkeypatch.context() as m:
        m.setattr(stored._Files, "create", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.commit(spark, "a-2", {"kv": kv(spark, (4, "z")), "other": kv(spark, (8, "p"))})
    assert content(spark, t) == [(1, "x", "u1"), (2, "y", "u2")] and content(spark, t, "other") == [(7, "o", "u2")]
    assert t.commit(spark, "a-2", {"kv": kv(spark, (4, "z"))}) and len(content(spark, t)) == 3
    assert content(spark, t, "missing") == [] and [r.name for r in t.history(spark).orderBy("seq").collect()] == ["a-0", "a-1", "a-2"]
    assert [r.v for r in t.of_commit(spark, "kv", KV, "a-1").collect()] == ["y"]


def test_the_log_is_read_from_its_last_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "CHECKPOINT_EVERY", 3)
    t = make(tmp_path)
    for i in range(8):
        t.commit(spark, f"s-{i}", {"kv": kv(spark, (i, str(i)))}, notes={"set x": str(i), "other": "1"})
    before = t.snapshot(spark)
    for n in os.listdir(t.path("log")):
        if n.endswith(".json") and n < "000000000005" and not n.startswith("."):
            os.remove(t.path(f"log/{n}"))
    after = t.snapshot(spark)
    assert (after.seq, after.folders, after.streams, after.notes) == (before.seq, before.folders, before.streams, {"set x": "7"}) and after.seq == 7
    assert len(content(spark, t)) == 8 and not t.commit(spark, "s-3", {"kv": kv(spark, (99, "no"))})


def test_two_writers_take_turns(spark, tmp_path, monkeypatch):
    t, create, raced = make(tmp_path), stored._Files.create, []

    def race(self, name, text):
        if not raced:
            raced.append(True)
            assert t.commit(spark, "b-0", {"kv": kv(spark, (2, "second"))})
        return create(self, name, text)

    monkeypatch.setattr(stored._Files, "create", race)
    assert t.commit(spark, "a-0", {"kv": kv(spark, (1, "first"))})
    assert [v for _, v, _ in content(spark, t)] == ["first", "second"] and t.snapshot(spark).seq == 1


def test_readers_open_the_folders_of_their_buckets_only(spark, tmp_path):
    t = make(tmp_path, blocks=("user_id", 16))
    blocks = ingest.compose_blocks(ingest.messages_of(requests(spark, *((f"r{i}", [("user", f"x{i}", i)], 0) for i in range(40))))).withColumn("user_id", F.concat(F.lit("user"), F.col("request_id")))
    t.commit(spark, "a-0", {"blocks": blocks})
    scan = t.scan(spark, "blocks", schemas.BLOCK)
    one = tables.read_blocks(scan, "userr7", buckets=16)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and [r.question for r in one.collect()] == ["x7"]
    assert one.collect() == tables.read_blocks(scan, "userr7").collect()
    opened = lambda df: df.select(F.col("_metadata.file_path").alias("f")).distinct().count()
    assert opened(scan.where(F.col("bucket") == one.first().bucket)) == 1 < opened(scan)
    assert [r.question for r in tables.blocks_of_request(scan, "r9", "userr9", 16).collect()] == ["x9"]
    ids = one.select(F.array("id", F.lit("unknown")).alias("ids"), F.lit("userr7").alias("of"))
    found = tables.fetch_by_ids(scan, ids, user_col="of", buckets=16)
    assert [r.question for r in found.collect()] == ["x7"] and "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert tables.fetch_by_ids(scan, ids.limit(0), user_col="of", buckets=16).count() == 0
    named = t.scan(spark, "blocks", schemas.BLOCK, [one.first().bucket])
    assert len(named.inputFiles()) == 1 and named.where("user_id = 'userr7'").count() == 1


# ---------------------------------------------------------------- merge and compaction


@pytest.mark.parametrize("mode", ["replace", "ignore"])
def test_merge_writes_only_what_holds_its_keys(spark, tmp_path, mode):
    t = make(tmp_path)
    for i in range(3):
        t.commit(spark, f"a-{i}", {"kv": kv(spark, *((k, f"old{k}") for k in range(10 * i, 10 * i + 10)))})
    old, before = t.read(spark, "kv", KV), live_files(spark, t)
    want_of = old.collect()
    incoming = kv(spark, (3, "new"), (3, "newer"), (13, "new"), (40, "fresh"), (41, "fresh"))
    want = sorted(map(tuple, tables.upsert(spark.createDataFrame(want_of, KV), incoming, ["k", "user_id"], mode).collect()))
    hit = t.merge(spark, "kv", "m-0", incoming, ["k", "user_id"], KV, mode)
    assert content(spark, t) == want
    after = set(live_files(spark, t))
    gone = [f for f in before if f not in after]
    if mode == "ignore":
        assert hit == [] and not gone
    else:  # keys 3 and 13 lie in one bucket of two commits
        assert len(hit) == 2 and gone and all(any(h in f for h in hit) for f in gone) and len(gone) < len(before) / 2
    t.merge(spark, "kv", "m-0", kv(spark, (3, "twice")), ["k", "user_id"], KV, mode)  # a repeated commit changes nothing
    assert content(spark, t) == want


def test_merge_arguments(spark, tmp_path):
    t = make(tmp_path)
    with pytest.raises(ValueError):
        t.merge(spark, "kv", "m", kv(spark, (1, "a")), ["k"], KV)
    with pytest.raises(ValueError):
        t.merge(spark, "kv", "m", kv(spark, (1, "a")), ["k", "user_id"], KV, "both")
    t.merge(spark, "kv", "m", kv(spark, (1, "a")), ["k", "user_id"], KV)  # into an empty table
    assert content(spark, t) == [(1, "a", "u1")]
    with pytest.raises(ConflictError):
        t.commit(spark, "n", {}, {"kv": ["commit=unknown/bucket=0"]})


def test_compaction_bounds_files_and_readers_see_one_version(spark, tmp_path, monkeypatch):
    t = make(tmp_path)
    for i in range(12):
        t.commit(spark, f"a-{i}", {"kv": kv(spark, *((10 * i + j, "v") for j in range(5)))})
        if i % 4 == 3:
            t.compact(spark, "kv", KV, most=3)
    want = sorted((10 * i + j, "v", f"u{(10 * i + j) % 5}") for i in range(12) for j in range(5))
    assert content(spark, t) == want
    buckets = {f.split("bucket=")[1].split("/")[0] for f in live_files(spark, t)}
    assert len(live_files(spark, t)) == len(buckets) < 12  # one file a bucket
    # a reader from before a compaction, a commit in the middle of one, and two compactions at once
    reader, at = t.read(spark, "kv", KV), t.snapshot(spark)
    for i in range(4):
        t.commit(spark, f"b-{i}", {"kv": kv(spark, (1000 + i, "w"), (1005 + i, "w"))})
    write, between = t._write, []

    def meanwhile(action):
        def late(*args):
            out = write(*args)
            monkeypatch.setattr(t, "_write", write)
            between.append(action())
            return out

        monkeypatch.setattr(t, "_write", late)

    meanwhile(lambda: t.commit(spark, "c-0", {"kv": kv(spark, (2000, "c"))}))
    assert t.compact(spark, "kv", KV, most=2) > 0 and between == [True]  # a commit that only adds does no harm
    for i in range(3):
        t.commit(spark, f"d-{i}", {"kv": kv(spark, (3000 + 5 * i, "d"))})
    everything = content(spark, t)
    meanwhile(lambda: t.compact(spark, "kv", KV, most=1))
    assert t.compact(spark, "kv", KV, most=1) == 0 and between[1] > 0  # the other one was first
    assert content(spark, t) == everything and len(everything) == len(want) + 8 + 1 + 3
    assert sorted(map(tuple, reader.collect())) == want == content(spark, t, at=at)
    live = set(live_files(spark, t))
    assert t.vacuum(spark, keep_seconds=3600) == 0 and sorted(map(tuple, reader.collect())) == want
    assert t.vacuum(spark, keep_seconds=0) > 0
    assert content(spark, t) == everything and {os.path.basename(f) for f in live} == {os.path.basename(f) for f in files(t)}


# ---------------------------------------------------------------- the registry and its filters


def asked(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "request_id string")


def opened(df):
    return sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles())


def test_filters_rule_out_new_ids_and_never_known_ones(spark):
    bucket = stored.hash_bucket(F.col("request_id"), 4)
    known = asked(spark, [f"k{i}" for i in range(3000)]).withColumn("bucket", bucket)
    other = asked(spark, [f"n{i}" for i in range(3000)] + [None]).withColumn("bucket", bucket)
    for chunks in (1, 4):
        parts = membership.filter_of(known.where("request_id < 'k2'"), "request_id", chunks).unionByName(membership.filter_of(known.where("request_id >= 'k2'"), "request_id", 2))
        for filters in (parts, membership.merged(parts)):
            assert membership.may_hold(known, "request_id", filters).count() == 3000
            assert membership.may_hold(other, "request_id", filters).count() < 60
    assert membership.may_hold(known, "request_id", parts.limit(0)).count() == 0
    assert [membership.chunks_for(n, 64) for n in (0, 1, 131_072, 131_073, 1_000_000)] == [1, 1, 1, 2, 8]


def test_lookup_reads_what_the_batch_needs_and_not_the_registry(spark, tmp_path):
    t = make(tmp_path)
    sizes = []
    for n in range(3):
        rows = spark.range(n * 20_000, n * 20_000 + (20_000 if n else 500)).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit("u").alias("user_id"), F.lit("s").alias("session_id"), F.sha2(F.col("id").cast("string"), 256).alias("payload_hash"), F.lit(0).cast("long").alias("applied_at"))
        t.commit(spark, f"a-{n}", {"applied": rows, "applied_filter": membership.filter_of(t.bucketed("applied", rows), "request_id", jobs._filter_chunks(t.snapshot(spark)))})
        maintain(spark, t, most=1)
        new = asked(spark, [f"new{i}" for i in range(20)])
        assert opened(known_requests(spark, t, new)) <= opened(t.read(spark, "applied", schemas.APPLIED)) / 16
        touched = [r.bucket for r in t.bucketed("applied", new).select("bucket").distinct().collect()]
        sizes.append(opened(t.scan(spark, "applied_filter", membership.FILTER, touched)))
    assert sizes[2] <= 20 * (4096 + 2000) * 2  # a chunk of 4 KB for each id and folder, and the files' own footers
    found = known_requests(spark, t, asked(spark, ["r3", "new1", "r25000", None]))
    assert {"r3", "r25000"} <= {r.request_id for r in found.collect()} and found.count() < t.read(spark, "applied", schemas.APPLIED).count() / 8


def test_the_filter_grows_with_the_registry(spark, tmp_path, monkeypatch):
    t = make(tmp_path, applied=("request_id", 2))
    ids = [f"r{i}" for i in range(300)]
    for n, part in enumerate((ids[:100], ids[100:])):
        ingest_batch(requests(spark, *((r, "ua", 0) for r in part)), t, f"s-{n}")
        if not n:
            monkeypatch.setattr(membership, "chunks_for", lambda n, buckets: 4)
            assert maintain(spark, t) > 0 and jobs._filter_chunks(t.snapshot(spark)) == 4
    assert {r.chunks for r in t.scan(spark, "applied_filter", membership.FILTER).select("chunks").distinct().collect()} == {4}
    ingest_batch(requests(spark, ("r5", "ua", 0), ("r250", "u", 1), ("r999", "u", 2)), t, "s-2")
    assert t.read(spark, "applied", schemas.APPLIED).count() == 301
    conflicts = t.read(spark, "conflicts", "request_id string").collect()
    assert [r.request_id for r in conflicts] == ["r250"]


def test_equal_numbers_have_one_outcome(spark):
    rows = [("r", text, 0) for text in ("ua", "u", "uaua")]
    seen = set()
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        incoming = ingest.payload_fingerprint(requests(spark, *(rows[i] for i in order))).repartition(3)
        got = ingest.resolve_batches(incoming, spark.createDataFrame([], "request_id string, payload_hash string")).collect()
        assert sorted(r.outcome for r in got) == ["conflict", "conflict", "new"]
        seen.add(next(r.payload_hash for r in got if r.outcome == "new"))
    assert len(seen) == 1


# ---------------------------------------------------------------- the Add job


REPLIES = {"Anna": [{"subject": "Anna", "relation": "likes", "object": "tea", "quote": "likes"}], "Bert": [{"subject": "Bert", "relation": "drinks", "object": "tea", "quote": "drinks"}], "none": []}
TERMS = ["anna", "bert", "tea", "likes", "drinks", "none", "here"]


class Model:
    """Counts what it is asked; fails for records with a word in `ill`."""

    def __init__(self, folder, ill=()):
        self.folder, self.ill = folder, ill
        os.makedirs(folder, exist_ok=True)

    def calls(self):
        return sorted(line for n in os.listdir(self.folder) for line in open(f"{self.folder}/{n}").read().split("\n") if line)

    def extract(self, records):
        folder, ill = self.folder, self.ill

        @F.udf("string")
        def reply(content):
            with open(f"{folder}/{os.getpid()}-{random.random()}", "w") as f:
                f.write(f"extract {content}\n")
            return None if any(x in content for x in ill) else json.dumps(next((v for k, v in REPLIES.items() if k in content), []))

        return records.withColumn("reply", reply.asNondeterministic()("content"))

    def encode(self, texts):
        with open(f"{self.folder}/{os.getpid()}-{random.random()}", "w") as f:
            f.write("".join(f"encode {t!r}\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]


def job(spark, t, model, tmp_path):
    def save(df, name):
        path = f"{tmp_path}/{random.random()}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    add.derive(spark, t, model.encode, "toy", save, TERMS, model.extract)


def source(spark, t):
    ingest_batch(requests(spark, ("r1", [("user", "Anna likes tea", 5), ("assistant", "ok", 6), ("user", "Bert drinks tea", 7)], 0), ("r2", [("user", "none drinks tea", 8)], 0), ("r3", [("user", "other", 9)], 0)), t, "in-0")


#: Few buckets, so that the jobs below write few files.
FEW = {name: (key, 2) for name, (key, _) in stored.LAYOUTS.items()}
DERIVED = {"facts": schemas.FACT, "coverage": schemas.COVERAGE, "extracted": schemas.EXTRACTED, "replies": schemas.REPLY, "index": schemas.INDEX, "cache": schemas.CACHE, "rejected_facts": add.REJECTED}


def derived(spark, t):
    return {name: sorted(map(str, t.read(spark, name, schema).collect())) for name, schema in DERIVED.items()}


def test_the_add_job_goes_on_after_any_break(spark, tmp_path, monkeypatch):
    whole = Tables(f"{tmp_path}/whole", FEW)
    source(spark, whole)
    model = Model(f"{tmp_path}/calls-whole")
    job(spark, whole, model, tmp_path)
    want, calls = derived(spark, whole), model.calls()
    assert [len(want[n]) for n in ("facts", "coverage", "extracted", "replies", "index")] == [2, 2, 4, 3, 4]
    job(spark, whole, model, tmp_path)
    assert derived(spark, whole) == want and model.calls() == calls  # a repeated run adds nothing and calls nothing
    steps = [r.notes["step"] for r in whole.history(spark).orderBy("seq").collect() if "step" in r.notes]
    assert steps == ["replies", "facts", "vectors", "index"]

    commit = Tables.commit
    for broken in steps:  # after each commit, which is before the next one
        t, model = Tables(f"{tmp_path}/{broken}", FEW), Model(f"{tmp_path}/calls-{broken}")
        source(spark, t)

        def fail(self, spark, name, *args, _step=broken, **kwargs):
            out = commit(self, spark, name, *args, **kwargs)
            if name.startswith(_step):
                raise RuntimeError("broken")
            return out

        monkeypatch.setattr(Tables, "commit", fail)
        with pytest.raises(RuntimeError):
            job(spark, t, model, tmp_path)
        monkeypatch.setattr(Tables, "commit", commit)
        job(spark, t, model, tmp_path)
        assert derived(spark, t) == want, broken
        assert model.calls() == calls, broken  # every record and text went to its model once


def test_failed_records_are_asked_again_and_their_request_waits(spark, tmp_path):
    whole, t = Tables(f"{tmp_path}/whole", FEW), Tables(f"{tmp_path}/t", FEW)
    for x in (whole, t):
        source(spark, x)
    job(spark, whole, Model(f"{tmp_path}/calls-whole"), tmp_path)
    model = Model(f"{tmp_path}/calls", ill=["Bert"])
    job(spark, t, model, tmp_path)
    assert t.read(spark, "facts", schemas.FACT).count() == 0 and t.read(spark, "extracted", schemas.EXTRACTED).count() == 2 and t.read(spark, "index", schemas.INDEX).count() == 4
    model.ill = ()
    job(spark, t, model, tmp_path)
    assert derived(spark, t) == derived(spark, whole)
    assert [c for c in model.calls() if "extract" in c] == ["extract Anna likes tea", "extract Bert drinks tea", "extract Bert drinks tea", "extract none drinks tea"]


def test_coverage_comes_from_stored_facts(spark, tmp_path):
    t, model = Tables(f"{tmp_path}/t", FEW), Model(f"{tmp_path}/calls")
    source(spark, t)
    job(spark, t, model, tmp_path)
    want, calls = derived(spark, t), model.calls()
    now = t.snapshot(spark)
    t.commit(spark, "drop", {}, {n: list(now.folders[n]) for n in ("coverage", "extracted")})
    assert t.read(spark, "coverage", schemas.COVERAGE).count() == 0
    job(spark, t, model, tmp_path)
    assert derived(spark, t) == want and model.calls() == calls


def test_a_committed_batch_that_broke_before_its_derived_data(spark, tmp_path):
    t, ran = Tables(f"{tmp_path}/t"), []
    df = requests(spark, ("r1", "ua", 0))
    ingest_batch(df, t, "in-0")
    ingest_batch(df, t, "in-0", lambda blocks: ran.append(blocks.count()))
    assert ran == [1] and t.read(spark, "blocks", schemas.BLOCK).count() == 1
    assert facts.unindexed_blocks(t.read(spark, "blocks", schemas.BLOCK), spark.createDataFrame([], schemas.COVERAGE)).count() == 1


def test_legacy_tables_are_taken_over(spark, tmp_path):
    """An old registry without hashes, blocks with other ids, their messages."""
    new = ingest.messages_of(requests(spark, ("r1", "uaua", 0), ("r2", "u", 0)))
    blocks, messages = ingest.compose_blocks(new), ingest.explode_messages(new)
    old = blocks.withColumns({"id": F.concat(F.lit("x"), "id"), "prev_memory_id": F.lit("gone")}).drop("status")
    applied = spark.createDataFrame([("r1", "user1", "s"), ("r2", "user1", "s"), ("r2", "user1", "s")], "request_id string, user_id string, session_id string")
    t = Tables(f"{tmp_path}/t", FEW)
    assert jobs.adopt_legacy(spark, t, old, applied, messages.withColumn("parent_memory_id", F.concat(F.lit("x"), "parent_memory_id")))
    assert not jobs.adopt_legacy(spark, t, old, applied)
    links = lambda df: sorted((r.id, r.prev_memory_id, r.next_memory_id) for r in df.collect())
    assert links(t.read(spark, "blocks", schemas.BLOCK)) == links(blocks)
    assert sorted(r.parent_memory_id for r in t.read(spark, "messages", schemas.BLOCK_MESSAGE).collect()) == sorted(r.parent_memory_id for r in messages.collect())
    assert sorted((r.request_id, r.payload_hash) for r in t.read(spark, "applied", schemas.APPLIED).collect()) == [("r1", None), ("r2", None)]
    ingest_batch(requests(spark, ("r1", "a", 0), ("r3", "u", 1)), t, "in-0")
    assert t.read(spark, "blocks", schemas.BLOCK).count() == blocks.count() + 1 and t.read(spark, "conflicts", "request_id string").count() == 0
