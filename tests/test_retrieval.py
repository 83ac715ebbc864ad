"""Postings, blocks with maxima, and vectors of one large user."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import retrieval

DOCS = "memory_id string, user_id string, text string"


def corpus(spark, n=3000, seed=5):
    """One user has most memories; `the` is in nearly all, other words get rarer."""
    rng, rows = random.Random(seed), []
    for d in range(n):
        w = ["the"] * rng.choice([0, 1, 1, 2, 5]) + rng.choices([f"w{i}" for i in range(200)], [1 / (i + 1) for i in range(200)], k=rng.randrange(1, 40))
        rng.shuffle(w)
        rows.append((f"m{d:05d}", "big" if rng.random() < 0.9 else f"u{d % 3}", " ".join(w)))
    rows += [("empty", "big", ""), ("null", "big", None), ("marks", "big", " .,; "), ("case", "u1", "THE The the Été été")]
    return spark.createDataFrame(rows, DOCS), rows


def brute(rows, queries, k, by_user):
    terms = lambda t: [w for w in (t or "").lower().replace(".", " ").replace(",", " ").replace(";", " ").split()]
    found = {}
    for q, user, text in queries:
        scope = [(m, terms(t)) for m, u, t in rows if (u == user or not by_user) and terms(t)]
        n, mean = len(scope), sum(len(w) for _, w in scope) / max(1, len(scope))
        df = Counter(x for _, w in scope for x in set(w))
        scores = {}
        for m, u, t in rows:
            tf, length = Counter(terms(t)), len(terms(t))
            hit = [x for x in set(terms(text)) if tf[x]]
            if u == user and hit:
                scores[m] = round(sum(math.log((n - df[x] + 0.5) / (df[x] + 0.5) + 1) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * length / mean)) for x in hit), 6)
        best = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
        found |= {(q, i): s for i, (_, s) in enumerate(best)}
    return found


QUERIES = [("q1", "big", "the"), ("q2", "big", "the w0 w1"), ("q3", "big", "w150"), ("q4", "u1", "été THE"), ("q5", "big", "nowhere"), ("q6", "big", "the the w199 w3"), ("q7", "u9", "the")]


@pytest.mark.parametrize("scope", ["corpus", "user"])
def test_blocks_give_the_same_answers(spark, tmp_path, scope):
    def save(df, name):
        path = f"{tmp_path}/{random.random()}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    docs, rows = corpus(spark)
    queries = spark.createDataFrame(QUERIES, "query_id string, user_id string, query string")
    plain = retrieval.bm25_index(docs, scope, save=save)
    blocks = retrieval.block_index(plain, save, block=16)
    for k in (5, 200):
        want = brute(rows, QUERIES, k, scope == "user")
        for index in (plain, blocks):
            got = retrieval.bm25_topk(queries, index, k).collect()
            assert {(r.query_id, r["rank"]): r.score for r in got} == pytest.approx(want, abs=2e-6)
        by_id = lambda index: sorted((r.query_id, r.memory_id, round(r.score, 5)) for r in retrieval.bm25_topk(queries, index, k).collect())
        assert by_id(plain) == by_id(blocks)
    assert sum(r.n for r in blocks.heads.collect()) == plain.postings.count() and blocks.blocks.selectExpr("max(size(rows))").first()[0] < 64


def test_blocks_are_full_after_one_shuffle(spark, monkeypatch):
    docs, _ = corpus(spark)
    plain, plans = retrieval.bm25_index(docs), []

    def save(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    whole = retrieval.block_index(plain, save, block=16).blocks
    assert plans[0].count("Exchange hashpartitioning") + plans[0].count("Exchange rebalance") <= 1
    words = {(r.user_id, r.term): r for r in whole.groupBy("user_id", "term").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.countDistinct("part").alias("parts")).collect()}
    assert all(r.blocks == r.parts == -(-r.n // 16) for r in words.values())
    assert not whole.where("n <> size(rows) or top <> array_max(transform(rows, r -> r.impact))").count()
    monkeypatch.setattr(retrieval, "SLICE_POSTINGS", 100)  # the default's blocks, cut anew in small slices, hold the same postings
    by_slices = retrieval.block_index(plain, save, block=16).blocks
    assert by_slices.count() > whole.count()
    rows = lambda b: sorted(b.select("user_id", "term", F.inline("rows")).collect())
    assert rows(by_slices) == rows(whole)


def test_blocks_leave_most_postings_of_common_words_unread(spark, tmp_path):
    def save(df, name):
        path = f"{tmp_path}/{random.random()}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    docs, _ = corpus(spark, 6000)
    blocks = retrieval.block_index(retrieval.bm25_index(docs, save=save), save, block=16)
    queries = spark.createDataFrame([("q1", "big", "the"), ("q2", "big", "w0"), ("q3", "big", "the w150")], "query_id string, user_id string, query string")
    read = {r.query_id: r.n for r in retrieval.needed_blocks(queries, blocks, 10).groupBy("query_id").agg(F.sum("n").alias("n")).collect()}
    whole = {r.query_id: r.n for r in blocks.heads.join(queries.select("query_id", "user_id", F.explode(F.split("query", " ")).alias("term")), ["user_id", "term"]).groupBy("query_id").agg(F.sum("n").alias("n")).collect()}
    print("postings read of all", read, whole)
    assert read["q1"] < whole["q1"] / 8 and read["q2"] < whole["q2"] / 8 and read["q3"] <= whole["q3"]
    assert retrieval.bm25_topk(queries.limit(0), blocks).count() == 0


def test_terms_of_a_large_batch_are_counted_in_bounded_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(retrieval, "SLICE_TERMS", 1 << 12, raising=False)
    rng = random.Random(3)
    texts = [rng.choices([f"w{i}" for i in range(3000)], k=rng.choice([0, 1, 400, 700])) for _ in range(600)] + [None, ["x"] * 5000, ["y", "y"]]
    batch = pa.RecordBatch.from_arrays([pa.array([f"m{i}" for i in range(len(texts))]), pa.array(["u"] * len(texts)), pa.array(texts, pa.list_(pa.string()))], ["memory_id", "user_id", "terms"])
    most, rows = 0, 0
    tracemalloc.start()
    for out in retrieval._counted(iter([batch])):  # numpy's arrays are traced, Arrow's are of like size
        most, rows = max(most, tracemalloc.get_traced_memory()[1], out.nbytes), rows + out.num_rows
    tracemalloc.stop()
    assert rows == sum(len(set(t or [])) for t in texts) and most < 1 << 20
    got = [r for out in retrieval._counted(iter([batch.slice(100)])) for r in out.to_pylist()]
    want = {(f"m{i}", w): n for i, t in enumerate(texts) if i >= 100 for w, n in Counter(t or []).items()}
    assert {(r["memory_id"], r["term"]): r["tf"] for r in got} == want and len(got) == len(want)
    assert sum(r["first"] for r in got) == sum(bool(t) for t in texts[100:]) and all(r["length"] == len(texts[int(r["memory_id"][1:])]) for r in got)


def test_a_user_with_most_vectors_is_spread_without_adaptive_execution(spark):
    rng = random.Random(2)
    rows = [(f"m{i}", "big" if i % 10 else f"u{i % 3}", [rng.random() for _ in range(4)]) for i in range(9000)]
    index = spark.createDataFrame(rows, "memory_id string, user_id string, dense array<float>")
    queries = spark.createDataFrame([(f"q{i}", "big" if i % 2 else "u0", [1.0, 0.5, 0.2, float(i)]) for i in range(6)], "query_id string, user_id string, dense array<float>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    block = retrieval.BLOCK_BYTES
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        retrieval.BLOCK_BYTES = 64 * 8 * 4  # 64 vectors
        got = retrieval.dense_topk(queries, index, 20, per_salt=2)
        met, run = [], retrieval._best_of_blocks

        def counted(k):
            inner = run(k)

            def go(batches):
                from pyspark import TaskContext

                n = 0
                for batch in batches:
                    n += batch.num_rows
                    yield from inner(iter([batch]))
                with open(f"/tmp/{token}-{TaskContext.get().partitionId()}", "w") as f:
                    f.write(str(n))

            return go

        import glob
        import uuid

        token = f"spark-salts-{uuid.uuid4().hex}"
        retrieval._best_of_blocks = counted
        want = sorted(map(tuple, got.collect()))
        again = retrieval.dense_topk(queries, index, 20, per_salt=2).collect()
        met = [int(open(f).read()) for f in glob.glob(f"/tmp/{token}-*")]
        assert sorted(map(tuple, again)) == want and sum(n > 0 for n in met) == 8 and max(met) < 0.4 * sum(met)
    finally:
        retrieval.BLOCK_BYTES, retrieval._best_of_blocks = block, run
        for k, v in before.items():
            spark.conf.set(k, v)
    one = retrieval.dense_topk(queries, index, 20)
    assert sorted(map(tuple, one.collect())) == want


def test_infinite_vectors_are_quarantined(spark):
    from mnemospark.operators import embed

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, float("inf")]), (3, [float("-inf"), 0.0]), (4, [float("nan"), 0.0])], "i int, vec array<float>")
    good, bad = embed.check_dimensions(df, 2)
    assert [r.i for r in good.collect()] == [1] and sorted(r.i for r in bad.collect()) == [2, 3, 4]
