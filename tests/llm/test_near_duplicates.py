"""MinHash groups, components and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from mnemospark.llm import decontaminate, minhash
from mnemospark.llm.common import BITMAP
from mnemospark.llm.components import components
from mnemospark.llm.queries import op2_decontamination
from tests.llm.conftest import table, words


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(rows, k, percent=80):
    sets = {d: shingles(t, k) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def corpus(seed=3):
    """Chains and stars of edited copies, exact copies and unrelated texts."""
    rng = random.Random(seed)
    rows, n = [], 100
    for _ in range(12):
        base = words(rng, rng.randrange(30, 200), 3000)
        for _ in range(rng.randrange(1, 9)):
            rows.append((n, " ".join(base).title() if rng.random() < 0.3 else " ".join(base)))
            n += 1
            if rng.random() < 0.8:  # chains: the next copy is edited further
                base = [w if rng.random() > 0.02 else f"x{rng.randrange(10**6)}" for w in base]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_groups_match_brute_force(spark, odd_rows, k):
    rows = corpus() + odd_rows
    got = minhash.near_duplicate_groups(table(spark, rows), shingle=k).collect()
    want = brute_groups(rows, k)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((d or -1, len(shingles(t, k))) for d, t in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])


def test_links_between_members_that_differ_from_the_first(spark):
    """Few wide bands, so all meet in the same buckets: links not to a bucket's first document are found as well."""
    rows = corpus(11)
    got = minhash.near_duplicate_groups(table(spark, rows), shingle=4, bands=60, rows=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_groups(rows, 4)


def test_links_between_documents_that_never_lead(spark):
    """Texts made of common pieces: every bucket holds dozens of unlike ones, and the linked ones are not among the leads."""
    rng = random.Random(4)
    pieces = [[" ".join(words(rng, 20, 3000)) for _ in range(3)] for _ in range(16)]
    picks = [[rng.randrange(3) for _ in pieces] for _ in range(200)]
    for p in picks[:3]:
        picks.append([(x + 1) % 3 if i == 5 else x for i, x in enumerate(p)])
    rows = [(d, " ".join(pieces[i][x] for i, x in enumerate(p))) for d, p in enumerate(picks)]
    rng.shuffle(rows)
    want = brute_groups(rows, 5)
    assert sum(c != d for d, c in want.items()) == 3
    # six bands of one minimum: a pair of similarity 0.86 shares none of them once in 100,000 families of hashes
    got = minhash.near_duplicate_groups(table(spark, rows), bands=6, rows=1).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_template_corpus(spark):
    """900 variants of one text, mostly below the threshold among each other, and 30 pairs above it."""
    rng = random.Random(17)
    base = words(rng, 200, 10**6)
    edit = lambda w, n: [f"e{rng.randrange(10**9)}" if i in chosen else x for chosen in [set(rng.sample(range(len(w)), n))] for i, x in enumerate(w)]
    texts = [edit(base, 5) for _ in range(900)]
    texts += [edit(w, 2) for w in texts[:30]]
    rows = [(d, " ".join(w)) for d, w in enumerate(texts)]
    rng.shuffle(rows)
    want = brute_groups(rows, 4)
    assert 30 <= sum(d != c for d, c in want.items()) < 100
    got = minhash.near_duplicate_groups(table(spark, rows), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_deduplicate_keeps_columns_and_one_of_each(spark, odd_rows):
    df = table(spark, odd_rows)
    out = minhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, -1, 1, 2, 3, 4, 6, 7, 9, 10]


def test_nothing(spark):
    empty = table(spark, [])
    assert minhash.near_duplicate_groups(empty).count() == 0
    assert decontaminate.find_contamination(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def brute_hits(text, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = find(text), set(), set()
    for item, t in items:
        v = find(t)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            run = v[i : i + window]
            for p in range(len(w) - len(run) + 1):
                if w[p : p + len(run)] == run:
                    hit |= set(range(p, p + len(run)))
                    if item is not None:
                        found.add(str(item))
    return len(w), sorted(hit), sorted(found)


def contamination_case(odd_rows):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randrange(14, 60), 3000))) for i in range(12)]
    items += [(50, "Short item, of six words!"), (51, "solo"), (52, None), (53, ""), (None, "nameless item text goes here"), (3, items[3][1]), (60, items[4][1])]
    rows = list(odd_rows)
    for d in range(200, 230):
        parts = words(rng, 40, 3000)
        for _ in range(rng.randrange(3)):
            v = (items[rng.randrange(len(items))][1] or "").split()
            a = rng.randrange(0, 4)
            parts += ["--".join(v[a:]).upper()] if rng.random() < 0.5 else v[a : a + rng.randrange(5, 40)]
        rows.append((d, " ".join(parts + words(rng, rng.randrange(300), 3000))))
    return rows, items


@pytest.mark.parametrize("full", [False, True])
def test_contamination_matches_brute_force(spark, odd_rows, full, monkeypatch):
    """full: a bitmap that drops nothing, as a very large benchmark leaves it."""
    if full:
        monkeypatch.setattr(decontaminate, "bitmap", lambda bits: np.ones(BITMAP, bool))
    rows, items = contamination_case(odd_rows)
    got = decontaminate.find_contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id or -1, r.n_words, sorted(r.hits), list(r["items"])) for r in got.collect())
    assert got == sorted((d or -1, *brute_hits(t, items)) for d, t in rows)
    assert any(h for _, _, h, _ in got)


def test_contaminated_documents_go(spark, odd_rows):
    rows, items = contamination_case(odd_rows)
    df, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(df, bench)
    is_bad = lambda t: bool((h := brute_hits(t, items))[1]) and 20 * len(h[1]) >= h[0]
    assert out.columns == df.columns and any(is_bad(t) for _, t in rows)
    assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(d or -1 for d, t in rows if not is_bad(t))
    bad = next(t for _, t in rows if is_bad(t))
    some = table(spark, [(900, bad), (900, "clean"), (None, bad), (None, "clean too"), (None, None)])
    assert {r.text for r in decontaminate.decontaminate(some, bench).collect()} == {"clean", "clean too", None}


def test_contamination_with_many_windows_of_one_prefix(spark):
    """One shingle begins every item, and a third of the documents holds it: rarer shingles are the prefixes, without broadcasts too."""
    rng = random.Random(4)
    stem = "which of the following is"
    items = [(i, " ".join([stem, *words(rng, 12, 5000)])) for i in range(80)]
    rows = [(d, " ".join([*words(rng, 20), stem, *words(rng, 20)]) if d % 3 else " ".join([*words(rng, 30), items[d % 80][1], items[d % 7][1]])) for d in range(120)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontaminate.find_contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.doc_id, r.n_words, list(r.hits), list(r["items"])) for r in got) == sorted((d, *brute_hits(t, items)) for d, t in rows)


def test_query_digest(spark, odd_rows, tmp_path):
    rows, items = contamination_case(odd_rows)
    table(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for d, t in rows:
        n, hit, found = brute_hits(t, items)
        want.append((d or -1, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n))
    assert sorted((r[0] or -1, *r[1:]) for r in op2_decontamination(spark, str(tmp_path)).collect()) == sorted(want)
