"""Compact windows, repeated passages and the pipeline against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from mnemospark.llm import substrings
from mnemospark.llm.common import shingle_hashes
from tests.llm.conftest import table, words
from tests.llm.test_near_duplicates import brute_groups, brute_hits
from tests.llm.test_rules import brute_base, brute_counts, labelled


def brute_windows(x, least):
    """Maximal (left, right) around each centre within which it is the (first) least value, less than `least` from it."""
    out = []
    for c in range(len(x)):
        left = c
        while left and x[left - 1] > x[c]:
            left -= 1
        right = c
        while right + 1 < len(x) and x[right + 1] >= x[c]:
            right += 1
        if right - left + 1 >= least:
            out.append((max(left, c - least + 1), c, min(right, c + least - 1)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_compact_windows(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40 if seed % 2 else 10**9, 300).astype(np.uint64) << np.uint64(32)
    cuts = [0, 100, 105, 105, 117, 300]  # several texts in a row
    want = [(a + i, a + c, a + j) for a, b in zip(cuts, cuts[1:], strict=False) for i, c, j in brute_windows(x[a:b], 12)]
    ends = np.repeat(cuts[1:], np.diff(cuts))
    assert list(zip(*(v.tolist() for v in substrings.compact_windows(x, ends, 12)), strict=True)) == sorted(want, key=lambda w: w[1])


def planted(rng):
    rows, shared = [], [words(rng, n, 5000) for n in (51, 60, 120, 400)]
    held = defaultdict(set)
    for d in range(300, 360):
        parts = words(rng, rng.randrange(30, 300), 5000)
        for s, passage in enumerate(shared):
            if rng.random() < 0.25:
                held[s].add(d)
                parts += [*passage, *words(rng, rng.randrange(5, 60), 5000)]
        rows.append((d, " ".join(parts)))
    return rows, held


def test_every_shared_passage_is_found_and_nothing_else(spark, odd_rows):
    rng = random.Random(21)
    rows, held = planted(rng)
    got = substrings.repeated_passages(table(spark, rows + odd_rows)).collect()
    text = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows + odd_rows}
    for r in got:
        x, y = text[r.doc_id][r.start : r.end], text[r.first_doc_id][r.first_start : r.first_end]
        s, t = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (x, y))
        assert min(len(x), len(y)) >= 50 and 100 * len(s & t) >= 80 * len(s | t)
        assert r.similarity == pytest.approx(len(s & t) / len(s | t), abs=1e-6)
    found = defaultdict(set)
    for r in got:
        found[r.doc_id].add(r.first_doc_id)
    for docs in held.values():
        first = min(docs)
        assert all(any(f in docs for f in found[d]) for d in docs if d != first)
    assert {d for d in found if d >= 300} <= set().union(*held.values())
    assert found[8] == {7}


def test_edited_passage(spark):
    rng = random.Random(2)
    passage = words(rng, 90, 5000)
    edited = passage[:40] + ["new"] + passage[40:70] + passage[71:]
    rows = [(1, " ".join(words(rng, 80, 5000) + passage)), (2, " ".join(edited + words(rng, 80, 5000)))]
    (r,) = substrings.repeated_passages(table(spark, rows)).collect()
    assert (r.doc_id, r.start, r.first_doc_id, r.first_start) == (2, 0, 1, 80) and r.end >= 89


def test_passages_around_a_frequent_phrase(spark):
    """Few documents share what surrounds a phrase of many; they are not the leads of its groups."""
    rng = random.Random(8)
    phrase, rows = words(rng, 49, 5000), []
    more = [words(rng, 6, 5000) for _ in range(3)]
    for d in range(1, 81):
        tail = more[d % 10 - 3] if d % 10 in (3, 4, 5) and d // 10 in (2, 5) else []
        rows.append((d, " ".join(words(rng, 40, 10**6) + phrase + tail + words(rng, 40, 10**6))))
    got = substrings.repeated_passages(table(spark, rows)).collect()
    assert {(r.first_doc_id, r.doc_id) for r in got} == {(23, 53), (24, 54), (25, 55)}



def test_recall_of_edited_passages(spark):
    """Passages of 50 words, one in the middle replaced: similarity 41/51. All 200 are repeats by brute force."""
    rng = random.Random(31)
    rows = []
    for d in range(0, 400, 2):
        passage = words(rng, 50, 10**6)
        rows += [(d, " ".join(passage)), (d + 1, " ".join(passage[:25] + ["new"] + passage[26:]))]
    found = {(r.first_doc_id, r.doc_id) for r in substrings.repeated_passages(table(spark, rows)).collect()}
    print("recall", len(found), "of 200")
    assert found <= {(d, d + 1) for d in range(0, 400, 2)} and len(found) >= 194



def covered(got, rows, ranges):
    """Of the words of each document that brute force finds in an earlier one, those in a reported passage."""
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return [len(by.get(d, set()) & set(want)) / len(want) for d, want in ranges.items()]


@pytest.mark.parametrize(("core", "part"), [(100, 92), (70, 60)])
def test_overlapping_passages(spark, core, part):
    """Triples: the first document holds the begin of a passage, the second its end, the third all of it."""
    rng, rows, ranges = random.Random(core), [], {}
    for t in range(120):
        whole = words(rng, core, 10**6)
        for k, passage in enumerate((whole[:part], whole[core - part :], whole)):
            head = words(rng, rng.randrange(5, 40), 10**6)
            rows.append((3 * t + k, " ".join(head + passage + words(rng, rng.randrange(5, 40), 10**6))))
        ranges[3 * t + 2] = range(len(head), len(head) + core)
    got = substrings.repeated_passages(table(spark, rows)).collect()
    found = covered(got, rows, ranges)
    print("triples whole", sum(f == 1 for f in found), "of", len(found))
    assert sum(f == 1 for f in found) >= 0.98 * len(found)
    assert {(r.first_doc_id // 3, r.doc_id // 3) for r in got} == {(t, t) for t in range(120)}


def test_chains_of_overlapping_passages(spark):
    """Each document shares 60 words with the one before it and goes on by 30 of its own, which the next one shares."""
    rng, rows, ranges = random.Random(21), [], {}
    for chain in range(30):
        text = words(rng, 60 + 30 * 6, 10**6)
        for k in range(6):
            head = words(rng, 10, 10**6)
            rows.append((10 * chain + k, " ".join(head + text[30 * k : 30 * k + 90] + words(rng, 10, 10**6))))
            if k:
                ranges[10 * chain + k] = range(10, 70)
    found = covered(substrings.repeated_passages(table(spark, rows)).collect(), rows, ranges)
    assert sum(f == 1 for f in found) >= 0.98 * len(found)


@pytest.mark.parametrize("n", range(7, 15))
@pytest.mark.parametrize("side", [10, 70])
def test_passage_around_an_insertion(n, side):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 1 << 62, 98).astype(np.uint64)
    y = np.concatenate([x[:49], rng.integers(0, 1 << 62, n).astype(np.uint64), x[49:]])
    sx, sy = shingle_hashes(x, 5), shingle_hashes(y, 5)
    found = substrings.common_passage(x, y, sx, sy, side, side + n * (side > 49), 50, 5, 80)
    assert found == (0, 98, 0, 98 + n, pytest.approx(90 / (98 + n)))



def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(12)
    passage = words(rng, 70, 5000)
    rows = [(1, " ".join(passage)), (2, " ".join(words(rng, 300, 5000) + passage)), (2, "short"), (2, " ".join(words(rng, 90, 5000)))]
    got = substrings.repeated_passages(table(spark, rows)).collect()
    assert (2, 300, 1, 0) in {(r.doc_id, r.start, r.first_doc_id, r.first_start) for r in got}


def test_passages_of_nothing(spark):
    assert substrings.repeated_passages(table(spark, [])).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path, odd_rows):
    rng = random.Random(6)
    rows, labels = labelled(120, 4)
    base = words(rng, 120, 3000)
    rows += [(5000 + i, " ".join(base[:i] + ["z"] + base[i:])) for i in (3, 60, 100)]
    item = words(rng, 30, 3000)
    rows += [(6000, " ".join(words(rng, 60, 3000) + item)), (6001, " ".join(words(rng, 900, 3000) + item)), (6002, " ".join(words(rng, 70, 3000)) + " me@here.org +1 (234) 555-7713")]
    rows += odd_rows
    docs = table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), list(rows)
    bad = {d for d, y in labels if not y}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, df = df, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "best_fit_packing":
            break
        assert df.columns == before.columns
        if name == "quality_rules":
            kept = [(d, t) for d, t in kept if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0] and d not in bad]
        elif name == "near_duplicates":
            groups = brute_groups(kept, 5)
            named = {d: (d, t) for d, t in kept if d is not None and groups[d] == d}
            kept = [*named.values(), *((d, t) for d, t in kept if d is None)]
        elif name == "decontamination":
            hits = [(d, t, brute_hits(t, [(1, " ".join(item))])) for d, t in kept]
            kept = [(d, t) for d, t, h in hits if not (h[1] and 20 * len(h[1]) >= h[0])]
            assert 6000 not in dict(kept) and 6001 in dict(kept)
        else:
            assert any(brute_base(t) for _, t in kept) and not any(brute_base(r.text) for r in df.collect())
            kept = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted((d or -1) for d, _ in kept) == sorted(r.doc_id or -1 for r in df.collect())
    placed = df.groupBy("sequence_id").sum("length").collect()
    assert {r.doc_id for r in df.collect()} == {d for d, _ in kept} and max(r[1] for r in placed) <= 4096
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == df.count()


def test_repeated_passages_send_texts_in_small_batches(spark, monkeypatch):
    limits, write = [], substrings.stage

    def stage(df, name):
        limits.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        return write(df, name)

    monkeypatch.setattr(substrings, "stage", stage)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rng = random.Random(3)
    same = " ".join(words(rng, 60))
    found = substrings.repeated_passages(table(spark, [(1, same + " a"), (2, "b " + same)]))
    assert [(r.doc_id, r.start, r.end, r.first_doc_id) for r in found.collect()] == [(2, 1, 61, 1)]
    assert set(limits) == {"8m"} and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before != "8m"


def test_places_that_cannot_extend_a_passage_are_not_tried(monkeypatch):
    """Behind a passage of 60 words both texts hold the same short phrases in other orders, none near enough to belong to it."""
    tried, past = [], substrings._past_edit
    monkeypatch.setattr(substrings, "_past_edit", lambda *a: (tried.append(at) or at for at in past(*a)))
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    passage, phrases = draw(60), [draw(9) for _ in range(20)]
    x, y = (np.concatenate([passage, draw(10), *(np.concatenate([phrases[p], draw(2)]) for p in rng.integers(0, 20, 100))]) for _ in range(2))
    assert substrings.common_passage(x, y, shingle_hashes(x, 5), shingle_hashes(y, 5), 0, 0, 50, 5, 80) == (0, 60, 0, 60, 1.0)
    assert not tried


@pytest.mark.parametrize("seed", range(6))
def test_bounds_on_runs_change_no_passage(seed):
    """Edited copies with repeats: the same passages as when every place is tried."""
    rng = random.Random(seed)
    found = 0
    for _ in range(40):
        x = [rng.randrange(30 if seed % 2 else 10**9) for _ in range(rng.randrange(60, 400))]
        y, i = [rng.randrange(10**9) for _ in range(rng.randrange(20))], 0
        while i < len(x):
            n = rng.randrange(1, 60)
            y += x[i : i + n] + [rng.randrange(10**9) for _ in range(rng.choice((0, 1, 1, 2, 5, 12)))]
            i += n + rng.choice((0, 0, 1, 3, 9))
        x, y = np.array(x, np.uint64), np.array(y, np.uint64)
        sx, sy = shingle_hashes(x, 5), shingle_hashes(y, 5)
        free = tuple(np.full(len(s), 10**6) for s in (sx, sy, sx, sy))
        for a, b in zip(*substrings._common_runs(sx, sy), strict=True):
            got = substrings.common_passage(x, y, sx, sy, a, b, 50, 5, 80)
            assert got == substrings.common_passage(x, y, sx, sy, a, b, 50, 5, 80, (substrings._also_in(sx, sy), free))
            found += got is not None
    assert found > 20


@pytest.mark.parametrize("most", [124, 400])
def test_bits_shared(most):
    rng = np.random.default_rng(most)
    bits = np.zeros((2, 50, 2048), bool)
    for row in bits.reshape(-1, 2048):
        row[rng.choice(2048, most, replace=False) if most > 124 else rng.integers(0, 200, most)] = True
    s, t = np.packbits(bits, axis=2).view(np.uint64)
    assert (substrings._bits_shared(s[:, None], t, most) == (bits[0][:, None] & bits[1]).sum(axis=2)).all()


def test_copies_with_many_edits_are_not_compared_with_each_other(spark, monkeypatch):
    """Copies of one text, in parts of which edits are too dense for a passage with it: what is compared grows with the copies, not with their pairs."""
    met, verify = [], substrings._verify
    monkeypatch.setattr(substrings, "_verify", lambda pairs, *a: met.append(pairs.count()) or verify(pairs, *a))
    rng = random.Random(17)
    text, n = words(rng, 400, 10**6), 150
    rows = [(0, " ".join(text))]
    for d in range(1, n):
        copy = list(text)
        for p in rng.sample(range(400), 14):
            copy[p] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(copy)))
    found = {r.doc_id for r in substrings.repeated_passages(table(spark, rows)).collect() if r.first_doc_id == 0}
    assert found == set(range(1, n)) and sum(met) < 4 * n


def test_all_passages_with_an_edit_anywhere_are_found(spark):
    """Passages of 50 words, one of them replaced, wherever: similarity 0.8 or more, and 24 words in a row in common."""
    rng = random.Random(32)
    rows = []
    for d in range(0, 600, 2):
        passage, p = words(rng, 50, 10**6), rng.randrange(5, 45)
        sides = [words(rng, 30, 10**6) for _ in range(4)]
        rows += [(d, " ".join(sides[0] + passage + sides[1])), (d + 1, " ".join(sides[2] + passage[:p] + ["new"] + passage[p + 1 :] + sides[3]))]
    found = {(r.first_doc_id, r.doc_id) for r in substrings.repeated_passages(table(spark, rows)).collect()}
    assert found == {(d, d + 1) for d in range(0, 600, 2)}


def test_long_runs_of_repeated_words(spark):
    """The first document repeats a word too few times; in the second the long run is not the first one, and the third repeats a phrase."""
    rng = random.Random(4)
    rows = [
        (1, " ".join(words(rng, 60, 10**6) + ["ab"] * 30 + words(rng, 60, 10**6))),
        (2, " ".join(["ab"] * 30 + words(rng, 60, 10**6) + ["ab"] * 158)),
        (3, " ".join(["p", "q", "r"] * 60 + words(rng, 9, 10**6))),
        (4, " ".join(words(rng, 7, 10**6) + ["ab"] * 400 + ["q", "r", "p"] * 90)),
    ]
    ranges = {4: range(7, 407)}
    got = substrings.repeated_passages(table(spark, rows)).collect()
    assert covered(got, rows, ranges) == [1] and covered(got, rows, {4: range(407, 677)})[0] >= 0.98
    assert {(r.first_doc_id, r.doc_id) for r in got} == {(2, 4), (3, 4)}


def test_copies_of_an_edited_copy(spark):
    """Two documents have the same dense edits of a first one; between them lie others that have edits of their own there."""
    rng = random.Random(9)
    text = words(rng, 160, 10**6)
    edited = [f"y{rng.randrange(10**6)}" if 40 <= i < 120 and i % 11 == 0 else w for i, w in enumerate(text)]
    rows = [(1, " ".join(text))]
    for d in range(2, 30):
        copy = edited if d in (7, 23) else [f"z{rng.randrange(10**6)}" if 40 <= i < 120 and i % 9 == d % 9 else w for i, w in enumerate(text)]
        rows.append((d, " ".join(copy)))
    got = substrings.repeated_passages(table(spark, rows)).collect()
    assert (7, 23) in {(r.first_doc_id, r.doc_id) for r in got} and covered(got, rows, {23: range(160)}) == [1]


def test_exact_runs_that_overlap_other_passages_are_covered(spark):
    """A run of 50 words begins inside a passage found elsewhere in the first document, and ends inside another one."""
    rng = random.Random(14)
    a, b = words(rng, 70, 10**6), words(rng, 70, 10**6)
    between = a[-24:] + ["m", "n"] + b[:24]
    rows = [(1, " ".join(a + words(rng, 40, 10**6) + b + words(rng, 40, 10**6) + between)), (2, " ".join(a + ["m", "n"] + b))]
    assert covered(substrings.repeated_passages(table(spark, rows)).collect(), rows, {2: range(142)}) == [1]
