"""Toxicity: counts by brute force, held-out accuracy, calibration, disguises and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

from mnemospark.llm import toxicity
from mnemospark.llm.common import Words
from tests.llm.conftest import table, words

@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 10)


INSULTS = ["grobnik", "zlotterich", "fewmok", "plaqqer"]
LABELS = "doc_id long, toxic int, lang string"


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def corpus(n=1200, seed=3, disguise=None):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        w, toxic = words(rng, rng.randrange(20, 120), 3000), rng.random() < 0.2
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            bad = rng.choice(INSULTS) + rng.choice(["", "", "en", "s"])
            w.insert(rng.randrange(len(w)), disguise(bad) if disguise and held(d) else bad)
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic), None))
    return rows, labels


def brute_counts(text, kinds):
    """The counts that need no undoing of disguises, by loops."""
    found = [m for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", text)]
    w = [m[0].translate({i: i + 32 for i in range(65, 91)}) for m in found]
    second = set(toxicity.SECOND_PERSON.split())
    hit = [kinds.get(x, 0) for x in w]
    return {
        "words": len(w), "strong": hit.count(2), "weak": hit.count(1), "second": sum(x in second for x in w),
        "near": sum(h > 0 and any(x in second for x in w[max(0, i - 5) : i + 6]) for i, h in enumerate(hit)),
        "capital_words": sum(len(m[0].encode()) > 1 and all("A" <= c <= "Z" for c in m[0]) for m in found),
        "letters": sum(len(m[0].encode()) for m in found), "capitals": sum("A" <= c <= "Z" for c in text),
        "exclaim": text.count("!"), "ask": text.count("?"), "loud": sum(a in "!?" and b in "!?" for a, b in zip(text, text[1:], strict=False)),
        "marks": sum(33 <= ord(c) < 127 and not c.isalnum() for c in text), "bytes": len(text.encode()),
    }


def lexicon_of(kinds):
    keys = {}
    for word, kind in kinds.items():
        raw = word.encode()
        w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), toxicity.LETTERS)
        keys[int(next(toxicity._keys(w))[1][0])] = kind  # the whole word only
    order = sorted(keys)
    return toxicity.Lexicon(np.array(order, np.uint64), np.array([keys[k] for k in order], np.int8))


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_counts_match_brute_force():
    rng = random.Random(8)
    some = ["you", "YOU", "du", "grobnik", "GROBNIK", "fewmok", "tú", "été", "A", "x1y", "!!", "?!", "...", "#", "日本", "abc", "\n"]
    texts = ["", " ", "you", *(rng.choice(["", " "]).join(rng.choice(some) + rng.choice([" ", " ", "", "!"]) for _ in range(rng.randrange(40))) for _ in range(300))]
    kinds = {"grobnik": 2, "fewmok": 1}
    got = toxicity.text_counts(*packed(texts), lexicon_of(kinds))
    for text, row in zip(texts, got.tolist(), strict=True):
        want = brute_counts(text, kinds)
        have = dict(zip(toxicity.COUNTS, row, strict=True))
        assert {k: have[k] for k in want} == want, text
    # a text counts the same alone
    for text, row in list(zip(texts, got.tolist(), strict=True))[::20]:
        assert toxicity.text_counts(*packed([text]), lexicon_of(kinds)).tolist() == [row]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("gr0bn1k", "grobnik"), ("g.r.o.b.n.i.k", "grobnik"), ("g r o b n i k", "grobnik"), ("gro*bnik", "grobnik"), ("grooobnik", "grobnik"), ("Grobnik", "grobnik"), ("1diot", "idiot"),
        ("end. Next", "end. next"), ("a1", "ai"), ("word###", "word###"), ("word$$$", "word$$$"), ("2026", "2026"), ("é é", "é é"), ("well-known", "well-known"), ("no! yes", "no! yes"),
    ],
)
def test_disguises_are_undone(text, want):
    plain, offsets, _ = toxicity.undisguised(*packed([text, "x", text]))
    assert [plain[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)] == [want, "x", want]


def test_held_out_labels_are_found_and_scores_are_calibrated(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in toxicity.score(table(spark, rows), toxicity.fit(table(spark, rows), spark.createDataFrame(labels, LABELS))).collect()}
    assert all(got[d].held_out == held(d) for d, _ in rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    test = [(got[d], y) for d, y, _ in labels if held(d)]
    assert np.mean([r.predicted == y for r, y in test]) > 0.98
    assert abs(np.mean([r.score for r, _ in test]) - np.mean([y for _, y in test])) < 0.05


def test_disguised_words_are_found(spark):
    """Three kinds of disguise, in held-out rows only, so no tree has seen them."""
    kinds = [lambda w: w.replace("o", "0").replace("e", "3"), lambda w: ".".join(w), lambda w: w[:3] + "*" + w[3:]]
    rng = random.Random(6)
    rows, labels = corpus(disguise=lambda w: rng.choice(kinds)(w))
    got = {r.doc_id: r for r in toxicity.score(table(spark, rows), toxicity.fit(table(spark, rows), spark.createDataFrame(labels, LABELS))).collect()}
    bad = [got[d].predicted for (d, t), (_, y, _) in zip(rows, labels, strict=True) if held(d) and y and not any(w in t for w in INSULTS)]
    good = [got[d].predicted for d, y, _ in labels if held(d) and not y]
    assert len(bad) > 20 and np.mean(bad) > 0.85 and np.mean(good) < 0.03


def test_labels_of_held_out_rows_are_never_used(spark):
    rows, labels = corpus(400)
    turned = [(d, 1 - y if held(d) else y, x) for d, y, x in labels]
    docs = table(spark, rows)
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(y, LABELS))).collect()) for y in (labels, turned))
    assert one == two


def test_odd_rows_parts_and_partitioning_change_nothing(spark, odd_rows):
    rows, labels = corpus(300)
    rows = [*((d + 1000, t) for d, t in rows), *odd_rows]
    labels = [*((d + 1000, y, x) for d, y, x in labels), (None, 1, None), (7, None, None), (8, 1, None), (8, 0, None), (6, 0, None), (1, 1, None), (99_999, 1, None)]
    known = spark.createDataFrame(labels, LABELS)
    one = toxicity.score(table(spark, rows), toxicity.fit(table(spark, rows), known))
    two = toxicity.score(table(spark, rows).repartition(7), toxicity.fit(table(spark, rows[::-1]).repartition(3), known.repartition(2)))
    key = lambda r: (r.doc_id or -1, r.score)
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect())) and one.count() == len(rows)
    # a long text in parts has the counts of the whole one, but for nearness
    long = next(t for d, t in rows if d == 6)
    lexicon = lexicon_of({"w1": 2, "w7": 1})
    data, offsets = packed([long])
    whole, parts = toxicity.text_counts(data, offsets, lexicon), sum(toxicity.text_counts(data[a:b], np.array([0, b - a]), lexicon) for a, b in toxicity._cuts(data, 1000))
    assert (whole == parts)[:, [i for i, c in enumerate(toxicity.COUNTS) if c != "near"]].all()


def test_without_labels_of_both_kinds(spark):
    docs = table(spark, [(1, "a"), (2, None)])
    for labels, want in (([], 0.0), ([(1, 1, None), (2, 1, None), (3, 1, None)], 1.0), ([(1, 0, None)], 0.0)):
        assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, LABELS))).collect()] == [want, want]
    assert toxicity.score(table(spark, []), toxicity.fit(table(spark, []), spark.createDataFrame([], LABELS))).count() == 0
