"""Fill-in-the-middle against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import fill_middle
from tests.llm.conftest import table, words

SPLIT = {"char": lambda t: list(t), "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t), "word": lambda t: re.findall(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", t)}


def brute(doc_id, text, unit="char", seed=1):
    t = text or ""
    units = SPLIT[unit](t)
    assert "".join(units) == t
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd(odd_rows):
    rng = random.Random(3)
    some = ["<", ">", "P>", "<S", "é", "👍", " ", "\n", "a", "日本", " ", "\x00", "<M", "ab\n\n"]
    made = [(100 + i, "".join(rng.choice(some) for _ in range(rng.randrange(60)))) for i in range(300)]
    return [*odd_rows, *made, (900, "x <S> y"), (901, "<P>"), (902, "\n"), (903, "<"), (904, "é" * 5), (905, "é" * 5000)]


@pytest.mark.parametrize(("unit", "part_bytes"), [("char", fill_middle.PART_BYTES), ("char", 700), ("word", 700), ("line", 700)])
def test_matches_brute_force(spark, odd_rows, unit, part_bytes):
    rows = odd(odd_rows)
    made = fill_middle.fill_in_middle(table(spark, rows).repartition(3), unit, part_bytes=part_bytes)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r[:6]) for r in got), key=key) == sorted((brute(d, t, unit) for d, t in rows), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests_empty_table_and_bad_sentinels(spark):
    rows = [(i, " ".join(words(random.Random(i), 30))) for i in range(40)]
    got = fill_middle.with_digests(fill_middle.fill_in_middle(table(spark, rows))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(r.doc_id, r.output_sha256, r.restored_sha256) for r in got} == {(d, sha(brute(d, t)[5]), sha(t)) for d, t in rows}
    assert fill_middle.with_digests(fill_middle.fill_in_middle(table(spark, []))).count() == 0
    for bad in (("a", "a", "b"), ("", "a", "b"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<P>", "x<P>", "c")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(table(spark, []), sentinels=bad)


def test_other_rates_seeds_and_sentinels(spark):
    rows = [(i, f"text number {i}, as it is") for i in range(200)]
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    made = fill_middle.fill_in_middle(table(spark, rows), rate=50, suffix_first=100, sentinels=marks, seed=7)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in got} == {"plain", "spm"} and 60 < sum(r.form == "spm" for r in got) < 140
    assert {r.doc_id: r.back for r in got} == dict(rows)
