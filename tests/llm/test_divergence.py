"""Source divergence against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from mnemospark.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Columns whose names clash with those that the operator makes.
SCHEMA = "doc_id long, text string, lang string, source string, g long, l int, digest string, part string, item int, n int, value string, rank string"


def brute(rows, min_docs=10, top=10):
    docs = [((lang or ""), (source or ""), Counter(WORD.findall((text or "").translate(LOWER)))) for _, text, lang, source in rows]
    groups = {(lang, source) for lang, source, _ in docs}
    df, by_group, by_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, c in docs:
        df[lang].update(c.keys())
        by_group[lang, source].update(c)
        by_lang[lang].update(c)
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)

        def share(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        own, whole = share(by_group[lang, source]), share(by_lang[lang])
        pairs = []
        for l2, s2 in groups:
            if l2 == lang and s2 != source:
                other = share(by_group[l2, s2])
                pairs.append((s2, sum(f(own[t], other[t]) for t in kept)))
        terms = [(t, f(own[t], whole[t])) for t in kept if by_group[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, t, value, i + 1) for i, (t, value) in enumerate(items[:most])]
    return sorted(out)


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rng.choice(["en", "en", "de", "fr"])
        source = "big" if rng.random() < 0.35 else f"s{rng.randrange(7)}"
        pool = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "É", "Y", "ß" + source[:1])]
        rows.append((d, rng.choice([" ", "\n", "1", "--"]).join(rng.choices(pool, range(1, len(pool) + 1), k=rng.randrange(0, 60))), lang, source))
    same = "kopie Kopie KOPIE ärger"
    rows += [(1000 + i, same, "de", "big") for i in range(60)]
    rows += [(5, None, "en", "s1"), (6, "", "it", "lone"), (7, "word " * 12, None, None), (None, None, None, "s1"), (8, "123 \x00", "en", "wordless"), (9, "nothing kept here", "pt", "a"), (10, "at all", "pt", "b"), (11, "x" * 70_000 + " y", "en", "long")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], SCHEMA)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("digest_bits", [64, 5])
def test_matches_brute_force(spark, digest_bits):
    rows = corpus()
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"} and len(want) > 100
    # 5 bits make all digests collide, so every count is split by string
    assert collected(divergence.source_divergence(frame(spark, rows).repartition(5), digest_bits=digest_bits)) == want


def test_small_parts_and_flushes_change_nothing(spark, monkeypatch):
    rows = corpus(150, 9)
    monkeypatch.setattr(divergence, "PART_BYTES", 300)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "_PAIRS", 3)
    assert collected(divergence.source_divergence(frame(spark, rows), min_docs=3, top=4)) == brute(rows, 3, 4)


def test_empty_tables(spark):
    assert divergence.source_divergence(frame(spark, [])).count() == 0
    rows = [(1, None, "en", "a"), (2, "", "en", "b")]
    assert collected(divergence.source_divergence(frame(spark, rows))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_of_large_counts_are_exact(spark):
    n, total, v = 3 * 10**15, 10**16, 7
    got = spark.sql(f"SELECT {n}L n, {total}L t, {v}L v").select(divergence.share(*(divergence.F.col(c) for c in "ntv"))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)
