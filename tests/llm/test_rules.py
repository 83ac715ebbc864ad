"""Quality rules, personal data, url rules and language-model scores against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from mnemospark.llm import lm_score, pii, quality, url_filter
from mnemospark.llm.common import NON_SPACE, Words
from mnemospark.llm.queries import HOST_RULES, op7_personal_data
from tests.llm.conftest import table, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def labelled(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(1000, 1000 + n):
        good = rng.random() < 0.7
        w = [x if good else x + rng.choice(["###", "&&&", "!!"]) for x in words(rng, rng.randrange(60, 150), 2000)]
        rows.append((d, " ".join(w)))
        labels.append((d, int(good)))
    return rows, labels


def test_counts_match_brute_force(spark, odd_rows):
    rows = [*odd_rows, (20, "a b c a b c x\n\nx\nx\n x\n" * 3), (21, "A b c\x00 a B c # $ |"), (22, "ü" * 10 + " \x1c y")]
    got = quality.score_quality(table(spark, rows), None).collect()
    have = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    want = []
    for d, t in rows:
        c = brute_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((d or -1, *c, failed, not failed))
    assert have == sorted(want)


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = labelled(900)
    df = table(spark, rows)
    known = spark.createDataFrame(labels[:500] + [(None, 1), (7, None)], "doc_id long, quality int")
    scored = {r.doc_id: r for r in quality.score_quality(df, quality.fit(df, known)).collect()}
    held = labels[500:]
    assert np.mean([(scored[d].probability >= 0.5) == bool(y) for d, y in held]) > 0.98
    assert abs(np.mean([scored[d].probability for d, _ in held]) - np.mean([y for _, y in held])) < 0.05


def test_filter_keeps_columns_and_works_without_labels(spark, odd_rows):
    df = table(spark, odd_rows)
    model = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert model is None
    out = quality.filter_quality(df, model)
    kept = [d for d, t in odd_rows if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    assert out.columns == df.columns and sorted((r.doc_id or -1) for r in out.collect()) == sorted(d or -1 for d in kept)
    assert quality.filter_quality(table(spark, []), None).count() == 0
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # other columns stay in the JVM


def mask(x):
    return x & ((1 << 64) - 1)


def brute_margin(model, text):
    """The score of one text by loops: mean weight of its words, of its 3-grams and of its 4-grams of code points."""
    found = [[int(Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), NON_SPACE).hash[0]) >> 46 for w in WORD.findall(text or "")]]
    for n in (3, 4):
        grams = []
        for i in range(len(text or "") - n + 1):
            h = n
            for c in text[i : i + n]:
                h = mask((h + ord(c)) * 0x9FB21C651E98DF25)
            grams.append(mask((h ^ (h >> 32)) * 0xC6BC279692B5C323) >> 46)
        found.append(grams)
    return model.bias + sum(sum(float(model.weights[g]) for g in grams) / max(1, len(grams)) for grams in found)


def test_scores_match_brute_force_under_any_partitioning(spark, odd_rows):
    rng = np.random.default_rng(3)
    model = quality.Classifier(rng.normal(size=1 << 18).astype(np.float32), 0.1, 0.7, -0.2)
    rows = [*odd_rows, (30, "ab"), (31, "é日本👍"), (32, "x"), (33, "Same text"), (34, "Same text")]
    want = {d: 1 / (1 + math.exp(-(0.7 * brute_margin(model, t) - 0.2))) for d, t in rows if d}
    seen = set()
    for parts, order in ((1, "doc_id"), (7, "text"), (64, "text"), (1, "text")):
        got = quality.score_quality(table(spark, rows).orderBy(order).repartition(parts), model).collect()
        for r in got:
            assert r.doc_id is None or r.probability == pytest.approx(want[r.doc_id], abs=1e-7)
        seen.add(tuple(sorted((r.doc_id or -1, r.probability, r.kept) for r in got)))
    assert len(seen) == 1


def test_fit_does_not_depend_on_rows_or_order(spark):
    rows, labels = labelled(200)
    rows += [(d, t + " more") for d, t in rows[:40]]
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    models = [quality.fit(table(spark, rows).orderBy(order).repartition(parts), known) for parts, order in ((1, "doc_id"), (9, "text"))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].shift == models[1].shift


# ---------------------------------------------------------------- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


TEXTS = [
    "a@b.c_d@e.f x@y z.@q.w..e a.b+c%d@e-f.g-h.i@j.k @a.b a@.b é@é.com ü👍 me@here.org",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.3 1.2.3 1.2.3.4 01.002.3.00004 99999999999999999999.1.1.1 .1.2.3.4. 1.2.3.٤",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 41111111111111111111111 378282246310005 1-2-3 5500 0000 0000 0004-",
    "+1 (017) 555-7713 + 1 234 +123 +1234567890 +1....2 +49 (0) 30/123456789 ++12 345 678 90 +1234567890123456 +1 (234) 5",
    "pay IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433 konto DE89370400440532013000",
    "my ssn is 123-45-6789 but 123-45-6789 far" + " x" * 40 + " 123-45-6780 tel 555-123-4567 and (555) 123 4567",
    'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" and 9233a8ecf7c5b09fe5949719b6b82bc439e9329c' + " y" * 30,
    "a" * 3000 + "@", "1" * 3000, "1 " * 2000, "+1" + " " * 2000, "a@" + "b." * 2000, "9." * 2000, "x@y.z " * 300,
]


def test_base_spans_match_brute_force(spark, odd_rows, tmp_path):
    rng = random.Random(4)
    bits = ["@", ".", "+", "1", "25", "4111111111111111", " ", "-", "(", "a", "é", "%", "\n", "300", "👍"]
    noise = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    rows = list(odd_rows) + [(100 + i, t) for i, t in enumerate([*TEXTS, *noise])]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        b = brute_base(t)
        n = Counter(x[3] for x in b)
        want.append((d or -1, *(n[k] for k in BASE), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in b).encode()).hexdigest()))
    got = op7_personal_data(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, *r[1:6]) for r in got) == sorted(want)
    for r in got:
        assert len(r.spans.split(",")) >= sum(r[1:5])


def test_added_kinds_need_their_checks(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    found = {r.doc_id: [(s.kind, rows[r.doc_id][1][s.start : s.end]) for s in r.spans] for r in pii.find_pii(table(spark, rows)).collect()}
    assert found[4] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]
    assert found[5] == [("national_id", "123-45-6789"), ("national_id", "123-45-6789"), ("local_phone", "555-123-4567"), ("local_phone", "(555) 123 4567")]
    assert [k for k, _ in found[6]] == ["secret"]


def test_redaction(spark):
    rows = [(1, "mail a@b.cc or +1 (234) 555-7713, é 1.2.3.4"), (2, None), (3, "nothing here")]
    df = table(spark, rows)
    out = pii.redact(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail [EMAIL] or [PHONE], é [IP]", 2: None, 3: "nothing here"}


def test_no_python_in_the_plan(spark):
    plan = pii.find_pii(table(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- urls


def test_url_rules(spark):
    urls = {
        1: ("http://a.example.net/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("http://EXAMPLE.net/EN/1", "example.net", "/EN/1", "net/", "block"),
        3: ("https://x.org/fr/#t", "x.org", "/fr/", "org/fr/", "allow"),
        4: ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        5: ("https://m.casino-win.example.com/en/", "m.casino-win.example.com", "/en/", None, "block"),
        6: (None, "", "", None, "allow"),
        7: ("no scheme net/", "", "", None, "allow"),
        8: ("x://net?a/b://c", "net", "", None, "allow"),
        9: ("x://net", "net", "", None, "allow"),
        10: ("x://É.net/\n", "É.net", "/\n", "net/", "block"),
        11: ("x://", "", "", None, "allow"),
    }
    rows = [(k, v[0], "x", "y") for k, v in urls.items()] + [(1, urls[1][0], "x", "y"), (None, urls[2][0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages, [url_filter.host_rule(*r) for r in HOST_RULES]).collect()
    want = [(k, *v[1:]) for k, v in urls.items()] + [(1, *urls[1][1:]), (None, *urls[2][1:])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_filter.judge_urls(pages.limit(0), []).count() == 0


def test_url_rule_whose_path_ends_inside_a_token(spark):
    pages = spark.createDataFrame([(1, "x://a.b/desk"), (2, "x://a.b/des"), (3, "x://c/de"), (4, "x://bb/de")], "page_id long, url string")
    got = url_filter.judge_urls(pages, [url_filter.host_rule("block", "b", "/de"), url_filter.host_rule("block", "", "")], [])
    assert {r.page_id: r.rule for r in got.collect()} == {1: "b/de", 2: "b/de", 3: "", 4: ""}


# ---------------------------------------------------------------- language models


def hashes(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), NON_SPACE).hash.tolist()


def test_scores_match_brute_force(spark, odd_rows):
    rows, labels = labelled(60, 9)
    rows = rows + odd_rows
    good = {d for d, y in labels if y}
    df, known = table(spark, rows), spark.createDataFrame(labels + [(None, 1)], "doc_id long, quality int")
    got = {}
    for r in lm_score.score(df, lm_score.fit(df, known, bits=20), known, bits=20).collect():
        got.setdefault(r.doc_id, []).append(r)
    top = 1 << 20

    def ids(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        data = np.frombuffer((text or "").encode(), np.uint8)
        one, two, _ = lm_score._ids((data, np.array([0, len(data)])), 20)
        assert len(w) == len(one) and all(x < top for x in one)
        return one.tolist(), two.tolist()

    coded = [(d, *ids(t)) for d, t in rows]
    counts = {}
    for kind in ("target", "background"):
        seen = [(one, two) for d, one, two in coded if kind == "background" or d in good]
        counts[kind] = Counter(x for one, _ in seen for x in one), Counter(x for _, two in seen for x in two), sum(len(o) for o, _ in seen), sum(bool(o) for o, _ in seen)
    vocabulary = len(counts["background"][0]) + 1
    for d, one, two in coded:
        if not one:
            assert got[d][0].difference is None or d in (None,)
            continue
        loss = {}
        for kind in ("target", "background"):
            c1, c2, total, texts = counts[kind]
            own = kind == "background" or d in good
            o1, o2, n = (Counter(one), Counter(two), len(one)) if own else (Counter(), Counter(), 0)
            sums = 0.0
            for i, (a, b) in enumerate(zip(one, two, strict=True)):
                context = c1[one[i - 1]] - o1[one[i - 1]] if i else texts - own
                alone = (c1[a] - o1[a]) / max(1, total - n)
                pair = min(1.0, (c2[b] - o2[b]) / context) if context > 0 else alone
                sums -= math.log(0.6 * pair + 0.3 * alone + 0.1 / vocabulary)
            loss[kind] = sums / len(one)
        r = next(r for r in got[d] if r.n_words == len(one))
        assert r.target_loss == pytest.approx(loss["target"], abs=2e-4) and r.background_loss == pytest.approx(loss["background"], abs=2e-4)
    scores = {d: got[d][0].difference for d, _ in labels}
    assert np.mean([scores[d] for d in good]) < np.mean([s for d, s in scores.items() if d not in good])


def test_scores_of_nothing(spark):
    none, known = table(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    assert lm_score.score(none, lm_score.fit(none, known, bits=17), known, bits=17).count() == 0


def test_pattern_rules_of_a_table(spark):
    urls = ["http://ads.example.org/x/banner-7.gif", "http://myads.example.org/", "http://a.b/ads/", "http://a.b/Ads", "http://a.b/loads/", "http://x.ads.net/q", "http://a.b/p.a-q", "http://a.b/pxa-q", None, "no url", "http://a.b/good/ads/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([("block", "||ads.*^"), ("block", "/ADS^"), ("allow", "/good/ads/"), ("block", "/p.a-"), ("block", None), ("other", "a"), ("block", "")], "verdict string, pattern string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, [], [], patterns=table).collect()}
    blocked = {0, 2, 5, 6}
    assert got == {i: "block" if i in blocked else "allow" for i in range(len(urls))}
    tokens = {tuple(r.tokens) for r in url_filter.pattern_rules(table).collect()}
    assert tokens == {("ads",), ("good", "ads"), ("p", "a")}


def test_account_number_before_other_capitals(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF and GB82 WEST 1234 5698 7654 33 NONE"
    rows = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, _pii_spans_base string")
    assert [(x.kind, x.text) for x in pii.find_pii(rows).first().spans] == [("iban", "DE89 3704 0044 0532 0130 00")]
    r = pii.redact(rows).first()
    assert r.text.startswith("IBAN [IBAN] BIC COBADEFF") and r["_pii_spans_base"] == "x"
