"""Texts, ids, dates, keys, tokens and replies on hand-made cases."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import dates, replies
from mnemospark.functions import helpers as H
from mnemospark.functions import text as T

DAY = dt.date(2024, 3, 15)  # a Friday


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I went yesterday", "I went yesterday (March 14, 2024)"),
        ("yesterday night", "yesterday (March 14, 2024) night"),
        ("last night", "last night (March 14, 2024)"),
        ("this morning today tonight", "this morning (March 15, 2024) today (March 15, 2024) tonight (March 15, 2024)"),
        ("the other day", "the other day (March 13, 2024)"),
        ("Tomorrow", "Tomorrow (March 16, 2024)"),
        ("last weekend", "last weekend (March 9 to 10, 2024)"),
        ("this past week", "this past week (March 4 to 10, 2024)"),
        ("earlier this month", "earlier this month (February 2024)"),
        ("past year", "past year (2023)"),
        ("3 days ago", "3 days ago (March 12, 2024)"),
        ("two weeks ago", "two weeks ago (March 1, 2024)"),
        ("a weekend ago", "a weekend ago (March 9 to 10, 2024)"),
        ("four months ago", "four months ago (November 2023)"),
        ("10 years ago", "10 years ago (2014)"),
        ("for 2 years", "for 2 years (since 2022)"),
        ("since three months", "since three months (since December 2023)"),
        ("last Friday", "last Friday (March 8, 2024)"),
        ("past mon", "past mon (March 11, 2024)"),
        ("a few days ago", "a few days ago"),
        ("for 3 days", "for 3 days"),
        ("9999999999 days ago and 99999 years ago", "9999999999 days ago and 99999 years ago (-97975)"),
        ("lastly, pastweek", "lastly, pastweek"),
        ("Last night, a month ago. TODAY!", "Last night (March 14, 2024), a month ago (February 2024). TODAY (March 15, 2024)!"),
        ("for 2 months ago", "for 2 months (since January 2024) ago (January 2024)"),
        ("since an hour, for twelve weeks", "since an hour, for twelve weeks"),
        ("this past thurs, last Sunday", "this past thurs (March 14, 2024), last Sunday (March 10, 2024)"),
        ("2023 years ago, 30000 months ago", "2023 years ago (1), 30000 months ago"),
        ("", ""),
    ],
)
def test_relative_dates(spark, text, want):
    df = spark.createDataFrame([(text, DAY)], "t string, d date")
    got = df.select(*(dates.annotate_relative_dates(F.col("t"), F.col("d"), mark).alias(mark) for mark in ("paren", "tag"))).first()
    assert got.paren == want
    assert got.tag.replace(" [= ", " (").replace("]", ")") == want


def test_relative_date_column(spark):
    rows = [("went yesterday", "2024-03-15"), ("went yesterday", None), (None, "2024-03-15"), ("went yesterday", "")]
    df = spark.createDataFrame(rows, "t string, d string")
    got = [r.out for r in df.select(dates.annotate_relative_dates(F.col("t"), F.col("d")).alias("out")).collect()]
    assert got == ["went yesterday (March 14, 2024)", "went yesterday", None, "went yesterday"]
    with pytest.raises(ValueError):
        dates.annotate_relative_dates(F.col("t"), F.col("d"), "other")


def test_ranges_over_months_and_years(spark):
    df = spark.createDataFrame([(dt.date(2023, 12, 30), dt.date(2024, 1, 5)), (dt.date(2024, 1, 29), dt.date(2024, 2, 4))], "a date, b date")
    got = [r.out for r in df.select(dates.span(F.col("a"), F.col("b")).alias("out")).collect()]
    assert got == ["December 30, 2023 to January 5, 2024", "January 29 to February 4, 2024"]


def test_ids(spark):
    want = hashlib.sha256("3:用户😀1:s1:r1:0".encode()).hexdigest()
    got = one(spark, T.memory_id(F.col("u"), F.col("s"), F.col("r"), F.col("i")), u="用户😀", s="s", r="r", i=0)
    assert got == want
    assert one(spark, T.point_id(F.col("m")), m=want) == f"{want[:8]}-{want[8:12]}-{want[12:16]}-{want[16:20]}-{want[20:32]}"
    with pytest.raises(Exception, match="too short"):
        one(spark, T.point_id(F.col("m")), m="abc")


@pytest.mark.parametrize("content", ['say "x" \\ back', "tab\tnew\nline\r\f\b", "unit \x1f sep \x0b \x00", "emoji 😀 ünï", "\\u001f literal \x1f", " \x1f　padded \x85 "])
def test_fingerprint_is_the_canonical_json(spark, content):
    messages = [("user", content, None), ("assistant", "ok", 5)]
    df = spark.createDataFrame([("u", "s", messages)], "u string, s string, m array<struct<role:string,content:string,timestamp:bigint>>")
    body = {"messages": [{"content": c.strip(), "role": r, "timestamp": t} for r, c, t in messages], "session_id": "s", "user_id": "u"}
    want = json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert df.select(T.canonical_request(F.col("u"), F.col("s"), F.col("m")).alias("x")).first().x == want


def test_render(spark):
    both = T.render(F.col("q"), F.col("a"), F.col("d"))
    assert one(spark, both, q="hi", a="there", d="2024-01-02") == "[2024-01-02] Q: hi\nA: there"
    assert one(spark, both, q="", a="x ", d="") == "A: x"
    assert one(spark, T.render(F.col("q"), F.lit(None).cast("string")), q="") == ""
    assert one(spark, T.event_day(F.col("t")), t=-1) == "1969-12-31"
    assert one(spark, T.event_day(F.col("t").cast("long")), t=1_710_460_800_000) == "2024-03-15"


@pytest.mark.parametrize(
    ("value", "key", "relation"),
    [("  Café？ ", "café", "café"), ("Ｆｕｌｌ", "full", "full"), ("Straße", "strasse", "strasse"), ("Cities", "cities", "city"), ("classes", "classes", "class"), ("worked at", "worked at", "worked"),
     ("likes to be with", "likes to be with", "likes to be"), ("of", "of", "of"), ("boss", "boss", "boss"), ("Cats?!", "cats", "cat"), (" a \t b\x1fc. ", "a b c", "a b c"), ("", "", ""), ("lives in of", "lives in of", "live")],
)
def test_keys(spark, value, key, relation):
    assert H.key_of(value) == key and H.relation_key_of(value) == relation
    assert one(spark, H.fact_key(F.col("v")), v=value) == key and one(spark, H.relation_key(F.col("v")), v=value) == relation


def test_lexicon(spark):
    find = H.TermMatcher(["board member", "member", "董事会"]).find
    assert find("A  BOARD\nmember.") == ["board member", "member"]
    assert find("remember members") == [] and find("参加董事会议") == ["董事会"] and find("") == []
    assert H.TermMatcher([]).find("x") == []
    assert one(spark, H.lexicon_terms(F.col("t"), ["b", "a"]), t="a b ab") == ["a", "b"]


def sale(**changes):
    return json.dumps({"record_kind": "reported sale", "user_quotation": "we sold 3 jars for $2.50 each", "quantity": "3", "unit_price": "2.50", "currency_symbol": "$"} | changes, ensure_ascii=False)


def test_sale_totals(spark):
    note = lambda c: one(spark, H.annotate_unit_totals(F.col("c")), c=c)
    noted = json.loads(note(sale()))["user_quotation"]
    assert noted == "we sold 3 jars for $2.50 each (calculated sale total: 3 × $2.50 = $7.5)"
    assert json.loads(note(sale(more=[1, {"a": None}]))) == json.loads(sale(more=[1, {"a": None}], user_quotation=noted))
    exact = sale(user_quotation='It\nSOLD 12345.678901 "kg" for  $99999.00000000001 EACH.', quantity="12345.678901", unit_price="99999.00000000001")
    assert json.loads(note(exact))["user_quotation"].endswith("EACH (calculated sale total: 12345.678901 × $99999.00000000001 = $1234555544.42109912345678901).")
    for same in (sale(user_quotation=noted), sale(reported_total="1"), sale(reported_total=None), sale(quantity="4"), sale(currency_symbol="€"), sale(quantity="2000000"), "no json", "[]", sale(unit_price=2), '"reported sale"'):
        assert note(same) == same


def test_sale_totals_are_made_from_one_parse(spark):
    note = lambda c: one(spark, H.annotate_unit_totals(F.col("c")), c=c)
    plan = spark.createDataFrame([("x",)], "c string").select(H.annotate_unit_totals(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") <= 2
    later = "sold sold 3 jars for $9 each, for $2x50 each, for $2.50 Each é"
    assert json.loads(note(sale(user_quotation=later)))["user_quotation"] == later[:-2] + " (calculated sale total: 3 × $2.50 = $7.5) é"
    for same in (sale(quantity="3\n", user_quotation="sold 3\n for $2.50 each"), sale(user_quotation="sold 3 jars for $2.50 eachy"), sale(user_quotation="unsold 3 jars for $2.50 each"), sale(user_quotation="sold 3.0 jars for $2.50 each")):
        assert note(same) == same


def test_truncation(spark):
    text = " ".join(map(str, range(100)))
    cut = one(spark, H.truncate_middle(F.col("t"), 60), t=text)
    head, tail = cut.split(H.MARKER)
    assert text.startswith(head) and text.endswith(tail) and len(H.word_counter()[0](cut)) <= 60
    assert cut == one(spark, H.truncate_middle(F.col("t"), 60, H.word_counter), t=text)
    assert one(spark, H.truncate_middle(F.col("t"), 500), t=text) == text
    assert one(spark, H.truncate_middle(F.col("t"), 10), t=text) == "".join(H.word_counter()[0](text)[:10])
    assert one(spark, H.truncate_head(F.col("t"), 3), t=text) == one(spark, H.truncate_head(F.col("t"), 3, H.word_counter), t=text) == "0 1"
    import public_tokenizers

    vocabulary = H.vocabulary_counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert one(spark, H.truncate_head(F.col("t"), 3, vocabulary), t=text) == "0 1 2" and one(spark, H.count_tokens(F.col("t"), vocabulary), t="a<|endoftext|>b") > 3
    assert one(spark, H.count_tokens(F.col("t"), H.word_counter), t="a b") == 3
    with pytest.raises(ValueError):
        H.truncate_middle(F.col("t"), 0)


def test_fact_replies():
    body = "Anna works at Acme. She likes tea! Bob too"
    reply = json.dumps([
        {"subject": "Anna", "relation": "works  at", "object": "Acme", "quote": "works at Acme", "supersedes": "Yes"},
        {"subject": "anna", "relation": "works at", "object": "ACME", "quote": "x"},
        {"subject": "Bob", "relation": "likes", "object": "tea", "quote": "not there"},
        {"subject": "", "relation": "r", "object": "o", "quote": "q"}, "text", {"subject": "s" * 201, "relation": "r", "object": "o", "quote": "q"},
    ])
    got = replies.parse_fact_reply(f"```json\n{reply}\n```", body)
    assert [(g["subject"], g["quote"], g["supersedes"]) for g in got] == [("Anna", "works at Acme", True), ("Bob", "She likes tea!", False)]
    for bad in (None, "", " NULL ", "[", "{}", '{"a": [1}', "[1, 2"):
        assert replies.parse_fact_reply(bad, body) == []


def test_entity_replies():
    assert replies.parse_entity_reply('noise ["Anna", " anna ", 3, "", "B  c"] more') == {"status": "entities", "entities": ["Anna", "B c"]}
    assert [replies.parse_entity_reply(r)["status"] for r in (None, "none", "hello", '{"a": 1}', '[""]')] == ["null", "null", "invalid", "invalid", "empty"]
    assert len(replies.parse_entity_reply(json.dumps([str(i) for i in range(30)]))["entities"]) == 12


def test_objects():
    assert replies.json_object(' {"a": 1} ') == ({"a": 1}, "direct")
    assert replies.json_object('x {"a": 1} y {"b": "}"} z {broken}') == ({"b": "}"}, "recovered")
    assert replies.json_object("none") is None and replies.json_object(None) is None and replies.json_object("[1]") is None


def test_plans():
    good = replies.parse_plan_reply('{"steps": [{"id": "s1", "query": "a", "depends_on": []}, {"id": "s2", "query": "b {{s1}}", "depends_on": []}, {"id": "s3", "query": "c", "depends_on": ["s1"]}]}')
    assert [(s["depends_on"], s["repaired"], s["unused"]) for s in good["steps"]] == [([], False, []), (["s1"], True, []), ([], True, ["s1"])]
    for steps in ([], [{"id": "x", "query": "a", "depends_on": []}], [{"id": "s1", "query": " ", "depends_on": []}], [{"id": "s1", "query": "a\nb", "depends_on": []}], [{"id": "s1", "query": "{{s1}}", "depends_on": []}], [{"id": "s1", "query": "a", "depends_on": ["s0"]}], [{"id": "s1", "query": "a"}], 3):
        assert replies.parse_plan_reply(json.dumps({"steps": steps}))["status"] == "invalid"


def test_answers_and_decisions():
    reply = '{"status": "answered", "answer": "x", "evidence": [{"document_index": 0, "quote": " b "}, {"document_index": 1, "quote": " "}]}'
    assert [e["verified"] for e in replies.parse_answer_reply(reply, ["a b c", "d"])["evidence"]] == [True, False]
    for bad in (reply.replace("1,", "2,"), reply.replace('"x"', "null"), reply.replace('"x"', '"a\\nb"'), reply.replace("answered", "other"), "{}", reply.replace("0,", "true,")):
        assert not replies.parse_answer_reply(bad, ["a b c", "d"])["valid"]
    base = {"is_sufficient": True, "evidence_indices": [1, 0, 1], "new_query": "q", "confidence_score": 1}
    assert replies.parse_decision_reply(json.dumps(base), 2)["evidence_indices"] == [1, 0]
    for change in ({"is_sufficient": 1}, {"evidence_indices": [2]}, {"evidence_indices": [True]}, {"new_query": "a\nb"}, {"confidence_score": 1.5}, {"confidence_score": True}, {"confidence_score": float("nan")}, {"more": 1}):
        assert not replies.parse_decision_reply(json.dumps(base | change), 2)["valid"]
