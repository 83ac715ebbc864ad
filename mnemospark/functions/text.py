"""Column functions over texts: trimming, ids, rendering, default tokens. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode sees it (fixed values); the JVM's own classes differ at U+001C to U+001F and U+0085.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, f"[{SPACE}]+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def _prefixed(*parts: Column) -> Column:
    return F.concat(*[F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts])


def identity(*parts: Column) -> Column:
    """SHA-256 of the parts, each with its length before it."""
    return F.sha2(_prefixed(*parts), 256)


def memory_id(user: Column, session: Column, request: Column, local_index: Column) -> Column:
    return identity(user, session, request, local_index.cast("string"))


def source_message_id(parent: Column, source_index: Column) -> Column:
    return identity(F.lit("source-message"), parent, source_index.cast("string"))


def point_id(memory: Column) -> Column:
    """The first 32 hex digits as a UUID; an error if there are fewer."""
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    uuid = F.concat_ws("-", *[F.substring(memory, a, n) for a, n in at])
    return F.when(F.char_length(memory) >= 32, uuid).otherwise(F.raise_error(F.concat(F.lit("memory id too short: "), memory)).cast("string"))


# ---------------------------------------------------------------- rendering


def event_day(ms: Column) -> Column:
    """The UTC day as yyyy-MM-dd, empty for null; whatever the session's time zone."""
    return F.coalesce(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")), "yyyy-MM-dd"), F.lit(""))


def render(question: Column, answer: Column, day: Column | None = None) -> Column:
    """`Q: …` and `A: …` lines, empty sides left out; with the day in brackets before a text that isn't empty."""
    line = lambda mark, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(mark), x))
    text = strip(F.concat_ws("\n", line("Q: ", question), line("A: ", answer)))
    if day is None:
        return text
    return F.when((text != "") & (day != ""), F.concat(F.lit("["), day, F.lit("] "), text)).otherwise(text)


def render_evidence(statement: Column, source_date: Column, quote: Column, quantitative: Column) -> Column:
    return F.concat_ws("\n", F.lit("Memory fact"), F.concat(F.lit("Statement: "), statement), F.concat(F.lit("Source record date: "), source_date), F.when(~quantitative, F.concat(F.lit("Source quotation: "), quote)))


def render_record_evidence(source_id: Column, source_date: Column, quote: Column, **fields: Column) -> Column:
    """A JSON record with the given fields after the fixed ones."""
    return F.to_json(F.struct(source_id.alias("source_id"), source_date.alias("source_record_date"), quote.alias("user_quotation"), *[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def query_instruction(query: Column, task: str, template: str = "Instruct: {task}\nQuery: {query}") -> Column:
    """The query as the dense arm sees it; unchanged for an empty task."""
    if not task:
        return query
    before, _, after = template.replace("{task}", task).partition("{query}")
    return F.concat(F.lit(before), query, F.lit(after))


# ---------------------------------------------------------------- default tokens

#: A token is a run of letters, digits and marks, or any other single character that isn't white space.
TOKEN = rf"[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_{SPACE}]"


def token_count(text: Column) -> Column:
    """Tokens of the default counter, 0 for empty or null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def terms(text: Column) -> Column:
    """Lower-cased words of a text, in order and with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))


# ---------------------------------------------------------------- canonical JSON


def _json_string(text: Column) -> Column:
    """A JSON string with the short escapes and lower-case hexadecimal ones."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_request(user: Column, session: Column, messages: Column) -> Column:
    """The request as JSON with sorted keys, no blanks, nulls kept and contents stripped.

    The JVM writes hexadecimal escapes in upper case; requests that need one are built by hand, all others by to_json.
    """
    clean = F.transform(messages, lambda m: F.struct(strip(m["content"]).alias("content"), m["role"].alias("role"), m["timestamp"].alias("timestamp")))
    plain = F.to_json(F.struct(clean.alias("messages"), session.alias("session_id"), user.alias("user_id")), {"ignoreNullFields": "false"})
    one = lambda m: F.concat(
        F.lit('{"content":'), _json_string(strip(m["content"])), F.lit(',"role":'), _json_string(m["role"]),
        F.lit(',"timestamp":'), F.coalesce(m["timestamp"].cast("string"), F.lit("null")), F.lit("}"),
    )
    built = F.concat(F.lit('{"messages":['), F.array_join(F.transform(messages, one), ","), F.lit('],"session_id":'), _json_string(session), F.lit(',"user_id":'), _json_string(user), F.lit("}"))
    return F.when(plain.rlike(r"\\u00"), built).otherwise(plain)
