"""Personal data: patterns propose spans, checks confirm them, nearby words adjust the score. Spark expressions only.

Each kind is one pattern. Splitting a text at the matches and extracting the matches gives the lengths from which places
follow, in code points. Base kinds (email, ip, card, phone) are kept whenever their own check holds; the other kinds are
kept if their score, raised by a passed checksum and by context words within 40 characters, reaches the threshold and they
overlap no base span. Patterns are written so that long runs of word characters or digits cost linear time: they only start
at the beginning of a run (or where the last match ended) and never give back what they took.

Null text is empty. Rows with null or repeated doc_ids are searched each for itself; an empty table gives no rows; other
columns are ignored by `find_pii` and kept by `redact`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import documents

THRESHOLD = 0.6
CONTEXT = 40
_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """A pattern, a quick test that any text with a match passes, a check of the match, and its scores."""

    name: str
    pattern: str
    quick: str
    check: object = None
    score: float = 0.5
    context: tuple[str, ...] = field(default=())
    boost: float = 0.3
    base: bool = False
    trim: object = None


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """The Luhn sum of the digits is a multiple of ten."""
    digits = F.split(F.reverse(_digits(m)), "(?!$)")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(m: Column) -> Column:
    """An account number, its first four characters moved to the end and letters as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(m, " ", "")
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "(?!$)")
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def account_number(m: Column) -> Column:
    """The longest head of the match that ends with it or before a blank and is a valid account number; null if there is none."""
    groups = F.split(m, " ")
    heads = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    return F.get(F.filter(heads, lambda h: (F.length(F.replace(h, F.lit(" "))) >= 15) & mod97(h)), F.lit(0))


def _between(m: Column, low: int, high: int) -> Column:
    return F.length(_digits(m)).between(low, high)


_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "%@%", base=True, score=0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "%.%.%.%", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), base=True, score=0.7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", "", lambda m: _between(m, 14, 19) & luhn(m), base=True, score=0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "%+%", lambda m: _between(m, 10, 15), base=True, score=0.8),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", None, 0.8, ("iban", "account", "bank", "konto", "cuenta", "compte"), 0.2, trim=account_number),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "%-%-%", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.4, ("ssn", "social security", "tax id", "national id")),
    Kind("local_phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", "", None, 0.4, ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone")),
    Kind("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}+", "", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 0.3, ("token", "secret", "password", "api key", "api_key", "apikey", "access key"), 0.4),
)


def _places(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, text>> of all matches, in code points."""
    rows = F.arrays_zip(F.split(text, kind.pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"))
    rows = F.transform(F.filter(rows, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("n"), x["m"].alias("text")))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        row = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["text"].alias("text"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


_SPAN = "struct<start:int,rank:int,end:int,kind:string,text:string,score:double>"


def _spans(text: Column, rank: int, kind: Kind, threshold: float) -> Column:
    found = _places(text, kind)
    if kind.check is not None:
        found = F.filter(found, lambda x: kind.check(x["text"]))

    if kind.trim is not None:
        heads = F.transform(found, lambda x: F.struct(x["start"].alias("start"), kind.trim(x["text"]).alias("text")))
        heads = F.filter(heads, lambda x: x["text"].isNotNull())
        found = F.transform(heads, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), x["text"].alias("text")))

    def scored(x):
        score = F.lit(kind.score)
        if kind.context:
            before = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
            near = F.lower(F.concat_ws(" ", before, F.substring(text, x["end"] + 1, F.lit(CONTEXT)))).rlike(r"(?U)(?<!\w)(?:" + "|".join(kind.context) + r")(?!\w)")
            score = F.least(F.lit(1.0), score + F.when(near, kind.boost).otherwise(0.0))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), x["text"].alias("text"), score.alias("score"))

    found = F.transform(found, scored)
    if not kind.base:
        found = F.filter(found, lambda x: x["score"] >= threshold)
    quick = text.like(kind.quick) if kind.quick else F.lit(True)
    return F.when(quick & text.rlike(kind.pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _with_spans(df: DataFrame, text_col: str, threshold: float, out: str) -> DataFrame:
    """df with the sorted spans of its text as a column `out`; two helper columns are dropped."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[_spans(text, i, k, threshold) for i, k in enumerate(KINDS) if k.base])
    more = F.concat(*[_spans(text, i, k, threshold) for i, k in enumerate(KINDS) if not k.base])
    both = df.withColumns({f"{out}_base": base, f"{out}_more": more})
    apart = F.filter(f"{out}_more", lambda x: ~F.exists(f"{out}_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return both.withColumn(out, F.array_sort(F.concat(f"{out}_base", apart))).drop(f"{out}_base", f"{out}_more")


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans are (start, rank, end, kind, text, score) sorted by start, then kind as listed."""
    return _with_spans(documents(docs, id_col, text_col), "text", threshold, "spans").select("doc_id", "spans")


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one. Null text stays null."""
    helper = "_pii_spans"
    while any(c.startswith(helper) for c in docs.columns):
        helper += "_"
    found = _with_spans(docs, text_col, threshold, helper)
    text = F.col(text_col)

    def step(acc, x):
        new = F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate(
        helper, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.lit((1 << 31) - 1))),
    )
    return found.withColumn(text_col, F.when(F.size(helper) > 0, clean).otherwise(text)).select(*docs.columns)
