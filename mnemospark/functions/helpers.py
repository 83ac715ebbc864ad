"""Vectorized helpers for what Spark has no built-in function: keys, token cuts, sale totals, term matching."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import text as T

#: Fixed values.
KEY_MARKS = " ?.!。！？"
PREPOSITIONS = ("of", "at", "for", "in", "to", "with", "by")
FIRST_PERSON = ("i", "user", "用户", "我")


# ---------------------------------------------------------------- keys


def key_of(value: str) -> str:
    folded = unicodedata.normalize("NFKC", value).casefold()
    return " ".join(folded.split()).strip(KEY_MARKS)


def singular(word: str) -> str:
    if word.endswith("ies"):
        return word[:-3] + "y"
    if re.search("(?:ss|sh|ch|x|z)es$", word):
        return word[:-2]
    return re.sub("(?<!s)s$", "", word)


def relation_key_of(value: str) -> str:
    words = key_of(value).split()
    last = max((i for i, w in enumerate(words) if w not in PREPOSITIONS), default=0)
    return singular(" ".join(words[: last + 1]))


class Once:
    """A factory whose product is made at its first use in each process and never sent along."""

    def __init__(self, make: Callable):
        self.make = make

    def __getstate__(self) -> dict:
        return {"make": self.make}

    def __call__(self):
        if not hasattr(self, "made"):
            self.made = self.make()
        return self.made


def _strings(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([None if v is None else known[v] if v in known else known.setdefault(v, f(v)) for v in values], dtype=object)

    return run


def fact_key(value: Column) -> Column:
    """A name compared: NFKC, case-folded, white space collapsed, end marks stripped. ASCII stays in the JVM."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), r"[\t-\r\x1c-\x20]+", " "), r"^[ ?.!]+|[ ?.!]+$", "")
    return F.when(value.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(_strings(key_of)(value))


def folded(value: Column) -> Column:
    """Case-folded, by Python's rules."""
    return _strings(str.casefold)(value)


def relation_key(value: Column) -> Column:
    """fact_key() without trailing prepositions and simple plural endings."""
    cut = F.regexp_replace(fact_key(value), "(?: (?:" + "|".join(PREPOSITIONS) + "))+$", "")
    return (
        F.when(cut.rlike("ies$"), F.regexp_replace(cut, "ies$", "y"))
        .when(cut.rlike("(?:ss|sh|ch|x|z)es$"), F.regexp_replace(cut, "es$", ""))
        .otherwise(F.regexp_replace(cut, "(?<!s)s$", ""))
    )


# ---------------------------------------------------------------- token counters

Counter = tuple[Callable[[str], list], Callable[[list], str]]  # encode, decode


def word_counter() -> Counter:
    """Pieces of the default counter, white space kept as pieces so that they join to the text."""
    pattern = re.compile(r"\s+|\w+|[^\w\s]")
    return pattern.findall, "".join


def vocabulary_counter(path: str) -> Callable[[], Counter]:
    """A factory of the counter of a public tokenizer file (of the `tokenizers` library); special tokens are ordinary text."""

    def make() -> Counter:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, tokenizer.decode

    return make


def count_tokens(text: Column, make_counter: Callable[[], Counter]) -> Column:
    """Tokens by a pluggable counter, made once a worker; 0 for null or empty."""
    make = Once(make_counter)

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        encode = make()[0]
        return values.map(lambda v: len(encode(v)) if v else 0).astype("int64")

    return run(text)


#: Fixed values.
MARKER, SLACK = "\n...\n", 16
EMBED_LIMIT = int(8192 * 0.56)
#: A piece of the default counter with white space, as Spark's regular expressions have it.
PIECE = rf"[{T.SPACE}]+|[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_{T.SPACE}]"
_MARKER_PIECES = 5  # the two line ends and three dots


def kept_ends(limit: int, marker_tokens: int) -> tuple[int, int]:
    """How many tokens stay at the begin and at the end of a text over the limit; all at the begin if the marker has no room."""
    both = limit - marker_tokens - SLACK
    return (limit, 0) if both < 2 else (both // 2, both - both // 2)


def _check(limit: int) -> None:
    if limit <= 0:
        raise ValueError(f"limit must be positive, not {limit}")


def truncate_middle(text: Column, limit: int = EMBED_LIMIT, make_counter: Callable[[], Counter] | None = None) -> Column:
    """Texts over the limit keep their first and last halves around a marker; only their head if the marker does not fit.

    Without a counter the default pieces count, in the JVM. A vocabulary counter cuts at its own tokens, so a cut may fall
    inside a word.
    """
    _check(limit)
    if make_counter is None:
        first, last = kept_ends(limit, _MARKER_PIECES)
        ends = lambda p: [F.slice(p, 1, first), *([F.array(F.lit(MARKER)), F.slice(p, -last, last)] if last else [])]
        return _when_longer(text, limit, lambda p: F.concat(*ends(p)))
    make = Once(make_counter)

    def cut(v: str) -> str:
        encode, decode = make()
        ids = encode(v)
        if len(ids) <= limit:
            return v
        first, last = kept_ends(limit, len(encode(MARKER)))
        return decode(ids[:first]) + (MARKER + decode(ids[-last:]) if last else "")

    # a text cannot have more tokens than bytes
    return F.when(F.octet_length(text) > limit, _strings(cut)(text)).otherwise(text)


def truncate_head(text: Column, limit: int, make_counter: Callable[[], Counter] | None = None) -> Column:
    """The first `limit` tokens, by the default pieces (in the JVM) or by a counter."""
    _check(limit)
    if make_counter is None:
        return _when_longer(text, limit, lambda p: F.slice(p, 1, limit))
    make = Once(make_counter)

    def cut(v: str) -> str:
        encode, decode = make()
        ids = encode(v)
        return v if len(ids) <= limit else decode(ids[:limit])

    return F.when(F.octet_length(text) > limit, _strings(cut)(text)).otherwise(text)


def _when_longer(text: Column, limit: int, keep: Callable[[Column], Column]) -> Column:
    """What is kept of the pieces of texts that have more than `limit`; other texts as they are."""
    cut = F.transform(F.array(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))), lambda p: F.when(F.size(p) > limit, F.array_join(keep(p), "")).otherwise(text))
    return F.when(F.octet_length(text) > limit, F.get(cut, F.lit(0))).otherwise(text)


# ---------------------------------------------------------------- sale totals

#: The record's kind and sign, and the words around the total.
SALE_KIND, SALE_SIGN, NOTE = "reported sale", "$", "(calculated sale total: "
MOST = 1_000_000
#: Up to a million with so many decimals, and exact products of two of these.
_AMOUNT, _PRODUCT = "decimal(18,11)", "decimal(38,22)"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def annotate_unit_totals(content: Column) -> Column:
    """JSON records of reported sales whose quotation says `sold Q …` and `for $P each`, with the exact total noted in it.

    A record is left as it is, byte for byte, unless its kind and currency fit, quantity and unit price are strings of a number
    up to a million with at most eleven decimals, no total is reported and none is noted yet. A changed record is
    written anew without blanks between its parts. A record is parsed once, and patterns are the same for all records but those whose
    first price in such words is not the unit price.
    """
    amount = lambda x: F.when(x.rlike(r"^[0-9]{1,7}(?:[.][0-9]{1,11})?\z"), x.try_cast(_AMOUNT))
    priced = r"(?isU)^.*?\bfor\s+[$]{}\s+each\b"

    def fields(record: Column) -> Column:
        get = lambda key: F.try_variant_get(record, f"$.{key}", "variant")
        text = lambda key: _with(get(key), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
        fits = (text("record_kind") == SALE_KIND) & (text("currency_symbol") == SALE_SIGN) & get("reported_total").isNull()
        return F.when(fits, F.struct(text("user_quotation").alias("quote"), text("quantity").alias("q"), text("unit_price").alias("p")))

    def amounts(r: Column) -> Column:
        return F.struct(r["quote"].alias("quote"), r["q"].alias("q"), r["p"].alias("p"), amount(r["q"]).alias("n"), amount(r["p"]).alias("price"))

    def to_price(r: Column) -> Column:
        """The quotation up to the first such words with the unit price."""
        of_price = F.concat(F.lit(priced.format("").removesuffix(r"\s+each\b")), F.replace(r["p"], F.lit("."), F.lit("[.]")), F.lit(r"\s+each\b"))
        first = lambda head: F.when(F.regexp_extract(head, r"(?U)(\S+)\s+\S+$", 1) == F.concat(F.lit(SALE_SIGN), r["p"]), head).when(head != "", F.regexp_substr(r["quote"], of_price))
        return _with(F.regexp_extract(r["quote"], priced.format(r"\S+"), 0), first)

    def noted(r: Column) -> Column:
        total = F.regexp_replace((r["n"] * r["price"]).cast(_PRODUCT).cast("string"), r"[.]?0+$", "")
        note = F.concat(F.lit(" " + NOTE), r["q"], F.lit(" × " + SALE_SIGN), r["p"], F.lit(" = " + SALE_SIGN), total, F.lit(")"))
        sold = F.regexp_extract_all(r["quote"], F.lit(r"(?iU)\bsold(?=\s+(\S+)\s)"), F.lit(1))
        fits = (r["n"] <= MOST) & (r["price"] <= MOST) & ~r["quote"].contains(" " + NOTE) & F.array_contains(sold, r["q"])
        return F.when(fits, _with(to_price(r), lambda head: F.concat(head, note, F.substr(r["quote"], F.char_length(head) + 1))))

    def written(quote: Column) -> Column:
        parts = F.from_json(content, "map<string,variant>")
        return F.when(quote.isNotNull(), F.to_json(F.transform_values(parts, lambda k, v: F.when(k == "user_quotation", quote.cast("variant")).otherwise(v))))

    changed = _with(F.try_parse_json(content), lambda record: _with(fields(record), lambda t: _with(amounts(t), lambda r: _with(noted(r), written))))
    return F.when(content.contains(SALE_KIND), F.coalesce(changed, content)).otherwise(content)


# ---------------------------------------------------------------- lexicon


def fold(text: str) -> str:
    return " ".join(text.casefold().split())


class TermMatcher:
    """All terms of a lexicon in a text: Latin terms as whole words, terms with Han characters anywhere."""

    def __init__(self, terms: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term in sorted(set(terms)):
            if term:
                self.automaton.add_word(term, (term, bool(re.search("[\u4e00-\u9fff]", term))))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, text: str) -> list[str]:
        folded = fold(text)
        if not len(self.automaton) or not folded:
            return []
        inner = lambda c: c.isascii() and (c.isdigit() or "a" <= c <= "z")
        found = set()
        for end, (term, han) in self.automaton.iter(folded):
            begin = end - len(term) + 1
            if han or not (begin and inner(folded[begin - 1]) or end + 1 < len(folded) and inner(folded[end + 1])):
                found.add(term)
        return sorted(found)


def lexicon_terms(text: Column, terms: Sequence[str]) -> Column:
    """The distinct terms in each text, sorted; one matcher a worker."""
    make = Once(lambda: TermMatcher(terms))

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        matcher = make()
        return values.map(lambda v: matcher.find(v or ""))

    return run(text)
