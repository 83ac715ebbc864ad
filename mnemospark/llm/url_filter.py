"""URL rules found by their rarest literal token. Spark expressions only.

A rule is a regular expression over host and path, with the literal tokens (runs of letters and digits) that any fitting
url must hold as whole tokens. Each rule is filed under the one of them that is rarest among the urls; the tokens of a url
fetch candidate rules by an equi-join, and only those run their expressions. Rules without a whole literal token are filed
under an empty token that every url has. Work is done once a distinct host and path.

Rules come from a list of hosts and paths and from a table of patterns (verdict, pattern), which may be of any size: `||host`
fits a host and its subdomains, `*` any run of characters, `^` one character that isn't a letter or digit, or an end; other
characters mean themselves, in lower case as in the url's host and path.

Null urls and urls without `://` have an empty host and path, fit no rule, take no part in the joins and are allowed. Null
patterns and verdicts other than allow and block are no rules. Repeated pages are judged each for itself; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host words of the method's own rules: a host that has one of them as a whole word is blocked.
SPAM_WORDS = ("casino", "pills", "bets", "poker", "viagra", "xxx", "warez", "payday")

Rule = tuple[str | None, str, list[str], str, int, int]  # name, expression, tokens, verdict, level, length


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and all its subdomains (empty: any host) whose urls' paths begin with `path`; it goes before any
    word rule."""
    whole = path if not path or not path[-1].isalnum() else path[: len(path) - len(re.search(r"[0-9A-Za-z]+$", path)[0])]
    tokens = re.findall(r"[0-9a-z]+", f"{host} {whole}".lower())
    site = rf"(?:[^/]*\.)?\Q{host.lower()}\E(?=/|$)" if host else "[^/]*"
    return host + path, rf"^{site}\Q{path}\E", tokens, verdict, 1, len(host + path)


def word_rule(verdict: str, word: str) -> Rule:
    return None, rf"^(?:[^/]*[^/0-9a-z])?{word}(?:[^0-9a-z]|$)", [word], verdict, 0, len(word)


DEFAULT_WORD_RULES = [word_rule("block", w) for w in SPAM_WORDS]
_RULE = "name string, expression string, tokens array<string>, verdict string, level int, length int"


def pattern_rules(table: DataFrame) -> DataFrame:
    """Rules of a table (verdict, pattern). A token is a run of letters and digits of the pattern that has another literal character, or
    the begin of a host, on either side; only such runs are whole tokens of every url that fits."""
    rows = table.where("pattern is not null and pattern <> '' and verdict in ('allow', 'block')").select("verdict", F.lower("pattern").alias("pattern")).distinct()
    body = F.regexp_replace("pattern", r"^[|][|]", "")
    literal = F.regexp_replace(body, r"([^0-9a-z*^])", r"\\$1")
    inner = F.replace(F.replace(literal, F.lit("^"), F.lit("(?:[^0-9a-z]|$)")), F.lit("*"), F.lit(".*"))
    site = F.when(F.startswith("pattern", F.lit("||")), r"^(?:[^/]*\.)?").otherwise("")
    tokens = F.regexp_extract_all(F.concat(F.when(F.startswith("pattern", F.lit("||")), "|").otherwise(""), body), F.lit(r"(?<=[^0-9a-z*])[0-9a-z]+(?=[^0-9a-z*])"), F.lit(0))
    return rows.select(F.lit(None).cast("string").alias("name"), F.concat(site, inner).alias("expression"), tokens.alias("tokens"), "verdict", F.lit(0).alias("level"), F.length("pattern").alias("length"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: list[Rule], word_rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", patterns: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page: the longest fitting host rule decides, else the longest other rule (of
    equal ones a blocking one), else allow. patterns: a table as pattern_rules() takes it."""
    spark = pages.sparkSession
    all_rules = [*rules, *(DEFAULT_WORD_RULES if word_rules is None else word_rules)]
    table = spark.createDataFrame([tuple(r) for r in all_rules], _RULE)
    if patterns is not None:
        table = table.unionByName(pattern_rules(patterns))
    table = table.withColumn("id", F.xxhash64("level", "expression", "verdict", F.coalesce("name", F.lit(""))))

    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    named_urls = split.where("host <> '' or path <> ''")
    urls = named_urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    words = F.array_distinct(F.split(F.lower(F.concat("host", F.lit(" "), "path")), "[^0-9a-z]+"))
    tokens = urls.select("host", "path", "n", F.explode(F.array_union(words, F.array(F.lit("")))).alias("token"))

    named = table.select("id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token")).distinct()
    seen = tokens.groupBy("token").agg(F.sum("n").alias("seen"))
    rarest = named.join(seen, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token")).alias("x"))
    index = rarest.select("id", "x.token").join(table, "id")

    fits = tokens.join(index, "token").where(F.expr("concat(host, path) rlike expression"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("level", "length", F.expr("verdict = 'block'").alias("b"), "name", "verdict")).alias("x"))
    best = best.select("host", "path", F.col("x.name").alias("rule"), F.col("x.verdict").alias("found"))
    judged = named_urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"))
    return judged.unionByName(split.where("host = '' and path = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")))
