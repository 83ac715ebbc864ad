"""The registered queries of these operators: each reads its whole table and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontaminate, divergence, fill_middle, lm_score, minhash, packing, pii, quality, substrings, token_counts, token_files, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write token files in doc_id order, read them back: start, length and checksum of each document."""
    folder = token_files.write_token_files(_table(spark, sf_dir, "documents"))
    return token_files.with_crc32(token_files.read_token_files(spark, folder))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside benchmark windows of 13 words."""
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingle sets are similar by 0.8 or more."""
    return minhash.near_duplicate_groups(_table(spark, sf_dir, "documents"), shingle=4)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted properties of every text, and whether it is kept."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in sequences of at most 4096 tokens, and their checksums."""
    return token_files.with_crc32(packing.pack(_table(spark, sf_dir, "documents")))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents have in common with an earlier document."""
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data: counts and digest of the base kinds, and all spans."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < 4)
    kinds = F.transform("spans", lambda x: x["kind"])
    count = {k: F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long") for k in ("email", "ip", "card", "phone")}
    return found.select("doc_id", *(c.alias(f"n_{k}") for k, c in count.items()), F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that fits each page's url, and the verdict."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), [url_filter.host_rule(*r) for r in HOST_RULES])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with the sums that answer totals and quantiles of every context limit."""
    return token_counts.with_suffix_sums(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more each document is like the wanted ones than like all."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return lm_score.score(docs, lm_score.fit(docs, labels), labels)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in fill-in-the-middle form: how it was cut, and digests of the output and of the text restored from it."""
    return fill_middle.with_digests(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text, by a model of the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's words are from those of the others of its language, and the terms that set it apart."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP2_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP3_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x20\\x09-\\x0D]+')"

OP2_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_OP2_WORDS} AS w FROM benchmark),
wi AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS p FROM i WHERE len(w) > 0)
),
d AS (SELECT doc_id, {_OP2_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM wi) WHERE len(w) >= n)
),
m AS (SELECT doc_id, n, p, item_id FROM dw JOIN wi USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_OP3_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, hash(array_to_string(w[p : p + least(4, len(w)) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS p FROM d WHERE len(w) > 0) GROUP BY ALL
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.v) AS component_id, min(r.v) = d.doc_id AS kept
FROM d JOIN r ON r.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

OP8_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM b
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[^0-9a-z])({'|'.join(url_filter.SPAM_WORDS)})([^0-9a-z]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""

_OP11_NUMBER = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
OP11_SQL = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
b AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {_OP11_NUMBER.format(1)} % (length(t) + 1) AS x, {_OP11_NUMBER.format(9)} % (length(t) + 1) AS y, CASE
    WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_OP11_NUMBER.format(17)} % 100 >= 90 THEN 'plain'
    WHEN {_OP11_NUMBER.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM a
),
c AS (SELECT *, least(x, y) AS i, greatest(x, y) AS j FROM b),
d AS (SELECT *, substr(t, 1, i) AS p, substr(t, i + 1, j - i) AS m, substr(t, j + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM d
"""

_OP13_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_OP13_P = "1 + (1000000000::HUGEINT * ({} + 2)) // ({} + 2 * v)"
_OP13_F = "CAST(({p} - {q}) * ({p} - {q}) // ({p} + {q}) AS BIGINT)"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_OP13_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
k AS (SELECT lang, t, sum(n) AS n_lang FROM o GROUP BY ALL HAVING count(*) >= 10),
kl AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM k GROUP BY lang),
c AS (SELECT lang, source, t, sum(n) AS n FROM o JOIN k USING (lang, t) GROUP BY ALL),
cg AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
s AS (
  SELECT lang, source, t, coalesce(n, 0) AS n, {_OP13_P.format("coalesce(n, 0)", "coalesce(total, 0)")} AS p, {_OP13_P.format("n_lang", "total_lang")} AS q
  FROM g JOIN k USING (lang) JOIN kl USING (lang) LEFT JOIN c USING (lang, source, t) LEFT JOIN cg USING (lang, source)
),
f AS (SELECT a.lang, a.source, b.source AS item, sum({_OP13_F.format(p="a.p", q="b.p")}) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
),
term AS (SELECT lang, source, 'term' AS part, t AS item, {_OP13_F.format(p="p", q="q")} AS value FROM s WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM x WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_token_files, op2_decontamination, op3_near_duplicates, op4_quality_rules, op5_best_fit_packing, op6_repeated_passages, op7_personal_data, op8_url_filter, op9_token_counts, op10_lm_score, op11_fill_in_middle, op12_toxicity, op13_source_divergence)}
ORACLES: dict[str, str] = {"op2_decontamination": OP2_SQL, "op3_near_duplicates": OP3_SQL, "op8_url_filter": OP8_SQL, "op11_fill_in_middle": OP11_SQL, "op13_source_divergence": OP13_SQL}
