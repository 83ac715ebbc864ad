"""Source divergence audit: how the word use of each source differs from that of the other sources of its language.

Term strings are materialized late. Each task sums its own texts exactly and writes its sums once, term strings in a column
of their own; what is then shuffled to be counted are group and term digests of 64 bits and numbers, nothing else. The strings
of kept terms are read after that: the least and the greatest string of a digest differ just if terms collide, and the counts of
such digests are split by string, so results are exact whatever the digests. Text is joined back to the rows of the output only.

A term is a run of ASCII letters and code points above U+007F, only A-Z lower-cased. A language keeps the V terms that at least
`min_docs` of its documents hold. A group (lang, source), or a language as a whole, gives a kept term with `count` occurrences
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the sum of its counts; two shares p and q differ by f = floor((p - q)^2 / (p + q)).
Everything is done in whole numbers.

A pair of sources needs the sum of f over all V terms. Terms that neither holds give the same f each; terms that one holds are
summed from the histogram of its counts; only terms that both hold are met pairwise, so the work grows with shared terms
and not with V times the square of the sources. The output itself has a row for each ordered pair of sources of a language.

Null text, lang and source are empty strings. Groups without terms count like others; repeated rows count each; an empty table
gives no rows, a language without kept terms gives pairs of value 0; other columns are not read. Equal values are ranked by UTF-8
bytes of the item. Texts are taken apart whole, PART_BYTES at once (a longer one alone).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import Alphabet, bit_filter, chunked, small_arrow_batches, stage, text_buffers, to_batch, unstage

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
LETTERS = Alphabet(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
PART_BYTES = 1 << 19
#: Distinct (group, term) sums that a task holds before it writes them.
HELD = 200_000
_PAIRS = 1 << 20  # pairs of groups handled at once


# ---------------------------------------------------------------- terms of texts


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts in a row, and the text each lies in."""
    is_word = LETTERS.is_word[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = is_word
    inside[offsets[:-1]] = False  # whether the byte before, in the same text, is a letter
    start = np.flatnonzero(is_word & ~inside[:-1])
    bounds = np.append(np.concatenate([[0], np.cumsum(is_word)])[start], is_word.sum())
    flat = LETTERS.becomes[data][is_word]
    terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat.tobytes())])
    return terms, np.searchsorted(offsets, start, side="right") - 1


def _sums(group: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """(g, term, n, df) of a batch of texts: occurrences, and the number of texts."""
    terms, text = terms_of(data, offsets)
    coded = terms.dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs, n = np.unique(text * size + coded.indices.to_numpy(), return_counts=True)
    groups, which = np.unique(group, return_inverse=True)
    at, back, df = np.unique(which[pairs // size] * size + pairs % size, return_inverse=True, return_counts=True)
    total = np.bincount(back, n, len(at)).astype(np.int64)  # at most PART_BYTES or one text: exact
    return pa.table({"g": groups[at // size] if len(at) else np.zeros(0, np.int64), "term": coded.dictionary.take(pa.array(at % size)), "n": total, "df": df.astype(np.int64)})


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["g", "term"]).aggregate([("n", "sum"), ("df", "sum")]).rename_columns(["g", "term", "n", "df"])


def term_sums(rows: DataFrame) -> DataFrame:
    """rows (g, text) to (g, term, n, df): each task's own sums; a group's term is there once a task, more often in large tasks."""
    schema = pa.schema([("g", pa.int64()), ("term", pa.large_string()), ("n", pa.int64()), ("df", pa.int64())])

    def add_up(batches):
        held, size = [], 0
        for batch in chunked(batches, "text", PART_BYTES):
            held.append(_sums(batch.column(0).to_numpy(), *text_buffers(batch.column(1))))
            size += held[-1].num_rows
            if size > HELD:
                held = [_added(held)]
                size = held[0].num_rows
                if 2 * size > HELD:  # little is merged any more
                    yield from held[0].cast(schema).to_batches(max_chunksize=20_000)
                    held, size = [], 0
        if held:
            yield from _added(held).cast(schema).to_batches(max_chunksize=20_000)

    return rows.mapInArrow(add_up, "g long, term string, n long, df long")


# ---------------------------------------------------------------- exact shares


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count: decimals of 38 digits, so no size of corpus overflows; null without kept terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    over = whole(total) + whole(kept) * F.lit(2).cast("decimal(1,0)")
    return F.when(kept > 0, F.call_function("div", (whole(count) + F.lit(2).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)"), over) + 1)


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shared(shares: DataFrame) -> DataFrame:
    """(a, b, met, n), a < b: of the terms that both groups hold, their number and the sum of f less what f would be for an absent term.

    shares: (at, groups), a term's groups as structs (g, p, p0). Pairs are summed inside each task, which sends one row a pair of groups.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("met", pa.int64()), ("n", pa.int64())])

    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, met, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[first], b[first], np.add.reduceat(met[order], first), np.add.reduceat(n[order], first)

    def meet(batches):
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten()
            g, p, p0 = (values.field(i).to_numpy() for i in range(3))
            count = pc.list_value_length(lists).to_numpy()
            after = np.repeat(np.cumsum(count), count) - np.arange(len(g)) - 1  # groups behind this one in its list
            reach, begin = np.cumsum(after), 0
            while begin < len(g):
                done = reach[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(reach, done + _PAIRS, side="right")))
                many = after[begin:end]
                i = np.repeat(np.arange(begin, end), many)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                begin = end
                if not len(i):
                    continue
                swap = g[i] > g[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                met = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j])
                held.append(added([(g[i], g[j], met, np.ones(len(i), np.int64))]))
                size += len(held[-1][0])
                if size > _PAIRS:
                    held = [added(held)]
                    size = len(held[0][0])
                    if 2 * size > _PAIRS:
                        yield to_batch(schema, **dict(zip(schema.names, held[0], strict=True)))
                        held, size = [], 0
        if held:
            yield to_batch(schema, **dict(zip(schema.names, added(held), strict=True)))

    return shares.mapInArrow(meet, "a long, b long, met long, n long").groupBy("a", "b").agg(F.sum("met").alias("met"), F.sum("n").alias("both"))


# ---------------------------------------------------------------- operator


Save = Callable[[DataFrame, str], DataFrame]


def _groups(docs: DataFrame, save: Save) -> tuple[DataFrame, int]:
    """Groups with digests g and l of group and language, and the seed with which no two of them collide."""
    own = save(docs.select("lang", "source").distinct(), "groups")
    for seed in itertools.count():
        named = own.select(F.xxhash64(F.lit(seed), "lang", "source").alias("g"), F.xxhash64(F.lit(seed), "lang").alias("l"), "lang", "source")
        found = named.agg(F.count("*"), F.count_distinct("g"), F.count_distinct("lang"), F.count_distinct("l")).first()
        if found[0] == found[1] and found[2] == found[3]:
            return named, seed


def kept_counts(sums: DataFrame, groups: DataFrame, min_docs: int, save: Save) -> tuple[DataFrame, DataFrame]:
    """(counts, words): (g, l, digest, part, n, n_lang) of all kept terms, and (digest, part, item), their strings.

    `part` is empty but for terms whose digest is that of another term as well: there it is the term, and counts are by term.
    """
    small = groups.select("g", "l")
    counts = save(sums.groupBy("g", "digest").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).join(small, "g"), "counts")

    def keep(rows: DataFrame) -> DataFrame:
        kept = rows.groupBy("l", "digest", "part").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).where(F.col("df") >= min_docs).drop("df")
        return rows.join(kept, ["l", "digest", "part"]).select("g", "l", "digest", "part", "n", "n_lang")

    whole = counts.withColumn("part", F.lit(""))
    first = save(keep(whole), "kept")
    asked = save(first.select("digest").distinct(), "asked")
    strings = bit_filter(sums.select("digest", "term"), "digest", asked).groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
    words = save(strings.join(asked, "digest", "left_semi"), "words")
    collided = words.where("lo <> hi").select("digest")
    if collided.isEmpty():
        return first, words.select("digest", F.lit("").alias("part"), F.col("lo").alias("item"))
    split = sums.join(collided, "digest", "left_semi").groupBy("g", "digest", F.col("term").alias("part")).agg(F.sum("n").alias("n"), F.sum("df").alias("df")).join(small, "g")
    exact = save(keep(split), "kept-split")
    both = first.join(collided, "digest", "left_anti").unionByName(exact)
    items = words.where("lo = hi").select("digest", F.lit("").alias("part"), F.col("lo").alias("item"))
    return save(both, "kept-exact"), items.unionByName(exact.select("digest", "part", F.col("part").alias("item")).distinct())


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = 64, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group, part `pair` has every other source of its language by the sum of f,
    part `term` the `top` terms by f among those that the group uses more than its language."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    made: list[DataFrame] = []

    def save(df: DataFrame, name: str) -> DataFrame:
        made.append(stage(df, name))
        return made[-1]

    groups, seed = _groups(docs, save)
    sums = term_sums(docs.select(F.xxhash64(F.lit(seed), "lang", "source").alias("g"), "text"))
    sums = save(sums.withColumn("digest", F.shiftrightunsigned(F.xxhash64("term"), 64 - digest_bits)), "term-sums")
    counts, words = kept_counts(sums, groups, min_docs, save)

    langs = counts.select("l", "digest", "part", "n_lang").distinct().groupBy("l").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    own = counts.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    zero = {"v": 0, "total_lang": 0, "total": 0, "held": 0}
    stats = save(groups.join(langs, "l", "left").join(own, "g", "left").na.fill(zero).withColumn("p0", share(F.lit(0), F.col("total"), F.col("v"))), "stats")
    shares = counts.join(stats.select("g", "v", "total", "total_lang", "p0"), "g")
    shares = save(shares.select("g", "l", "digest", "part", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q")), "shares")

    # terms: ranks by value first, with all ties; text is joined to these rows only and breaks the ties
    best = shares.where("p > q").select("g", "digest", "part", difference(F.col("p"), F.col("q")).alias("value"))
    best = best.withColumn("at", F.rank().over(Window.partitionBy("g").orderBy(F.desc("value")))).where(F.col("at") <= top)
    by_item = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    best = best.join(words, ["digest", "part"]).withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    terms = best.join(groups, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # pairs: shared terms met in tasks, the others from histograms
    with small_arrow_batches(docs.sparkSession):
        met = save(_shared(shares.groupBy("l", "digest", "part").agg(F.collect_list(F.struct("g", "p", "p0")).alias("groups")).where("size(groups) > 1").select("groups")), "met")
    side = lambda x: stats.select(F.col("g").alias(x), "l", F.col("source").alias(f"source_{x}"), F.col("p0").alias(f"p0_{x}"), F.col("held").alias(f"held_{x}"))
    pairs = side("a").join(side("b").join(stats.select(F.col("g").alias("b"), "v"), "b"), "l").where("a <> b")
    histogram = shares.groupBy(F.col("g").alias("a"), "p").agg(F.count("*").alias("k"))
    lone = pairs.select("a", "b", "p0_b").join(histogram, "a").groupBy("a", "b").agg(F.sum(F.col("k") * difference(F.col("p"), F.col("p0_b"))).alias("lone"))
    lone = lone.unionByName(lone.select(F.col("b").alias("a"), F.col("a").alias("b"), "lone")).groupBy("a", "b").agg(F.sum("lone").alias("lone"))
    met = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "met", "both"))
    whole = pairs.join(lone, ["a", "b"], "left").join(met, ["a", "b"], "left").na.fill(0, ["lone", "met", "both"])
    absent = F.col("v") - F.col("held_a") - F.col("held_b") + F.col("both")
    value = F.when(F.col("v") > 0, F.col("lone") + F.col("met") + absent * difference(F.col("p0_a"), F.col("p0_b"))).otherwise(0)
    ranked = whole.select("a", F.col("source_b").alias("item"), value.alias("value"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "item")))
    out = ranked.join(groups.withColumnRenamed("g", "a"), "a").select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    result = stage(out.unionByName(terms), "divergence")
    unstage(*made)
    return result
