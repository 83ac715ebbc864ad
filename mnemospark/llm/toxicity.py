"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are rates of a whole text: hits of a lexicon for each 100 words, as written and after undoing disguises
(`1d10t`, `i.d.i.o.t`, `i d i o t`, `id*ot`, `idiooot`), hits near a word of the second person, capitals, marks of exclamation and
question, other punctuation, and rates of the disguises themselves. The lexicon holds words and word beginnings of 4 to 8 bytes
that labelled texts of kind 1 have more often than others (likelihood ratio G^2 of their document counts; a strong and a weak
class), so it needs no language and no word list.

Labels are learned only from rows whose crc32(doc_id as text) modulo 4 is not HELD_OUT, and of these from at most SAMPLE rows, those whose
doc_id hashes lowest; exact copies among them count once. The trees see each of these texts with a lexicon made
from the other half of them, so that they learn what a lexicon is worth for new texts; a quarter of the rows is kept for calibration. Trees and isotonic regression
are Spark's own; texts are scored whole, in Arrow batches, and nothing is shuffled for it. Isotonic steps are flat, so a hundredth part
of the score is the trees' own probability, which orders texts within a step. doc_id, lang, source and labels are in no feature.

Null and empty texts have all rates 0 and a score like others. Rows with a null doc_id are scored, not held out, and never
learned from; labels that are null or contradict each other for one doc_id are not used; of repeated rows of a labelled doc_id the
least text is learned from; repeated rows get equal scores. Without labelled rows of both kinds the score is the share of kind 1
among them (0 without any). An empty table gives no rows; other columns are not read. A text longer than PART_BYTES is counted in
parts that end at white space (counts are sums; only nearness does not reach over a cut), so memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import Alphabet, Words, chunked, documents, mix, stage, text_buffers, to_batch, unstage

HELD_OUT, THRESHOLD = 2, 0.3
#: Labelled rows that are learned from, at most; learning then takes a fixed amount of memory and time.
SAMPLE = 8000
#: Lexicon entries, at most, the most telling ones.
LEXICON = 100_000
#: Least G^2 of a strong and of a weak entry, least number of texts of kind 1 with it, and how much more frequent it is in these.
STRONG, WEAK, LEAST_TEXTS, LEAST_ODDS = 20.0, 10.0, 3, 4.0
PREFIXES = range(4, 9)
NEAR = 5
PART_BYTES = 1 << 18
TREES, DEPTH, STEP = 40, 4, 0.2
OWN_SHARE = 0.01

LETTERS = Alphabet(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
# fixed values: words of the second person in English, German, French and Spanish, and signs that stand for letters
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes"
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

COUNTS = ("words", "strong", "weak", "shown", "second", "near", "capital_words", "letters", "capitals", "exclaim", "ask", "loud", "marks", "inside", "stretched", "spaced", "bytes")
FEATURES = ("words", "strong", "weak", "strong_n", "weak_n", "hidden", "hidden_n", "second", "near", "capital_words", "capitals", "exclaim", "ask", "loud", "marks", "inside", "stretched", "spaced")


# ---------------------------------------------------------------- words and disguises


def _table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


_MARKS = _table(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
_LOOK, _LOOK_AS = _table("".join(LOOK_ALIKE)), np.arange(256, dtype=np.uint8)
for _a, _b in LOOK_ALIKE.items():
    _LOOK_AS[ord(_a)] = ord(_b)
_BLANK, _GLUE, _ALWAYS = _table(" \t\n\x0b\x0c\r"), _table(".-_* "), _table("*_")


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by], false or zero beyond the ends."""
    out = np.zeros_like(x)
    if 0 < by < len(x):
        out[:-by] = x[by:]
    elif by < 0 and -by < len(x):
        out[-by:] = x[:by]
    return out


def undisguised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The texts with disguises undone, and flags of the bytes where there is one.

    A sign like a letter becomes it if a letter, or another sign before a letter, is beside it (`!` only if one follows); a separator between single letters, and `*`
    or `_` between any, goes; of a letter three or more times in a row one stays. Texts do not reach into each other.
    """
    low = LETTERS.becomes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = edge[:-1], edge[1:]
    letter = LETTERS.is_word[data]
    before = _shifted(letter, -1) & ~first
    after = _shifted(letter, 1) & ~last
    look = _LOOK[data]
    beside_look = look & ((_shifted(look & after, 1) & ~last) | (_shifted(look & before, -1) & ~first))
    became = look & (before | after | beside_look) & ~((_shifted(data, 1) == data) & ~last & ~after) & ~((_shifted(data, -1) == data) & ~first & ~after)
    became &= (data != ord("!")) | after
    out = np.where(became, _LOOK_AS[data], low)
    joined = letter | became
    j_before, j_after = _shifted(joined, -1) & ~first, _shifted(joined, 1) & ~last
    single_before = j_before & ~(_shifted(joined, -2) & ~_shifted(first, -1)) & (_shifted(data, -1) < 128)
    single_after = j_after & ~(_shifted(joined, 2) & ~_shifted(last, 1)) & (_shifted(data, 1) < 128)
    spaced = _GLUE[data] & ~became & single_before & single_after
    glued = _ALWAYS[data] & j_before & j_after
    same = joined & (_shifted(out, -1) == out) & j_before
    run = (same & _shifted(same, 1) & ~last) | (same & _shifted(same, -1) & ~first)
    begins = run & ~(_shifted(same, -1) & ~first)
    keep = ~(spaced | glued | run)
    inside = (look | glued | _table("#%&")[data]) & before & after
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets], {"inside": inside, "stretched": begins, "spaced": spaced}


def _keys(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, their keys): whole words, then beginnings of each length."""
    yield np.arange(len(w.start)), mix(w.hash ^ np.uint64(0xA5A5))
    size = w.end - w.start
    for k in PREFIXES:
        long = np.flatnonzero(size >= k)
        if len(long):
            with np.errstate(over="ignore"):
                yield long, mix((w.lanes(long, 0) & np.uint64((1 << 8 * k) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))


@dataclass
class Lexicon:
    """Keys in order, with class 2 (strong) or 1 (weak) each."""

    keys: np.ndarray
    kinds: np.ndarray

    def __post_init__(self):
        self.may_be = np.zeros(1 << 20, bool)
        self.may_be[self.keys >> np.uint64(44)] = True

    def kinds_of(self, w: Words) -> np.ndarray:
        """The class of each word, the highest of its entries; 0 for none."""
        out = np.zeros(len(w.start), np.int8)
        for which, keys in _keys(w):
            some = np.flatnonzero(self.may_be[keys >> np.uint64(44)])
            if len(some):
                at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
                hit = self.keys[at] == keys[some]
                np.maximum.at(out, which[some[hit]], self.kinds[at[hit]])
        return out


def _g2(a: np.ndarray, b: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """Likelihood ratio of an entry that a of the positive and b of the negative texts have; 0 if it is not much more frequent in positive ones."""
    a, b = a.astype(float), b.astype(float)
    share = (a + b) / max(1, positives + negatives)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    g = part(a, share * positives) + part(b, share * negatives) + part(positives - a, (1 - share) * positives) + part(negatives - b, (1 - share) * negatives)
    return np.where((a >= LEAST_TEXTS) & (a * max(1, negatives) > LEAST_ODDS * b * max(1, positives)), 2 * g, 0.0)


def make_lexicon(keys: np.ndarray, a: np.ndarray, b: np.ndarray, positives: int, negatives: int) -> Lexicon:
    """keys must be in order."""
    g = _g2(a, b, positives, negatives)
    taken = g >= WEAK
    if not taken.any():
        return Lexicon(np.zeros(1, np.uint64), np.zeros(1, np.int8))
    return Lexicon(keys[taken], np.where(g[taken] >= STRONG, 2, 1).astype(np.int8))


# ---------------------------------------------------------------- features


_second = np.zeros(0, np.uint64)


def _second_person() -> np.ndarray:
    global _second
    if not len(_second):
        words = SECOND_PERSON.encode().split()
        _second = np.sort(Words(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in words])]), LETTERS).hash)
    return _second


def text_counts(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """COUNTS of each text, one row a text; counts of parts of a text add up to its own."""
    w = Words(data, offsets, LETTERS)
    kinds = lexicon.kinds_of(w)
    plain, plain_offsets, disguise = undisguised(data, offsets)
    shown = Words(plain, plain_offsets, LETTERS)
    shown_strong = lexicon.kinds_of(shown) == 2

    def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[at[1:]] - total[at[:-1]]

    words, letters = (lambda flags: sums(flags, w.first)), (lambda flags: sums(flags, offsets))
    known = _second_person()
    second = known[np.minimum(np.searchsorted(known, w.hash), len(known) - 1)] == w.hash
    so_far, place = np.concatenate([[0], np.cumsum(second)]), np.arange(len(w.start))
    begin, end = np.repeat(w.first[:-1], w.count), np.repeat(w.first[1:], w.count)
    near = so_far[np.minimum(place + NEAR + 1, end)] > so_far[np.maximum(place - NEAR, begin)]
    capital = (data >= 65) & (data <= 90)
    of_word = np.concatenate([[0], np.cumsum(capital)])
    size = w.end - w.start
    shout = _table("!?")[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    found = {
        "words": w.count, "strong": words(kinds == 2), "weak": words(kinds == 1), "shown": sums(shown_strong, shown.first), "second": words(second), "near": words((kinds > 0) & near),
        "capital_words": words((size > 1) & (of_word[w.end] - of_word[w.start] == size)), "letters": letters(LETTERS.is_word[data]), "capitals": letters(capital),
        "exclaim": letters(data == 33), "ask": letters(data == 63), "loud": letters(shout & _shifted(shout, -1) & ~edge), "marks": letters(_MARKS[data]),
        **{k: letters(v) for k, v in disguise.items()}, "bytes": np.diff(offsets),
    }
    return np.stack([found[c] for c in COUNTS], axis=1).astype(np.int64)


def _cuts(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Parts of one long text: each ends behind white space if there is some, else at a code point's begin."""
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + most)
        if end < len(data):
            blank = np.flatnonzero(_BLANK[data[begin:end]])
            lead = np.flatnonzero(data[begin + 1 : end + 1] & 0xC0 != 0x80)
            end = begin + int(blank[-1]) + 1 if len(blank) else begin + 1 + int(lead[-1]) if len(lead) else end
        yield begin, end
        begin = end


def features_of(batch: pa.RecordBatch, at: int, lexicon: Lexicon, most: int = PART_BYTES) -> np.ndarray:
    """FEATURES of the texts in column `at`, one row a text."""
    data, offsets = text_buffers(batch.column(at))
    if batch.num_rows == 1 and len(data) > most:
        c = sum(text_counts(data[a:b], np.array([0, b - a]), lexicon) for a, b in _cuts(data, most))
    else:
        c = text_counts(data, offsets, lexicon)
    n = dict(zip(COUNTS, c.T.astype(float), strict=True))
    words, letters, size = (100 / np.maximum(1, n[k]) for k in ("words", "letters", "bytes"))
    hidden = np.maximum(0, n["shown"] - n["strong"])
    n["strong"] += hidden  # a hit is a hit, disguised or not: trees that have seen no disguises find them too
    found = {
        "words": np.log1p(n["words"]), "strong_n": np.log1p(n["strong"]), "weak_n": np.log1p(n["weak"]), "hidden": hidden * words, "hidden_n": np.log1p(hidden),
        "near": n["near"] / np.maximum(1, n["strong"] + n["weak"]), "capitals": n["capitals"] * letters,
        **{k: n[k] * words for k in ("strong", "weak", "second", "capital_words", "inside", "stretched", "spaced")}, **{k: n[k] * size for k in ("exclaim", "ask", "loud", "marks")},
    }
    return np.stack([found[f] for f in FEATURES], axis=1)


def _as_lists(features: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, features.size + 1, features.shape[1]), pa.int32()), pa.array(features.ravel()))


# ---------------------------------------------------------------- learning


@dataclass
class Model:
    """lexicon and trees with calibration; without trees `base` is everyone's score."""

    base: float
    lexicon: Lexicon | None = None
    trees: PipelineModel | None = None


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str, text_col: str, label_id: str) -> DataFrame:
    """(h, y, text) of at most `sample` labelled rows that may be learned from; exact copies with one label count once."""
    known = labels.where(F.col(label_id).isNotNull() & F.col(label).isNotNull()).select(F.col(label_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2 and y in (0, 1)")
    chosen = known.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = documents(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("text").alias("text"))  # at most `sample` rows
    return rows.groupBy("y", F.sha2("text", 256).alias("copy")).agg(F.min("h").alias("h"), F.min("text").alias("text")).select("h", "y", "text")


def learn_lexicons(rows: DataFrame, part_bytes: int = PART_BYTES) -> tuple[Lexicon, Lexicon, Lexicon]:
    """Lexicons from all rows, from those with an even and from those with an odd h."""
    schema = pa.schema([("key", pa.int64()), *((f"c{i}", pa.int64()) for i in range(4))])

    def count(batches):
        held, size = [], 0

        def added():
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held])
            found, back = np.unique(keys, return_inverse=True)
            return found, np.stack([np.bincount(back, n[:, i], len(found)).astype(np.int64) for i in range(4)], axis=1)  # sums of 1, exact

        def rows_of(keys, n):
            return to_batch(schema, key=keys.view(np.int64), **{f"c{i}": n[:, i] for i in range(4)})

        for batch in chunked(batches, "text", part_bytes):
            data, offsets = text_buffers(batch.column(2))
            kind = (batch.column(0).to_numpy() & 1) * 2 + batch.column(1).to_numpy()
            long = batch.num_rows == 1 and len(data) > part_bytes
            seen = [np.zeros(0, np.uint64)] * batch.num_rows
            for a, b in _cuts(data, part_bytes) if long else [(0, len(data))]:
                w = Words(data[a:b], np.array([0, b - a]) if long else offsets, LETTERS)
                text = w.document()
                which, keys = (np.concatenate(x) for x in zip(*_keys(w), strict=True))
                order = np.argsort(text[which], kind="stable")
                bounds = np.searchsorted(text[which][order], np.arange(batch.num_rows + 1))
                for i in range(batch.num_rows):
                    seen[i] = np.union1d(seen[i], keys[order[bounds[i] : bounds[i + 1]]])
            for keys, k in zip(seen, kind.tolist(), strict=True):
                n = np.zeros((len(keys), 4), np.int32)
                n[:, k] = 1
                held.append((keys, n))
                size += len(keys)
            if size > 500_000:
                held = [added()]
                size = len(held[0][0])
                if size > 250_000:
                    yield rows_of(*held[0])
                    held, size = [], 0
        if held:
            yield rows_of(*added())

    totals = {(r.p, r.y): r.n for r in rows.groupBy((F.col("h").bitwiseAND(1)).alias("p"), "y").agg(F.count("*").alias("n")).collect()}  # four rows
    of = lambda p, y: totals.get((p, y), 0)
    positives, negatives = of(0, 1) + of(1, 1), of(0, 0) + of(1, 0)
    counted = rows.select("h", "y", "text").mapInArrow(count, "key long, c0 long, c1 long, c2 long, c3 long").groupBy("key").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(4)))
    more = (F.col("c1") + F.col("c3") >= LEAST_TEXTS) & ((F.col("c1") + F.col("c3")) * max(1, negatives) > (F.col("c0") + F.col("c2")) * (LEAST_ODDS * max(1, positives)))
    table = counted.where(more).orderBy(F.desc(F.col("c1") + F.col("c3")), "c0", "c2", "key").limit(LEXICON).toArrow()  # at most LEXICON rows of 40 bytes
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, c = keys[order], [table[f"c{i}"].to_numpy()[order] for i in range(4)]
    return (
        make_lexicon(keys, c[1] + c[3], c[0] + c[2], positives, negatives),
        make_lexicon(keys, c[1], c[0], of(0, 1), of(0, 0)), make_lexicon(keys, c[3], c[2], of(1, 1), of(1, 0)),
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", part_bytes: int = PART_BYTES) -> Model:
    """Lexicon, trees and calibration from labelled rows that are not held out."""
    rows = stage(training_rows(docs, labels, label, sample, id_col, text_col, label_id), "labelled")
    kinds = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(kinds) < 2:
        unstage(rows)
        return Model(float(max(kinds, default=0)))
    whole, even, odd = learn_lexicons(rows, part_bytes)
    sent = docs.sparkSession.sparkContext.broadcast((odd, even))  # for rows with an even h the lexicon of the others, and the reverse
    schema = pa.schema([("h", pa.int64()), ("y", pa.float64()), ("x", pa.list_(pa.float64()))])

    def features(batches):
        for batch in chunked(batches, "text", part_bytes):
            half = batch.column(0).to_numpy() & 1
            both = [features_of(batch, 2, lexicon, part_bytes) for lexicon in sent.value]
            yield to_batch(schema, h=batch.column(0), y=batch.column(1).cast(pa.float64()), x=_as_lists(np.where(half[:, None] == 0, *both)))

    # few rows of few numbers: one partition in one order makes the trees the same under any partitioning of the input
    made = stage(rows.mapInArrow(features, "h long, y double, x array<double>").repartition(1).sortWithinPartitions("h", "y", "x"), "features")
    data = made.select(array_to_vector("x").alias("features"), F.col("y").alias("label"), (F.pmod(F.shiftright("h", 1), F.lit(4)) == 3).alias("check"))
    classes = {(r.check, r.label) for r in data.select("check", "label").distinct().collect()}  # at most four rows
    train, check = (data.where("not check"), data.where("check")) if len(classes) == 4 else (data, data)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, maxBins=64, seed=11).fit(train)
    by_tree = trees.transform(check).select("label", vector_to_array("probability")[1].alias("own"))
    steps = IsotonicRegression(featuresCol="own", labelCol="label").fit(by_tree)
    unstage(rows, made)
    return Model(kinds[1] / sum(kinds.values()), whole, PipelineModel([trees, steps]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row."""
    rows = documents(docs, id_col, text_col)
    if model.trees is None:
        scored = rows.select("doc_id", F.lit(model.base).alias("score"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model.lexicon)  # at most LEXICON entries
        schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

        def features(batches):
            for batch in chunked(batches, "text", part_bytes):
                yield to_batch(schema, doc_id=batch.column(0), x=_as_lists(features_of(batch, 1, sent.value, part_bytes)))

        trees, steps = model.trees.stages
        by_tree = trees.transform(rows.mapInArrow(features, "doc_id long, x array<double>").select("doc_id", array_to_vector("x").alias("features")))
        by_tree = steps.transform(by_tree.select("doc_id", vector_to_array("probability")[1].alias("own")))
        own = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("own")))
        scored = by_tree.select("doc_id", ((1 - OWN_SHARE) * F.col("prediction") + OWN_SHARE * own).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
