"""Cross-entropy difference of two matched n-gram models (in the manner of Moore and Lewis).

Both models are interpolated bigram models over one shared vocabulary of hashed words: the same ids, order and smoothing. The
background model counts all documents; the target model counts all documents labelled as wanted. A document's score is
its mean loss per word under the target model less that under the background model; lower means more like the target. A
document's own words are taken out of the counts it is scored with, so what a model has seen of it does not help it.

Counts: every task keeps one array a model and sends it as compressed blocks; blocks are added block by block, so what is
gathered grows with the number of tasks and no task sees more than its block of the ids. The models have a fixed size,
`2 ** bits` numbers a table, which bounds what is broadcast; more bits keep more of a larger corpus apart.

Null, empty and wordless texts have no words, no loss and a null score. Labels that are null or contradict each other for
a doc_id do not count as wanted. Without target words the target model is uniform and scores stay
defined. Repeated rows count and are scored each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import NON_SPACE, Words, chunked, documents, mix, text_buffers, to_batch

BITS = 22
#: Weights of the bigram, the unigram and the uniform estimate, the same in both models: a word that neither model has seen
#: costs the same in both.
WEIGHTS = (0.6, 0.3, 0.1)
_BLOCK = 1 << 16


def _ids(text: tuple[np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """Table places of every word and of every word with the one before it (the text's start before the first)."""
    w = Words(*text, NON_SPACE)
    before = np.empty_like(w.hash)
    if len(before):
        before[1:] = w.hash[:-1]
        before[w.first[:-1][w.count > 0]] = np.uint64(0x5BD1E995)
    with np.errstate(over="ignore"):
        pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + w.hash)
    top = np.uint64(64 - bits)
    return (w.hash >> top).astype(np.int64), (pair >> top).astype(np.int64), w


def _add_up(source: DataFrame, bits: int) -> dict[str, np.ndarray]:
    """Unigram and bigram counts of background (all) and target (wanted) texts."""
    names = ("background-1", "background-2", "target-1", "target-2")
    schema = pa.schema([("name", pa.string()), ("block", pa.int32()), ("counts", pa.binary())])

    def pack(table: np.ndarray) -> bytes:
        return zlib.compress(table.astype("<i8").tobytes(), 1)

    def count(batches):
        tables = {n: np.zeros(1 << bits, np.int32) for n in names}
        texts = {"background": 0, "target": 0}
        for batch in chunked(batches):
            one, two, w = _ids(text_buffers(batch.column(0)), bits)
            is_wanted = np.array(batch.column(1).to_pylist(), bool)
            wanted = np.repeat(is_wanted, w.count)
            texts["background"] += int((w.count > 0).sum())
            texts["target"] += int((is_wanted & (w.count > 0)).sum())
            for kind, pick in (("background", slice(None)), ("target", wanted)):
                for n, at in ((1, one[pick]), (2, two[pick])):
                    places, times = np.unique(at, return_counts=True)
                    tables[f"{kind}-{n}"][places] += times.astype(np.int32)
        for kind, n in texts.items():
            yield to_batch(schema, name=[f"{kind}-0"], block=[0], counts=[pack(np.array([n]))])
        for name, table in tables.items():
            for b in range(0, len(table), _BLOCK):
                part = table[b : b + _BLOCK]
                if part.any():
                    yield to_batch(schema, name=[name], block=[b // _BLOCK], counts=[pack(part)])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(2).to_pylist():
                part = np.frombuffer(zlib.decompress(x), "<i8")
                total = part.copy() if total is None else total + part
        yield to_batch(schema, name=[key[0].as_py()], block=[key[1].as_py()], counts=[pack(total)])

    kinds = "name string, block int, counts binary"
    parts = source.mapInArrow(count, kinds).groupBy("name", "block").applyInArrow(add, kinds)
    out = {n: np.zeros(1 << bits, np.int64) for n in names} | {"background-0": np.zeros(1, np.int64), "target-0": np.zeros(1, np.int64)}
    for r in parts.toLocalIterator():  # at most 4 * 2 ** bits numbers in all
        out[r["name"]][r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(zlib.decompress(bytes(r.counts)), "<i8")
    return out


class Models:
    """Losses of words given the word before, under both models."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.counts = {n: x.astype(np.float32) for n, x in counts.items() if not n.endswith("-0")}
        self.texts = {k: float(counts[f"{k}-0"][0]) for k in ("background", "target")}
        self.total = {k: float(counts[f"{k}-1"].sum()) for k in ("background", "target")}
        self.vocabulary = int(np.count_nonzero(counts["background-1"])) + 1

    def loss(self, kind: str, one: np.ndarray, two: np.ndarray, begins: np.ndarray, own: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Loss of each word in nats. begins: whether it is a text's first; own: its text's own counts of the word, of
        the pair, and all its words (zeros if the model has not seen the text)."""
        own_one, own_two, own_all = own
        count = np.maximum(0, self.counts[f"{kind}-1"][one] - own_one)
        context = np.empty_like(count)
        context[1:] = count[:-1]
        context[begins] = np.maximum(0, self.texts[kind] - (own_all[begins] > 0))
        alone = count / np.maximum(1, self.total[kind] - own_all)
        pair = np.where(context > 0, np.minimum(1.0, np.maximum(0, self.counts[f"{kind}-2"][two] - own_two) / np.maximum(1, context)), alone)
        return -np.log(WEIGHTS[0] * pair + WEIGHTS[1] * alone + WEIGHTS[2] / self.vocabulary)


def _wanted(labels: DataFrame, label: str) -> DataFrame:
    """The doc_ids whose labels are all 1."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    return known.where("a = 1 and b = 1").select("doc_id", F.lit(True).alias("wanted"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> Models:
    """Count both models over all documents; the wanted ones have label 1. The labels may be of any number, so they are
    merged with the documents and never broadcast."""
    marked = documents(docs, id_col, text_col).join(_wanted(labels, label).hint("merge"), "doc_id", "left")
    return Models(_add_up(marked.select("text", F.coalesce("wanted", F.lit(False)).alias("wanted")), bits))


def _own_counts(w: Words, ids: np.ndarray, bits: int) -> np.ndarray:
    """For each word, how often its id occurs in its own text."""
    _, inverse, n = np.unique((w.document() << bits) | ids, return_inverse=True, return_counts=True)
    return n[inverse].astype(np.float64)


def score(docs: DataFrame, models: Models, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, difference): means per word, rounded to six places.

    Texts stay where they are: each gets its target loss with and without its own counts, and the short rows then meet the
    labels, which say which of the two holds.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)  # four tables of 2 ** bits float32
    names = ("target_seen", "target_unseen", "background_loss")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), *((n, pa.float64()) for n in names)])

    def rows(batches):
        m = sent.value
        for batch in chunked(batches):
            one, two, w = _ids(text_buffers(batch.column(1)), bits)
            begins = w.first[:-1][w.count > 0]
            own = _own_counts(w, one, bits), _own_counts(w, two, bits), np.repeat(w.count, w.count).astype(np.float64)
            none, means = w.count == 0, {}
            for name, kind, seen in (("target_seen", "target", 1), ("target_unseen", "target", 0), ("background_loss", "background", 1)):
                total = np.concatenate([[0.0], np.cumsum(m.loss(kind, one, two, begins, tuple(x * seen for x in own)))])
                means[name] = pa.array(np.round((total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(1, w.count), 6), mask=none)
            yield to_batch(schema, doc_id=batch.column(0), n_words=w.count, **means)

    scored = documents(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_words long, target_seen double, target_unseen double, background_loss double")
    target = F.when(F.col("wanted"), F.col("target_seen")).otherwise(F.col("target_unseen"))
    out = scored.join(_wanted(labels, label), "doc_id", "left").select("doc_id", "n_words", target.alias("target_loss"), "background_loss")
    return out.withColumn("difference", F.round(F.col("target_loss") - F.col("background_loss"), 6))
