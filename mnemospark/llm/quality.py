"""Quality rules: counted properties of a text, and a calibrated classifier over hashed n-grams.

The classifier is a logistic regression over hashed words and character 3- and 4-grams, each block taken as its share of
the text. It is fitted on labelled rows (at most `sample` of them, those whose doc_id hashes lowest), three quarters for the
weights and one quarter for the calibration of its probabilities. Texts are scored whole, in Arrow batches, against a fixed
threshold.

Null text has no words and fails the word count. Rows with a null doc_id are scored but never used for fitting; labels that
are null or contradict each other for one doc_id are not used; of repeated rows of a labelled doc_id the least text is used for
fitting. With no labelled row of either kind there is no classifier
and the counted rules alone decide. Repeated rows are judged each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import NON_SPACE, NON_SPACE_AS_IS, Words, chunked, documents, mix, shingle_hashes, text_buffers, to_batch

#: Labelled rows used for fitting, at most; the fit then takes a fixed amount of memory and time.
SAMPLE = 3000
#: A text is kept if its probability of good quality reaches this.
THRESHOLD = 0.5
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
_BITS = 18
_PART = 250  # rows of the sample handled at once when fitting
#: Bytes of text whose features are held at once: about 200 bytes of memory for each.
TEXT_BYTES = 1 << 18
_GRAMS = (3, 4)


# ---------------------------------------------------------------- counted rules


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = Words(data, offsets, NON_SPACE_AS_IS)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    char = NON_SPACE_AS_IS.is_word & (np.arange(256) & 0xC0 != 0x80)  # one byte of each code point that isn't white space

    three = shingle_hashes(w.hash, 3)
    last = np.repeat(w.first[1:], w.count)[: len(three)]
    at = np.flatnonzero(np.arange(len(three)) + 3 <= last)
    with np.errstate(over="ignore"):
        keyed = mix(three[at] + w.document()[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, inverse, n = np.unique(keyed, return_inverse=True, return_counts=True)
    repeated = at[n[inverse] > 1]
    covered = np.zeros(len(w.start) + 2, np.int64)
    for k in range(3):
        covered[repeated + k] = 1
    total = np.concatenate([[0], np.cumsum(covered)])

    raw, dup = data.tobytes(), np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    return {"n_words": w.count, "word_chars": per_text(char[data]), "n_symbols": per_text(symbol[data]), "n_dup_lines": dup, "n_repeat_words": total[w.first[1:]] - total[w.first[:-1]]}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED_PERCENT * c["n_words"])


# ---------------------------------------------------------------- classifier


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the n + 1 offsets of the texts in them; bytes that are not UTF-8 become U+FFFD."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        begins = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        return points, begins[offsets]
    except UnicodeDecodeError:
        parts = [np.frombuffer(raw[a:b].decode(errors="replace").encode("utf-32-le"), "<u4") for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def hashed_features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (feature number of each element, n + 1 offsets of the texts in it): words, then each size of character n-grams.

    Characters are code points, and no n-gram reaches over the end of its text.
    """
    w = Words(data, offsets, NON_SPACE)
    top = np.uint64(64 - _BITS)
    blocks = [((w.hash >> top).astype(np.int64), w.first)]
    points, begins = code_points(data, offsets)
    wide, sizes = points.astype(np.uint64), np.diff(begins)
    for n in _GRAMS:
        m = max(0, len(points) - n + 1)
        h = np.full(m, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h + wide[k : k + m]) * np.uint64(0x9FB21C651E98DF25)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC6BC279692B5C323) >> top
        inside = np.arange(m) + n <= np.repeat(begins[1:], sizes)[:m]
        blocks.append((h[inside].astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(0, sizes - n + 1))])))
    return blocks


#: Weights are summed as whole multiples of 1 / _UNIT, so that a sum does not depend on the order or on other texts.
_UNIT = 1 << 32


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out, fixed = np.full(len(offsets) - 1, self.bias), np.round(self.weights.astype(np.float64) * _UNIT).astype(np.int64)
        for at, first in hashed_features(data, offsets):
            total = np.concatenate([[0], np.cumsum(fixed[at])])
            out += (total[first[1:]] - total[first[:-1]]) / (np.maximum(1, np.diff(first)) * float(_UNIT))
        return out

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.shift, -30, 30)))


Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # first element of each row, feature numbers, values, labels


def _margins(rows: Rows, weights: np.ndarray) -> np.ndarray:
    first, at, value, _ = rows
    return np.add.reduceat(weights[at] * value, first)


def _logistic(parts: list[Rows], rounds: int = 80, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Full-batch gradient steps scaled per feature (Adagrad), summed over parts so that little memory is needed at once."""
    weights, square, bias, bias_square = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-12), 0.0, 1e-12
    n = sum(len(y) for *_, y in parts)
    for _ in range(rounds):
        g, total = l2 * weights, 0.0
        for rows in parts:
            first, at, value, y = rows
            error = (1 / (1 + np.exp(-np.clip(_margins(rows, weights) + bias, -30, 30))) - y) / n
            g += np.bincount(at, np.repeat(error, np.diff(first, append=len(at))) * value, 1 << _BITS)
            total += error.sum()
        square += g * g
        weights -= 3.0 * g / np.sqrt(square)
        bias_square += total**2
        bias -= 0.5 * total / np.sqrt(bias_square)
    return weights, bias


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with Platt's smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = float(np.std(z)) or 1.0
    a, b = 1.0 / spread, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, v = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * z).sum() + 1e-3 * a * spread * spread, d.sum()])
        h = np.array([[(v * z * z).sum() + 1e-3 * spread * spread, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - np.clip(step[0] * spread, -1, 1) / spread, b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> Classifier | None:
    """Train on labelled documents; None if the sample does not hold both kinds."""
    known = labels.where(F.col(label_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label_id).cast("long").alias("doc_id"))
    known = known.agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    chosen = known.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = documents(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("text").alias("text")).select("h", "y", "text")  # at most `sample` rows
    schema = pa.schema([("h", pa.int64()), ("y", pa.float64()), ("at", pa.binary()), ("value", pa.binary())])

    def features(batches):
        for batch in chunked(batches, "text", TEXT_BYTES):
            blocks = hashed_features(*text_buffers(batch.column(2)))
            ats, values = [], []
            for i in range(batch.num_rows):
                parts = [np.unique(x[f[i] : f[i + 1]], return_counts=True) for x, f in blocks]
                at = np.concatenate([p[0] for p in parts])
                ats.append(at.astype("<i4").tobytes())
                values.append(np.concatenate([p[1] / max(1, p[1].sum()) for p in parts]).astype("<f4").tobytes())
            yield to_batch(schema, h=batch.column(0), y=batch.column(1).cast(pa.float64()), at=ats, value=values)

    table = rows.mapInArrow(features, "h long, y double, at binary, value binary").where("length(at) > 0").toArrow().sort_by("h")
    y = table["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False

    def part(index: np.ndarray) -> Rows:
        picked = table.take(pa.array(index))
        sizes = [len(x) // 4 for x in picked["at"].to_pylist()]
        at, value = (np.frombuffer(b"".join(picked[c].to_pylist()), kind) for c, kind in (("at", "<i4"), ("value", "<f4")))
        return np.cumsum([0, *sizes[:-1]]), at, value, picked["y"].to_numpy()

    train, check = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    parts, tests = ([part(index[i : i + _PART]) for i in range(0, len(index), _PART)] for index in (train, check))
    del table
    weights, bias = _logistic(parts)
    z = np.concatenate([_margins(rows, weights) for rows in tests]) + bias
    return Classifier(weights.astype(np.float32), bias, *_calibrate(z, np.concatenate([rows[3] for rows in tests])))


# ---------------------------------------------------------------- operators


def _send(docs: DataFrame, model: Classifier | None):
    return docs.sparkSession.sparkContext.broadcast(model)  # one float a hashed feature, 1 MB


def score_quality(docs: DataFrame, model: Classifier | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, probability, base_failed, kept) of every document row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("probability", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
    sent = _send(docs, model)

    def score(batches):
        for batch in chunked(batches, "text", TEXT_BYTES):
            text = text_buffers(batch.column(1))
            counts = text_counts(*text)
            failed = base_failed(counts)
            p = sent.value.probabilities(*text) if sent.value else np.ones(batch.num_rows)
            yield to_batch(schema, doc_id=batch.column(0), **counts, probability=p, base_failed=failed, kept=~failed & (p >= threshold))

    kinds = ", ".join(f"{n} long" for n in names)
    return documents(docs, id_col, text_col).mapInArrow(score, f"doc_id long, {kinds}, probability double, base_failed boolean, kept boolean")


def filter_quality(docs: DataFrame, model: Classifier | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that pass; nothing is shuffled, and only texts go to Python."""
    sent = _send(docs, model)

    @F.arrow_udf("boolean")
    def keep(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            kept = []
            for part in chunked([pa.RecordBatch.from_arrays([whole], ["text"])], "text", TEXT_BYTES):
                text = text_buffers(part.column(0))
                failed = base_failed(text_counts(*text))
                p = sent.value.probabilities(*text) if sent.value else np.ones(part.num_rows)
                kept.append(~failed & (p >= threshold))
            yield pa.array(np.concatenate(kept) if kept else np.zeros(0, bool))

    return docs.where(keep(text_col))
