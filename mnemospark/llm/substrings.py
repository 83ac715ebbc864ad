"""Near-duplicate passages by compact windows.

A passage is a run of words, seen as the sequence of its grams (runs of GRAM words). The Cartesian tree of a text's gram hashes groups
all its subsequences of at least the wanted length by their min-hash: a node stands for every subsequence around its centre that has
this minimum. Texts with a subsequence in common have nodes with the same minimum.

A passage of 50 words with one edit, the most that a similarity of 0.8 allows there, holds an unedited run of 24 words, and passages
with more edits hold longer ones (least_run; where shingles repeat inside a passage, its set is smaller, and this need not hold). So the
nodes are those of 17 grams or more, and two texts that share such a run have one with the same centre in it. Three parts of four of the
run's other words stand beside the centre's gram, in one of four divisions between both sides: windows meet by these runs of 20 words.

Each window meets the least document of its group. A pair of documents is verified once, on the words of both texts and from all their
common runs, the longest first: matching runs are extended over small edits, and must have the least number of words and the wanted
similarity of shingle sets. Verification also gives signs: shingles near the common runs that the first document has not, joints of runs that are
farther apart in it, and long runs of repeated words. If a passage with a third document is not found with the first one, the two share a sign.
Documents with a sign that lies in none of their passages meet the least one with the same sign and, if that is a new pair, the SEVERAL before
them too; of signs that more documents share, the least one becomes the first document of a next round, until no pair is new. So a document that
shares a sign with more than SEVERAL + 1 earlier ones is not compared with each of them, as that would grow with the square of a group of copies.

Only the least document of texts with the same bytes is compared. Texts of documents without a candidate are kept out of the joins by a bitmap of
fixed size over hashed document ids.

Null, empty and short texts have no windows. Rows with a null doc_id are left out. Repeated rows of one doc_id are one
document. Repeats inside one document are not reported. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import NON_SPACE, Words, among, chunked, documents, mix, shingle_hashes, small_arrow_batches, stage, text_buffers, to_batch, unstage

MIN_WORDS, SHINGLE, PERCENT, GRAM = 50, 5, 80, 8
#: Parts of the words of a common run beside its gram; three of them, before and after it in some division, name a group of windows.
PARTS = 4
#: So many documents before it, and the first, a document meets of those that share a sign with it.
SEVERAL = 3
#: Bytes of text of candidate pairs that are verified at once.
PAIR_BYTES = 1 << 18
_SEED = np.random.default_rng(577_215).integers(1, 1 << 63, dtype=np.uint64)


def compact_windows(values: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), inclusive, of every Cartesian-tree node that spans at least `least` values, for many texts at once.

    values: 64-bit hashes of all texts in a row; ends: for each value, up to where (exclusive) its text has values. left and right are given as far
    as they are less than `least` from the centre. A node that spans so many values is the minimum of some `least` values in a
    row, and every such minimum is the centre of such a node; so the nodes are the runs of one centre among the minima of all
    runs of `least` values, which come from running minima of blocks in both directions.
    """
    n = len(values)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(1, (n - 1).bit_length()))
    packed = np.full(-(-n // least) * least, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = values >> bits << bits | np.arange(n, dtype=np.uint64)  # the first of equal minima
    blocks = packed.reshape(-1, least)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.flatnonzero(np.arange(n - least + 1) + least <= ends[: n - least + 1])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    centre = (np.minimum(back[start], ahead[start + least - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
    last = np.concatenate([begin[1:], [len(start)]]) - 1
    return start[begin], centre[begin], start[last] + least - 1


def least_run(min_words: int, shingle: int, percent: int) -> int:
    """Words in a row, at least, that a passage of min_words or more has in common with its like: one edit leaves the longer half of the
    shortest passage that may hold one, and with more edits passages are so much longer that their runs are, too."""
    edited = -(-shingle * (100 + percent) // max(1, 100 - percent)) + shingle - 1
    return max(1, (max(min_words, edited) - 1) // 2)


def windows(docs: DataFrame, min_words: int, gram: int, run: int) -> DataFrame:
    """(key, doc_id, near, far) of all compact windows of all documents, alike ones of a document once, and (null, doc_id, number of words, 0)
    of each of them.

    key is the least gram. near and far pack 32 bits each of the PARTS runs of words that hold it with three of PARTS parts of the other words of
    a run, divided between both sides (0: the text ends before). Two texts that share `run` words in a row have one of these in common.
    """
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("near", pa.int64()), ("far", pa.int64())])
    least, part = run - gram + 1, (run - gram) // PARTS
    wide = gram + (PARTS - 1) * part

    def cut(batches):
        for batch in chunked(batches):
            w = Words(*text_buffers(batch.column(1)), NON_SPACE)
            ids, long = batch.column(0).to_numpy(), np.flatnonzero(w.count >= min_words)
            if not len(long):
                continue
            yield to_batch(schema, key=pa.nulls(len(long), pa.int64()), doc_id=ids[long], near=w.count[long], far=np.zeros(len(long), np.int64))
            grams, around = (shingle_hashes(w.hash, k) for k in (gram, wide))
            ends = np.repeat(w.first[1:] - gram + 1, w.count)[: len(grams)]
            x = mix(grams ^ _SEED)
            _, centre, _ = compact_windows(x, ends, least)
            text = np.searchsorted(w.first, centre, side="right") - 1
            some = w.count[text] >= min_words
            centre, text = centre[some], text[some]
            sides = []
            for i in range(PARTS):
                begin = centre - i * part
                inside = (begin >= w.first[text]) & (begin + wide <= w.first[text + 1])
                sides.append(np.where(inside, around[np.clip(begin, 0, len(around) - 1)] >> np.uint64(32) | np.uint64(1), 0).astype(np.uint64))
            key, near, far = x[centre], sides[0] << np.uint64(32) | sides[1], sides[2] << np.uint64(32) | sides[3]
            with np.errstate(over="ignore"):
                _, once = np.unique(mix(mix(mix(key + text.astype(np.uint64)) ^ near) ^ far), return_index=True)
            yield to_batch(schema, key=key[once].view(np.int64), doc_id=ids[text[once]], near=near[once].view(np.int64), far=far[once].view(np.int64))

    return docs.mapInArrow(cut, "key long, doc_id long, near long, far long")


def _met(made: DataFrame) -> DataFrame:
    """From windows: (first, doc_id, null), documents with the least document of each of their windows' groups, and (null, doc_id, n) with their sizes."""
    schema = pa.schema([("first", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32())])
    half = np.uint64(32)

    def meet(batches):
        last, known, leads = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)  # groups of the last key, and their leads
        for batch in batches:
            sizes = batch.slice(0, batch.column(0).null_count)  # nulls come first
            if sizes.num_rows:
                yield to_batch(schema, first=sizes.column(0), doc_id=sizes.column(1), n=sizes.column(2))
            batch = batch.slice(sizes.num_rows)
            if not batch.num_rows:
                continue
            key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            near, far = (batch.column(i).to_numpy().view(np.uint64) for i in (2, 3))
            if key[0] != last:
                known, leads = known[:0], leads[:0]
            sides = np.stack([near >> half, near << half >> half, far >> half, far << half >> half], axis=1)
            names = mix(key.view(np.uint64)[:, None] ^ mix(sides | np.arange(PARTS, dtype=np.uint64) << half))
            there = sides.ravel() > 0
            name = np.concatenate([known, names.ravel()[there]])  # in the order of documents in each group
            docs = np.concatenate([leads, np.repeat(doc, PARTS)[there]])
            last = key[-1]
            same = np.concatenate([np.full(len(known), key[0] == last), np.repeat(key == last, PARTS)[there]])
            order = np.argsort(name, kind="stable")
            name, docs, same = name[order], docs[order], same[order]
            begins = np.ones(len(name), bool)
            begins[1:] = name[1:] != name[:-1]
            lead = docs[begins][np.cumsum(begins) - 1]
            pair = lead != docs
            known, leads = name[begins & same], docs[begins & same]
            if pair.any():
                first, late = lead[pair], docs[pair]
                order = np.lexsort((late, first))
                first, late = first[order], late[order]
                once = np.ones(len(first), bool)
                once[1:] = (first[1:] != first[:-1]) | (late[1:] != late[:-1])
                first, late = first[once], late[once]
                yield to_batch(schema, first=first, doc_id=late, n=pa.nulls(len(first), pa.int32()))

    return made.repartition(F.coalesce("key", "doc_id")).sortWithinPartitions("key", "doc_id").mapInArrow(meet, "first long, doc_id long, n int")


def _copies(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, first) of documents that are a copy of an earlier one, and (doc_id) of those with no other text."""
    named = stage(source.select("doc_id", F.sha2("text", 256).alias("id")).distinct(), "texts")
    classes = stage(named.groupBy("id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "classes")
    copies = stage(named.join(classes, "id").where("doc_id <> first").select("doc_id", "first"), "copies")
    several = named.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1")
    dropped = stage(copies.select("doc_id").distinct().join(several, "doc_id", "left_anti"), "dropped")
    unstage(named, classes)
    return copies, dropped


def _bits_shared(s: np.ndarray, t: np.ndarray, most: int) -> np.ndarray:
    """How many bits are set in both of two sketches (the last axis), each of which has at most `most` set."""
    counts = np.bitwise_count(s & t)
    if most > 255 or counts.shape[-1] % 8:
        return counts.sum(axis=-1, dtype=np.int64)
    lanes = counts.view(np.uint64)  # eight sums in one number, none of which leaves its byte
    total = lanes[..., 0].copy()
    for i in range(1, lanes.shape[-1]):
        total += lanes[..., i]
    with np.errstate(over="ignore"):
        return total * np.uint64(0x0101010101010101) >> np.uint64(56)


# ---------------------------------------------------------------- verification


def _agree(x: np.ndarray, y: np.ndarray, a: int, b: int, step: int) -> int:
    """How far x and y agree forwards from (a, b) (step 1) or backwards from before it (step -1)."""
    far, size, most = 0, 32, min(len(x) - a, len(y) - b) if step > 0 else min(a, b)
    while far < most:
        n = min(size, most - far)
        if step > 0:
            same = x[a + far : a + far + n] == y[b + far : b + far + n]
        else:
            same = x[a - far - n : a - far][::-1] == y[b - far - n : b - far][::-1]
        k = int(same.argmin())
        if not same[k]:
            return far + k
        far, size = far + n, 256
    return far


def _span(x: np.ndarray, y: np.ndarray, a: int, b: int) -> tuple[int, int, int, int]:
    """The run of equal words around (a, b)."""
    back, ahead = _agree(x, y, a, b, -1), _agree(x, y, a, b, 1)
    return a - back, a + ahead, b - back, b + ahead


def _agreements(u: np.ndarray, v: np.ndarray, many: bool) -> list[tuple[int, int]]:
    """Places (i, j) of equal values in two arrays, nearest first, one for each shift i - j; with many, a value's first place counts in both."""
    if many:
        _, i, j = np.intersect1d(u, v, return_indices=True)
        found = zip(i.tolist(), j.tolist(), strict=True)
    else:
        last = dict(zip(v[::-1].tolist(), range(len(v) - 1, -1, -1), strict=True))
        found = ((i, last[x]) for i, x in enumerate(u.tolist()) if x in last)
    nearest: dict[int, tuple[int, int]] = {}
    for i, j in sorted(found, key=sum):
        nearest.setdefault(i - j, (i, j))
    return list(nearest.values())


def _past_edit(sx: np.ndarray, sy: np.ndarray, runs: tuple[np.ndarray, ...], a: int, b: int, k: int, step: int, gap: int, need: int, percent: int) -> Iterator[tuple[int, int]]:
    """Places after (step 1) or before (step -1) an edit at (a, b) of at most gap words a side where k words agree again: the
    begin of the common shingle, or its end. Replaced words and one or two more or fewer come first, then the nearest.

    Places are left out whose run of equal words is surely too short: of n words, i and j behind the edit, (100 - percent) * n - percent *
    (i + j) must be `need`, and n is bounded by the runs of shingles that are anywhere in the other text.
    """
    if step > 0:
        u, v = sx[a : a + gap + 1], sy[b : b + gap + 1]
        of_u, of_v = runs[0][a : a + gap + 1], runs[1][b : b + gap + 1]
    else:
        low, high = (max(0, a - k - gap), max(0, b - k - gap)), (max(0, a - k + 1), max(0, b - k + 1))
        u, v = sx[low[0] : high[0]][::-1], sy[low[1] : high[1]][::-1]
        of_u, of_v = runs[2][low[0] : high[0]][::-1], runs[3][low[1] : high[1]][::-1]
    most = lambda of: np.flatnonzero((of > 0) & ((100 - percent) * (of + (k - 1)) - percent * np.arange(len(of)) >= need))
    some_u = most(of_u)
    some_v = most(of_v) if len(some_u) else some_u
    if not len(some_v):
        return
    whole, last = (len(u), len(v)), max(int(some_u[-1]), int(some_v[-1]))
    u, v = u[: int(some_u[-1]) + 1], v[: int(some_v[-1]) + 1]  # no place behind these can do
    enough = lambda i, j: (100 - percent) * (int(min(of_u[i], of_v[j])) + k - 1) - percent * (i + j) >= need
    tried = set()
    for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2)):
        n = min(32, len(u) - i, len(v) - j)
        if n > 0:
            same = u[i : i + n] == v[j : j + n]
            first = int(same.argmax())
            if same[first] and enough(at := (i + first), to := (j + first)):
                tried.add((at, to))
                yield a + step * at, b + step * to
    near = 16
    while True:
        near = min(near, gap)
        many = min(near + 1, whole[0]) + min(near + 1, whole[1]) > 256
        for i, j in _agreements(u[: near + 1], v[: near + 1], many):
            if (i, j) not in tried and enough(i, j):
                tried.add((i, j))
                yield a + step * i, b + step * j
        if near >= min(gap, last):
            return
        near *= 8


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _similarity(s: np.ndarray, t: np.ndarray) -> float:
    s, t = _distinct(s), _distinct(t)
    both = np.sort(np.concatenate([s, t]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / max(1, len(s) + len(t) - common)


def _also_in(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many of the first shingles of s are also in t, for every number of them from 0 on."""
    return np.concatenate([[0], np.cumsum(np.isin(s, t))])


def _shared_runs(shared_x: np.ndarray, shared_y: np.ndarray) -> tuple[np.ndarray, ...]:
    """How many shingles in a row from each one on are in the other text, in x and in y, and how many up to each one; from _also_in of both."""
    ahead, back = [], []
    for shared in (shared_x, shared_y):
        n = len(shared) - 1
        place, found = np.arange(n), np.diff(shared) > 0
        ahead.append(np.minimum.accumulate(np.where(found, n, place)[::-1])[::-1] - place)
        back.append(place - np.maximum.accumulate(np.where(found, -1, place)))
    return *ahead, *back


def common_passage(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, a: int, b: int, min_words: int, k: int, percent: int, shared: tuple[np.ndarray, tuple[np.ndarray, ...]] | None = None) -> tuple[int, int, int, int, float] | None:
    """The passage around the shared shingle at (a, b): places in x and y, end exclusive, and its similarity; None if too short.

    x and y are word hashes, sx and sy their shingles, shared is _also_in(sx, sy) and the _shared_runs of both. The run of equal words grows over one edit after another at either
    end, as long as the shingles of the runs are the wanted part of all; the result is measured on its sets.
    """
    if max(a - len(sx), b - len(sy)) >= 0 or sx[a] != sy[b]:
        return None
    if shared is None:
        shared_x = _also_in(sx, sy)
        shared = shared_x, _shared_runs(shared_x, _also_in(sy, sx))
    shared_x, runs = shared
    exact = a0, a1, b0, b1 = _span(x, y, a, b)
    common, open_ends = a1 - a0 - k + 1, [1, -1]
    while open_ends:
        for step in list(open_ends):
            # the shingles that are not common may be so many if all that follow and are in both become common
            rest = int(shared_x[-1] - shared_x[min(a1 - k + 1, len(sx))] if step > 0 else shared_x[a0])
            gap = (common + rest) * (100 - percent) // percent
            need = percent * (a1 - a0 + b1 - b0 - 2 * (k - 1)) - (100 + percent) * (common - k + 1)
            for at in _past_edit(sx, sy, runs, *((a1, b1) if step > 0 else (a0, b0)), k, step, gap, need, percent):
                n = _agree(x, y, *at, step)
                new = (a0, at[0] + n, b0, at[1] + n) if step > 0 else (at[0] - n, a1, at[1] - n, b1)
                both = common + n - k + 1
                if 100 * both >= percent * (new[1] - new[0] + new[3] - new[2] - 2 * (k - 1) - both):
                    (a0, a1, b0, b1), common = new, both
                    break
            else:
                open_ends.remove(step)
    if min(a1 - a0, b1 - b0) < min_words:
        return None
    if (a0, a1, b0, b1) == exact:
        return *exact, 1.0
    similarity = _similarity(sx[a0 : a1 - k + 1], sy[b0 : b1 - k + 1])
    if 100 * similarity >= percent:
        return a0, a1, b0, b1, similarity
    return (*exact, 1.0) if exact[1] - exact[0] >= min_words else None


def _first_places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x in order, and the first place of each."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    first = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    return x[first], order[first]


def _pairs_of_equal(ux: np.ndarray, at_x: np.ndarray, uy: np.ndarray, at_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that two _first_places have in common, in the order of the first."""
    at = np.searchsorted(uy, ux)
    common = np.flatnonzero(uy[np.minimum(at, len(uy) - 1)] == ux) if len(uy) else np.zeros(0, np.int64)
    i, j = at_x[common], at_y[at[common]]
    order = np.argsort(i)
    return i[order], j[order]


def _common_runs(gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of common grams begin in two texts' grams: all places in y, and of a gram that repeats in x its first place."""
    a, b, begins = _common_places(gx, gy)
    return a[begins], b[begins]


def _common_places(gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place of y (the second) whose gram x has, the first place where it has it, and whether a run of common grams begins there."""
    values, places = _first_places(gx)
    at = np.searchsorted(values, gy)
    b = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == gy) if len(values) else np.zeros(0, np.int64)
    a = places[at[b]]
    begins = np.ones(len(a), bool)
    begins[1:] = (np.diff(a) != 1) | (np.diff(b) != 1)
    return a, b, begins


def _stretches(begin: np.ndarray, end: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Of places in two arrays of equal length, those with p <= at <= q, q - p at least `least` and begin[p] <= end[q]."""
    best = np.maximum.accumulate(end[::-1])[::-1]  # of the ends from here on
    low = np.minimum.accumulate(begin)  # of the begins up to here
    starts = np.zeros(len(begin), bool)
    if len(begin) > least:
        starts[: len(begin) - least] = best[least:] >= begin[: len(begin) - least]
    so_far = np.concatenate([[0], np.cumsum(starts)])
    near = so_far[at + 1] > so_far[np.maximum(0, at + 1 - least)]
    return near | ((at >= least) & (best[at] >= low[np.maximum(0, at - least)]))


def _hopeful(sx: np.ndarray, sy: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the places (a, b) of common runs can grow into a passage of `least` shingles or more, and _also_in of both.

    Where no shingle repeats, the common ones pair off; a passage from the pair p to the pair q has at most q - p + 1 of them,
    and the others of both sides must be few enough. Else some stretch around the place must have enough of the other
    text's shingles, in both texts.
    """
    (ux, first_x), (uy, first_y) = _first_places(sx), _first_places(sy)
    if len(ux) < len(sx) or len(uy) < len(sy):
        counts = _also_in(sx, sy), _also_in(sy, sx)
        totals = [100 * n - percent * np.arange(len(n)) for n in counts]
        return _stretches(totals[0], totals[0], a, least) & _stretches(totals[1], totals[1], b, least), *counts
    i, j = _pairs_of_equal(ux, first_x, uy, first_y)
    # shared * (100 - percent) >= percent * others, for both texts together
    value = np.arange(len(i)) * (100 + percent) - percent * (i + j)
    found = _stretches(value, value + 100 - percent, np.searchsorted(i, a), (least * percent + 99) // 100 - 1)
    masks = np.zeros(len(sx) + 1, np.int64), np.zeros(len(sy) + 1, np.int64)
    masks[0][i + 1] = masks[1][j + 1] = 1
    return found, *(np.cumsum(mask) for mask in masks)


_KNOWN = "array<struct<start: int, end: int>>"
_RESULT = ("doc_id", "start", "end", "first_doc_id", "first_start", "first_end", "similarity")


def _stretches_of(b: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in words, of places in a row."""
    begins = np.ones(len(b), bool)
    begins[1:] = np.diff(b) != 1
    starts = np.flatnonzero(begins)
    return b[starts], b[np.concatenate([starts[1:], [len(b)]]) - 1] + gram


def _signs(su: np.ndarray, sv: np.ndarray, shared_y: np.ndarray, runs: tuple[np.ndarray, ...], covered: np.ndarray, gram: int, run: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """What y has that x has not, near their common runs: shingles, and junctions of runs that are farther apart in x or nearer; and which of them
    lie in no passage. runs: places of common grams in x and y and where runs begin; shared_y: _also_in(sv, su)."""
    a, b, begins = runs
    low, high = _stretches_of(b, gram)
    wide = high - low >= run
    near = np.zeros(len(sv) + 1, np.int64)
    np.add.at(near, np.maximum(low[wide] - reach, 0), 1)
    np.add.at(near, np.minimum(high[wide] + reach, len(sv)), -1)
    near = np.cumsum(near)[:-1] > 0
    k = len(covered) - len(sv) + 1
    inside = np.concatenate([[0], np.cumsum(covered)])
    new = np.flatnonzero(near & (np.diff(shared_y) == 0))
    starts = np.flatnonzero(begins)
    before, after = starts[1:] - 1, starts[1:]
    end, begin = b[before] + gram - k, b[after]  # the last shingle of a run and the first of the next
    bent = (a[after] - a[before] != b[after] - b[before]) & (begin > end) & (begin - end <= reach) & near[np.minimum(end, len(near) - 1)]
    end, begin = end[bent], begin[bent]
    signs = np.concatenate([sv[new], mix(mix(sv[end]) ^ sv[begin])])
    return signs, np.concatenate([inside[new + k] - inside[new] < k, inside[begin + k] - inside[end] < begin + k - end])


def _runs_longest_first(runs: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows (place in x, place in y) where runs of common grams begin."""
    starts = np.flatnonzero(runs[2])
    lengths = np.diff(np.concatenate([starts, [len(runs[0])]]))
    return np.stack(runs[:2], axis=1)[starts[np.argsort(-lengths, kind="stable")]]


def _verify(pairs: DataFrame, docs: DataFrame, min_words: int, shingle: int, gram: int, run: int, percent: int) -> DataFrame:
    """Passages of candidate pairs (first, doc_id, more, leads, known: array of start and end of passages found in doc_id before), where sign is
    null, and else, of pairs with more, the _signs of doc_id against first, and of those with leads also those of first against doc_id.

    A passage of repeated words has few shingles, and they do not tell how long it is. So where all grams of min_words words or more are also in
    the first document, but in no passage, runs of min_words words are looked up, and are signs if it does not have them.
    """
    types = {"doc_id": pa.int64(), "first_doc_id": pa.int64(), "similarity": pa.float64(), "sign": pa.int64(), "open": pa.bool_()}
    schema = pa.schema([(n, types.get(n, pa.int32())) for n in (*_RESULT, "sign", "open")])
    reach = min_words * 100 // percent

    def passages_of(u, v, su, sv, runs, covered):
        """Passages of one pair, which are marked in covered, _also_in(sv, su), and the hashes of long runs that only y has."""
        found, tried = [], 0
        left = _runs_longest_first(runs)
        some, *counts = _hopeful(su, sv, left[:, 0], left[:, 1], min_words - shingle + 1, percent)
        left, shared = left[some], None
        seen_a, seen_b, lone = np.zeros(len(u), bool), np.zeros(len(v), bool), []
        while True:
            while len(left):
                shared = shared or (counts[0], _shared_runs(*counts))
                (a, b), left = left[0].tolist(), left[1:]
                passage = common_passage(u, v, su, sv, a, b, min_words, shingle, percent, shared)
                a0, a1, b0, b1, s = passage or (*_span(u, v, a, b), 0)
                seen_a[a0:a1], seen_b[b0:b1] = True, True  # shorter runs of equal words are not tried again either
                if passage:
                    covered[b0:b1] = True
                    found.append((b0, b1, a0, a1, round(s, 6)))
                if tried:  # these are whole runs, and wanted until all of their words are in a passage
                    inside = np.concatenate([[0], np.cumsum(covered)])
                    left = left[inside[left[:, 1] + min_words] - inside[left[:, 1]] < min_words]
                else:
                    left = left[~(seen_a[left[:, 0]] & seen_b[left[:, 1]])]
            if tried:
                return found, counts[1], lone
            tried, more = 1, []
            for low, high in zip(*_stretches_of(runs[1], gram), strict=True):
                if high - low >= min_words and not covered[low:high].all():
                    if not more:
                        values, places = _first_places(shingle_hashes(u, min_words))
                    long = shingle_hashes(v[low:high], min_words)
                    inside = np.concatenate([[0], np.cumsum(covered[low:high])])
                    b = np.flatnonzero(inside[min_words:] - inside[:-min_words] < min_words)
                    at = np.searchsorted(values, long[b])
                    there = values[np.minimum(at, len(values) - 1)] == long[b] if len(values) else np.zeros(len(b), bool)
                    more.append(np.stack([places[at[there]], b[there] + low], axis=1))
                    lone.append(np.unique(long[b[~there]]))
            left = np.concatenate(more) if more else left

    def check(batches):
        for part in chunked(batches, "x", PAIR_BYTES):
            for batch in chunked([part], "y", PAIR_BYTES):
                x, y = (Words(*text_buffers(batch.column(i)), NON_SPACE) for i in (2, 3))
                (shx, gx), (shy, gy) = ((shingle_hashes(w.hash, shingle), shingle_hashes(w.hash, gram)) for w in (x, y))
                known = batch.column(4)
                cuts, spans = known.offsets.to_numpy() - known.offsets[0].as_py(), [s.to_numpy() for s in known.flatten().flatten()]
                firsts, docs, more, leads = (batch.column(n).to_pylist() for n in (0, 1, 5, 6))
                out, signs, masks, pending = [], [], {}, []
                for i, (first, doc) in enumerate(zip(firsts, docs, strict=True)):
                    (a, b), (c, d) = ((w.first[i], w.first[i + 1]) for w in (x, y))
                    u, v, su, sv = x.hash[a:b], y.hash[c:d], shx[a : max(a, b - shingle + 1)], shy[c : max(c, d - shingle + 1)]
                    # a pair is compared once, so all its common runs of words are tried
                    runs = _common_places(gx[a : max(a, b - gram + 1)], gy[c : max(c, d - gram + 1)])
                    if not len(runs[0]):
                        continue  # rows of one id may differ in text
                    covered = np.zeros(len(v), bool)
                    found, shared_y, lone = passages_of(u, v, su, sv, runs, covered)
                    out += [(doc, b0, b1, first, a0, a1, s) for b0, b1, a0, a1, s in found]
                    for begin, end in zip(*(s[cuts[i] : cuts[i + 1]].tolist() for s in spans), strict=True):
                        covered[begin:end] = True
                    whole = masks.setdefault((doc, len(v)), covered)  # of all pairs of the document in this batch
                    whole |= covered
                    if more[i]:
                        pending.append((first, doc, su, sv, shared_y, runs, whole, lone))
                    if leads[i]:
                        back = _common_places(gy[c : max(c, d - gram + 1)], gx[a : max(a, b - gram + 1)])
                        sign, _ = _signs(sv, su, _also_in(su, sv), back, np.ones(len(u), bool), gram, run, reach)
                        sign = np.unique(sign)
                        signs.append((np.full(len(sign), doc), np.full(len(sign), first), sign, np.zeros(len(sign), bool)))
                for first, doc, su, sv, shared_y, runs, covered, lone in pending:
                    sign, opened = _signs(su, sv, shared_y, runs, covered, gram, run, reach)
                    sign, opened = np.concatenate([sign, *lone]), np.concatenate([opened, np.ones(sum(map(len, lone)), bool)])
                    order = np.lexsort((~opened, sign))
                    sign, opened = sign[order], opened[order]
                    once = np.flatnonzero(np.concatenate([np.ones(min(1, len(sign)), bool), sign[1:] != sign[:-1]]))
                    signs.append((np.full(len(once), first), np.full(len(once), doc), sign[once], opened[once]))
                if out:
                    yield to_batch(schema, **dict(zip(_RESULT, zip(*out, strict=True), strict=True)), sign=pa.nulls(len(out), pa.int64()), open=pa.nulls(len(out), pa.bool_()))
                if signs:
                    first, doc, sign, opened = (np.concatenate(x) for x in zip(*signs, strict=True))
                    empty = {n: pa.nulls(len(doc), types.get(n, pa.int32())) for n in _RESULT}
                    yield to_batch(schema, **empty | {"doc_id": doc, "first_doc_id": first}, sign=sign.view(np.int64), open=opened)

    left = docs.select(F.col("doc_id").alias("first"), F.col("text").alias("x"))
    right = docs.select("doc_id", F.col("text").alias("y"))
    both = pairs.join(left, "first").join(right, "doc_id").select("first", "doc_id", "x", "y", "known", "more", "leads")
    return both.mapInArrow(check, "doc_id long, start int, end int, first_doc_id long, first_start int, first_end int, similarity double, sign long, open boolean")


def _alike(signs: DataFrame, tried: DataFrame) -> DataFrame:
    """(first, doc_id, more, leads) from signs (of, sign, doc_id, open): documents whose sign is open with earlier ones that have it, the first of
    all and the SEVERAL before it, but for tried pairs and where the first has been tried; more: there are others, and this is the first; leads:
    the later document is the earlier one of another pair."""
    rows = Window.partitionBy("of", "sign").orderBy("doc_id")
    ranked = signs.select("doc_id", "open", F.row_number().over(rows).alias("n"), F.first("doc_id").over(rows).alias("lead"), *(F.lag("doc_id", k).over(rows).alias(f"_{k}") for k in range(1, SEVERAL + 1)))
    earlier = F.array_distinct(F.array_compact(F.array("lead", *(f"_{k}" for k in range(1, SEVERAL + 1)))))
    met = ranked.where("open and lead < doc_id").select("lead", "doc_id", "n", earlier.alias("earlier"))
    met = met.join(tried.withColumnRenamed("first", "lead"), ["lead", "doc_id"], "left_anti").select(F.explode("earlier").alias("first"), "doc_id", "lead", "n")
    met = met.where("first < doc_id").groupBy("first", "doc_id").agg(F.bool_or((F.col("first") == F.col("lead")) & (F.col("n") > SEVERAL + 2)).alias("more"))
    return met.join(tried, ["first", "doc_id"], "left_anti")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, shingle: int = SHINGLE, percent: int = PERCENT, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, first_doc_id, first_start, first_end, similarity): passages and where they are found first.

    Places are word numbers, end exclusive. A passage that many documents share is reported once for each of them but the
    first, never for all their pairs; a copy of a whole text is reported with the first such text, whose passages it has too.
    Python gets texts, and pairs of them, in small batches.
    """
    with small_arrow_batches(docs.sparkSession):
        return _repeated_passages(docs, min_words, shingle, percent, gram, id_col, text_col)


def _repeated_passages(docs: DataFrame, min_words: int, shingle: int, percent: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    source = documents(docs, id_col, text_col).where("doc_id is not null")
    run = least_run(min_words, shingle, percent)
    gram = max(shingle, min(gram, run))
    copies, dropped = _copies(source)
    met = stage(_met(windows(source, min_words, gram, max(run, gram))), "met")
    copied = stage(copies.join(met.where("first is null").select("doc_id", "n"), "doc_id").distinct(), "copied")  # a copy of several texts may have several sizes
    # the least document of a group is never one that was dropped, as it has an earlier copy
    pairs = stage(met.where("first is not null").select("first", "doc_id").distinct().join(dropped, "doc_id", "left_anti"), "pairs")
    unstage(copies, dropped, met)
    used = [copied]
    texts = stage(among(source, pairs.select("doc_id").union(pairs.select("first"))), "texts")
    used.append(texts)
    tried, done, near = pairs, None, texts
    asked = pairs.select("*", F.lit(True).alias("more"), F.lit(None).cast(_KNOWN).alias("known"))
    while True:
        leads = pairs.select(F.col("first").alias("doc_id"), F.lit(True).alias("leads")).distinct()
        asked = asked.join(leads, "doc_id", "left").select("first", "doc_id", "more", F.coalesce("leads", F.lit(False)).alias("leads"), F.coalesce("known", F.array().cast(_KNOWN)).alias("known"))
        found = stage(_verify(asked, near, min_words, shingle, gram, run, percent), "passages")
        passages = found.where("sign is null")
        done = passages if done is None else done.unionByName(passages)
        # documents that go on alike where they have nothing in common with the first of their group meet each other
        signs = found.where("sign is not null").select(F.col("first_doc_id").alias("of"), "sign", "doc_id", "open")
        used += [pairs, found]
        pairs = stage(_alike(signs, tried), "pairs")
        if pairs.isEmpty():
            break
        tried = tried.unionByName(pairs.select("first", "doc_id"))
        near = among(texts, pairs.select("doc_id").union(pairs.select("first")))
        known = done.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("known"))
        asked = pairs.join(known, "doc_id", "left")
    whole = copied.select("doc_id", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("first").alias("first_doc_id"), F.lit(0).alias("first_start"), F.col("n").alias("first_end"), F.lit(1.0).alias("similarity"))
    out = stage(done.select(*_RESULT).distinct().unionByName(whole), "passages")
    unstage(*used, pairs)
    return out
