"""Best-fit packing of token sequences by exact complements.

Documents are encoded and only those longer than the capacity are cut. All that the plan needs is how many pieces there
are of each length, at most `capacity` numbers. The plan takes the longest length left, looks its gap up among the single, pair
and triple sums of available lengths, and failing that adds the longest piece that fits and tries again;
each composition is consumed as often as the counts allow, so a plan has about as many compositions as there are lengths
however many documents there are. Pieces then find their place from their length and their rank among pieces of that
length; ranks come from per-task counts and prefix sums, never from one sorted group.

Null text is an empty document (one end id). Rows with a null doc_id and repeated rows are packed like any other. An empty
table gives no sequences. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import chunked, documents, small_arrow_batches, stage, text_buffers, to_batch
from mnemospark.llm.tokens import END_ID, default_path, encoder

CAPACITY = 4096


# ---------------------------------------------------------------- the plan, over counts of lengths


class ComplementIndex:
    """Sums of one, two and three lengths, each looked up by its total under the counts that are left.

    The pairs of a total, and the first lengths of its triples, are listed once, longest first. A mark moves past those whose
    lengths have run out; counts only fall, so none is ever passed twice.
    """

    def __init__(self, left: np.ndarray):
        self.left = left  # the plan takes pieces out of it
        self.pairs: dict[int, list] = {}  # total -> [longer lengths, mark]
        self.firsts: dict[int, list] = {}  # total -> [longest lengths, mark]

    def pair(self, total: int, free: np.ndarray) -> tuple[int, int] | None:
        """Two lengths of that sum, the longer one as long as can be, of which `free` (at most what is left) has enough."""
        if total not in self.pairs:
            small = np.arange(1, total // 2 + 1)
            self.pairs[total] = [(total - small)[(self.left[small] > 0) & (self.left[total - small] > 0)].tolist(), 0]
        entry = self.pairs[total]
        longer, at = entry
        while at < len(longer):
            a, b = longer[at], total - longer[at]
            if self.left[a] > 0 and self.left[b] > (a == b):
                if free[a] > 0 and free[b] > (a == b):
                    return a, b
            elif at == entry[1]:
                entry[1] += 1
            at += 1
        return None

    def triple(self, total: int, free: np.ndarray) -> tuple[int, int, int] | None:
        if total not in self.firsts:
            self.firsts[total] = [(np.flatnonzero(self.left[1 : total - 1] > 0)[::-1] + 1).tolist() if total > 2 else [], 0]
        entry = self.firsts[total]
        longest, at = entry
        while at < len(longest):
            c = longest[at]
            if self.left[c] > 0 and self.pair(total - c, self.left):
                if free[c] > 0:
                    free[c] -= 1
                    two = self.pair(total - c, free)
                    free[c] += 1
                    if two:
                        return c, *two
            elif at == entry[1]:
                entry[1] += 1
            at += 1
        return None

    def fill(self, gap: int, free: np.ndarray) -> list[int] | None:
        """One, two or three free lengths that fill the gap exactly."""
        if free[gap] > 0:
            return [gap]
        return list(self.pair(gap, free) or self.triple(gap, free) or ()) or None


def pack_counts(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Compositions (times, [(length, pieces of it), ...]) that use up counts[length] pieces of every length."""
    left, out = counts.astype(np.int64).copy(), []
    index, longest = ComplementIndex(left), capacity
    while True:
        while longest > 0 and not left[longest]:
            longest -= 1
        if not longest:
            return out
        free, used, gap = left.copy(), [longest], capacity - longest
        free[longest] -= 1
        while gap:
            if exact := index.fill(gap, free):
                used += exact
                break
            fitting = np.flatnonzero(free[: gap + 1])
            if not len(fitting):
                break
            best = int(fitting[-1])
            n = int(min(free[best], gap // best))
            n = max(1, n - 1) if n > 3 else 1  # a run of equal small pieces at once, the last ones by complements
            used += [best] * n
            free[best] -= n
            gap -= best * n
        lengths, each = np.unique(used, return_counts=True)
        times = int((left[lengths] // each).min())
        left[lengths] -= times * each
        out.append((times, list(zip(lengths.tolist()[::-1], each.tolist()[::-1], strict=True))))


def slot_table(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset of the first), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, parts in plan:
        offset = 0
        for length, each in parts:
            rows.append((length, rank.get(length, 0), each, sequence, offset))
            rank[length] = rank.get(length, 0) + times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- the Spark side


def _pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int) -> DataFrame:
    """One row a piece: where it is from, its ids, its task and its rank among the task's pieces of that length."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("local_rank", pa.int64())]
    schema = pa.schema(kinds)

    def cut(batches):
        code, seen = encoder(tokenizer, end_id), np.zeros(capacity + 1, np.int64)
        for batch in chunked(batches):
            ids, offsets = code.encode(*text_buffers(batch.column(1)))
            sizes = np.diff(offsets)
            n = np.maximum(1, -(-sizes // capacity)) * (sizes > 0)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            order = np.argsort(length, kind="stable")
            rank = np.empty(len(row), np.int64)
            ordered = length[order]
            rank[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            raw, at = ids.astype("<u4").tobytes(), (offsets[row] + start).tolist()
            yield to_batch(
                schema, doc_id=batch.column(0).take(pa.array(row)), piece=piece, start=start, length=length, local_rank=rank,
                ids=[raw[4 * a : 4 * (a + k)] for a, k in zip(at, length.tolist(), strict=True)], part=batch.column(2).take(pa.array(row)),
            )

    source = documents(docs).select("doc_id", "text", F.spark_partition_id().alias("part"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, part int, local_rank long")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, sequence_id, offset): every piece, its ids and its place.

    ids are little-endian uint32 bytes. The driver sees one count a length, at most `capacity` of them; the table of slots
    that tasks look up has a few rows for each of these lengths, whatever the input. Texts go to Python in small batches; to find its place,
    a piece sends its length and rank and not its ids.
    """
    with small_arrow_batches(docs.sparkSession):
        pieces = stage(_pieces(docs, tokenizer or default_path(), end_id, capacity), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = stage(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-ranks")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    slots = slot_table(pack_counts(counts, capacity))
    key = slots[:, 0] * (1 << 40) + slots[:, 1]

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(), rank.to_numpy()
        slot = slots[np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1]
        nth = rank - slot[:, 1]
        return pa.StructArray.from_arrays([pa.array(slot[:, 3] + nth // slot[:, 2]), pa.array(slot[:, 4] + nth % slot[:, 2] * length)], ["sequence_id", "offset"])

    ranked = pieces.join(by_part.select("part", "length", "base"), ["part", "length"])
    placed = ranked.withColumn("at", place("length", F.col("base") + F.col("local_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")
