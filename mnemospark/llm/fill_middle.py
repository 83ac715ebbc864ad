"""Fill-in-the-middle: texts are cut in three and put together in another order, so that a model learns to fill gaps.

A batch of texts is handled as Arrow arrays: texts become lists of units (code points, words or lines), the lists are
flattened with the index of their text, a unit's ordinal in its text gives its role (prefix, middle or suffix), each role's
units are filtered out and built into lists again, and `binary_join` makes pieces and outputs of them. Where to cut and which
form a document gets comes from a hash of its doc_id, so neither partitions nor repeated runs matter. Nothing is shuffled.

Null text is empty; empty texts and texts that hold a sentinel stay as they are (form `plain`). Rows with a null doc_id are
hashed as if it were empty; repeated rows get equal outputs; an empty table gives no rows; other columns are not read. A text
longer than PART_BYTES is cut in parts at unit borders, which go through the same steps one after another: beside the text and its
output only one part's units are in memory (a single unit, such as a line, is not cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import chunked, documents, to_batch

SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are rearranged, and of 100 rearranged ones so many get their suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of text whose units are held at once, about 40 bytes of memory for each.
PART_BYTES = 1 << 19
PLAIN, PREFIX_FIRST_FORM, SUFFIX_FIRST_FORM = "plain", "psm", "spm"
_SPACE = pa.array([32, 9, 10, 11, 12, 13], pa.uint8())


# ---------------------------------------------------------------- units and pieces


def _bytes_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 offsets of the texts in them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return pa.array([], pa.uint8()), np.zeros(len(texts) + 1, np.int64)
    size = int(offsets[-1] - offsets[0])
    return pa.Array.from_buffers(pa.uint8(), size, [None, texts.buffers()[2].slice(int(offsets[0]), size)]), offsets - offsets[0]


def _starts(data: pa.Array, unit: str) -> pa.Array:
    """Places of bytes that begin a unit, the first one of a text not counted: a code point, a word after white space, a line after its end. White space
    before the first word is a unit of its own."""
    if unit == "char":
        return pc.indices_nonzero(pc.not_equal(pc.bit_wise_and(data, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8())))
    before, after = data.slice(0, max(0, len(data) - 1)), data.slice(1)
    if unit == "line":
        begins = pc.equal(before, pa.scalar(10, pa.uint8()))
    elif unit == "word":
        begins = pc.and_not(pc.is_in(before, _SPACE), pc.is_in(after, _SPACE))
    else:
        raise ValueError(f"unit must be char, word or line, not {unit!r}")
    return pc.add(pc.indices_nonzero(begins), pa.scalar(1, pa.uint64()))


def unit_lists(texts: pa.Array, unit: str) -> pa.Array:
    """A list of units for each text; joined they are the text again."""
    data, offsets = _bytes_of(texts)
    begins = np.union1d(_starts(data, unit).to_numpy(zero_copy_only=False), offsets[:-1][offsets[1:] > offsets[:-1]]).astype(np.int64)
    bounds = pa.py_buffer(np.append(begins, offsets[-1]))
    flat = pa.Array.from_buffers(pa.large_string(), len(begins), [None, bounds, data.buffers()[1].slice(data.offset) if len(data) else pa.py_buffer(b"")])
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(begins, offsets), pa.int64()), flat)


def cut(lists: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Prefix, middle and suffix of each list of units: units before `first`, before `second`, and the others."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(flat)), pa.int64()), pc.take(lists.offsets.slice(0, len(lists)), parent))
    in_prefix, before_suffix = pc.less(ordinal, pc.take(first, parent)), pc.less(ordinal, pc.take(second, parent))
    sizes = (first, pc.subtract(second, first), pc.subtract(pc.list_value_length(lists), second))
    pieces = []
    for mask, size in zip((in_prefix, pc.and_not(before_suffix, in_prefix), pc.invert(before_suffix)), sizes, strict=True):
        bounds = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(size, pa.int64()))])
        pieces.append(pc.binary_join(pa.LargeListArray.from_arrays(bounds, pc.filter(flat, mask)), pa.scalar("", pa.large_string())))
    return tuple(pieces)


def _parts(text: pa.Array, unit: str, most: int) -> Iterator[pa.Array]:
    """One long text as arrays of one shorter text, each cut at a unit's begin."""
    data, _ = _bytes_of(text)
    begin, whole = 0, text.cast(pa.large_binary())[0].as_buffer()
    while begin < len(data):
        end, reach = len(data), most
        while begin + reach < len(data):
            found = _starts(data.slice(begin, reach), unit)
            last = found[-1].as_py() if len(found) else 0
            if last:
                end = begin + last
                break
            reach *= 2  # a unit longer than a part stays whole
        yield pa.array([whole.slice(begin, end - begin).to_pybytes()], pa.large_binary()).cast(pa.large_string())
        begin = end


def pieces_of(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, unit: str, most: int = PART_BYTES) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Units of each text, and its prefix, middle and suffix, cut after the smaller and the larger of h1 and h2 modulo (units + 1)."""
    if len(texts) == 1 and _bytes_of(texts)[1][-1] > most:
        sizes = [len(unit_lists(part, unit).values) for part in _parts(texts, unit, most)]
        n = np.array([sum(sizes)])
        lows, ends = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
        made, base = [], 0
        for part, size in zip(_parts(texts, unit, most), sizes, strict=True):
            made.append(cut(unit_lists(part, unit), *(pa.array(np.clip(x - base, 0, size), pa.int64()) for x in (lows, ends))))
            base += size
        return n, *(pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(made)], pa.int64()), pa.concat_arrays([m[i] for m in made])), pa.scalar("", pa.large_string())) for i in range(3))
    lists = unit_lists(texts, unit)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    one, two = h1 % (n + 1), h2 % (n + 1)
    return n, *cut(lists, pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)))


# ---------------------------------------------------------------- operators


def _check(sentinels: tuple[str, str, str]) -> None:
    ends = {s[:k] for s in sentinels for k in range(1, len(s))}
    if len(set(sentinels)) < 3 or not all(sentinels) or any(a in b for a in sentinels for b in sentinels if a != b) or any(s[-k:] in ends for s in sentinels for k in range(1, len(s))):
        raise ValueError("sentinels must be three texts that neither hold nor overlap each other, or an output could be read in two ways")


def fill_in_middle(
    docs: DataFrame, unit: str = "char", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document row; n counts units, the lengths code points.

    Four numbers, the first digits of the sha256 of `seed:doc_id`, decide where to cut, whether to rearrange at all, and in which order.
    """
    _check(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    untouched = F.col("text") == ""
    for s in sentinels:
        untouched = untouched | F.contains("text", F.lit(s))
    form = F.when(untouched | (numbers[2] % 100 >= rate), PLAIN).when(numbers[3] % 100 < suffix_first, SUFFIX_FIRST_FORM).otherwise(PREFIX_FIRST_FORM)
    rows = documents(docs, id_col, text_col).select("doc_id", "text", form.alias("form"), numbers[0].alias("h1"), numbers[1].alias("h2"))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
    before = [pa.scalar(s, pa.large_string()) for s in sentinels]

    def rearrange(batches):
        for batch in chunked(batches, "text", part_bytes):
            text, kind = batch.column(1).cast(pa.large_string()), batch.column(2)
            n, prefix, middle, suffix = pieces_of(text, batch.column(3).to_numpy(), batch.column(4).to_numpy(), unit, part_bytes)
            p, s, m = before
            nothing = pa.scalar("", pa.large_string())
            psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
            spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
            plain = pc.equal(kind, PLAIN)
            output = pc.if_else(plain, text, pc.if_else(pc.equal(kind, SUFFIX_FIRST_FORM), spm, psm))
            none = pa.scalar(None, pa.int64())
            lengths = [pc.if_else(plain, none, pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
            yield to_batch(schema, doc_id=batch.column(0), n=n, form=kind, prefix_chars=lengths[0], middle_chars=lengths[1], output=output)

    return rows.mapInArrow(rearrange, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of the given form was made of."""
    p, s, m = sentinels

    def between(begin: str, end: str | None) -> Column:
        rest = F.substring_index(output, begin, -1)
        return rest if end is None else F.substring_index(rest, end, 1)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == PREFIX_FIRST_FORM, psm).when(form == SUFFIX_FIRST_FORM, spm).otherwise(output)


def with_digests(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Each row with the sha256 of its output and of the text restored from it, without the output."""
    return made.withColumns({
        "output_sha256": F.sha2(F.col("output"), 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form"), sentinels), 256),
    }).drop("output")
