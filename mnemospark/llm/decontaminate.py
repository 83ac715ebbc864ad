"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's windows are its runs of `window` words (a shorter item is one window). A window's elements are its word
shingles; a text can only contain the window if it contains every shingle, so one of them, the rarest in the corpus, is
a sufficient prefix. Documents look their shingles up among the prefixes by an equi-join; the shingle's place in the window
gives the only possible start, which must leave the whole window inside the document (length and positional bounds); the words
there are then compared exactly.

The texts are read twice, whatever the number of windows: to count the windows' shingles, and to look them up. Both times a
bitmap of fixed size drops shingles that no window has; what it lets through goes on to the join with a few words around it, so
no text is shuffled and no window or prefix comes to the driver. A bitmap that a very large benchmark fills drops less and
loses nothing.

Null or wordless texts have no words and no hits; wordless or null items have no windows; items with a null id mark words
but are not listed; items repeated under one id count once. Repeated documents are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import ALNUM, BITMAP, Words, bitmap, chunked, documents, shingle_hashes, stage, text_buffers, to_batch, unstage

WINDOW = 13
SHINGLE = 5


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows (words joined by a space) with the ids of their items."""
    schema = pa.schema([("item_id", pa.string()), ("words", pa.string())])

    def cut(batches):
        for batch in chunked(batches):
            w = Words(*text_buffers(batch.column(1)), ALNUM)
            ids, texts = [], []
            for item, a, b in zip(batch.column(0).to_pylist(), w.first.tolist(), w.first[1:].tolist(), strict=False):
                words = [w.word(i).decode() for i in range(a, b)]
                runs = [" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []
                ids += [item] * len(runs)
                texts += runs
            yield to_batch(schema, item_id=ids, words=texts)

    source = items.select(F.col(id_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(cut, "item_id string, words string").groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _shingled(windows: DataFrame, shingle: int) -> DataFrame:
    """(words, items, size, k, shingles): the windows with the hashes of their runs of k words, k the lesser of `shingle` and size."""
    schema = pa.schema([("words", pa.string()), ("items", pa.list_(pa.string())), ("size", pa.int32()), ("k", pa.int32()), ("shingles", pa.list_(pa.int64()))])

    def cut(batches):
        for batch in chunked(batches, "words"):
            w = Words(*text_buffers(batch.column(0)), ALNUM)
            k = np.minimum(w.count, shingle)
            runs = [shingle_hashes(w.hash[a:b], n).view(np.int64) for a, b, n in zip(w.first.tolist(), w.first[1:].tolist(), k.tolist(), strict=False)]
            yield to_batch(schema, words=batch.column(0), items=batch.column(1), size=w.count, k=k, shingles=runs)

    return windows.select("words", "items").mapInArrow(cut, "words string, items array<string>, size int, k int, shingles array<long>")


def _document_shingles(w: Words, k: int, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words whose bit is set and the word they start at, runs across documents left out."""
    h = shingle_hashes(w.hash, k)
    at = np.flatnonzero(maybe[h & np.uint64(BITMAP - 1)])
    at = at[at + k <= np.repeat(w.first[1:], w.count)[at]]
    return h[at].view(np.int64), at


def _bitmap_of(hashes: DataFrame) -> np.ndarray:
    return bitmap(hashes.select(F.pmod("h", F.lit(BITMAP)).alias("x")))


def _counted(source: DataFrame, sizes: list[int], maybe: np.ndarray) -> DataFrame:
    """(h, n): how often the corpus has each shingle whose bit is set."""
    schema, sent = pa.schema([("h", pa.int64()), ("n", pa.int64())]), source.sparkSession.sparkContext.broadcast(maybe)

    def count(batches):
        for batch in chunked(batches):
            w = Words(*text_buffers(batch.column(0)), ALNUM)
            h, n = np.unique(np.concatenate([_document_shingles(w, k, sent.value)[0] for k in sizes]), return_counts=True)
            if len(h):
                yield to_batch(schema, h=h, n=n)

    return source.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _prefixes(source: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(words, items, size, h, place): the windows all of whose shingles occur in the corpus, each with the rarest and its place."""
    each = windows.select("words", "items", "size", F.posexplode("shingles").alias("place", "h"))
    seen = _counted(source, sizes, _bitmap_of(each))
    rarest = each.join(seen, "h", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "h")).alias("x"), F.first("items").alias("items"), F.first("size").alias("size")
    )
    return rarest.where("x.n > 0").select("words", "items", "size", "x.h", "x.place")


_PLACES = "array<struct<h:bigint,at:int,before:int,around:string>>"


def _looked_up(source: DataFrame, sizes: list[int], maybe: np.ndarray, window: int) -> DataFrame:
    """(row, doc_id, n_words, places): places are a document's shingles whose bit is set, with the words that a window around
    them can reach and how many of these come before the shingle."""
    place = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())])
    schema = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place))])
    sent = source.sparkSession.sparkContext.broadcast(maybe)

    def look_up(batches):
        for batch in chunked(batches):
            w = Words(*text_buffers(batch.column(2)), ALNUM)
            first, last = np.repeat(w.first[:-1], w.count), np.repeat(w.first[1:], w.count)
            places: list[list] = [[] for _ in range(batch.num_rows)]
            for k in sizes:
                h, at = _document_shingles(w, k, sent.value)
                begin, end = np.maximum(first[at], at - max(0, window - k)), np.minimum(last[at], at + window)
                owner = np.searchsorted(w.first, at, side="right") - 1
                for d, x, i, a, b in zip(owner.tolist(), h.tolist(), at.tolist(), begin.tolist(), end.tolist(), strict=True):
                    around = b" ".join([w.word(j) for j in range(a, b)]).decode()
                    places[d].append({"h": x, "at": i - int(w.first[d]), "before": i - a, "around": around})
            yield to_batch(schema, row=batch.column(0), doc_id=batch.column(1), n_words=w.count, places=places)

    return source.select("row", "doc_id", "text").mapInArrow(look_up, f"row string, doc_id long, n_words long, places {_PLACES}")


def _found(looked_up: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, hits, items) of rows that have a window: the places of all words inside one, and the ids of the items, both sorted."""
    each = looked_up.select("row", F.explode("places").alias("p")).select("row", "p.*")
    each = each.join(prefixes, "h").withColumn("start", F.col("before") - F.col("place")).withColumn("around", F.split("around", " "))
    whole = each.where("start >= 0 and start + size <= size(around)").where("array_join(slice(around, start + 1, size), ' ') = words")
    spans = whole.select("row", (F.col("at") - F.col("place")).alias("a"), "size", "items")
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("a", "size")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    hits = F.expr("array_sort(array_distinct(flatten(transform(spans, x -> sequence(x.a, x.a + x.size - 1)))))")
    return spans.select("row", hits.alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def _contamination(source: DataFrame, items: DataFrame, window: int, shingle: int, item_id: str, item_text: str, repeated: bool = False) -> tuple[DataFrame, DataFrame]:
    """For source (row, doc_id, text): (row, doc_id, n_words, places) of every row, and (row, hits, items) of each `row` that is hit.
    repeated: rows may have a `row`, and then the text, in common; one of them is joined."""
    windows = stage(_shingled(item_windows(items, item_id, item_text, window), shingle), "windows")
    sizes = sorted(r.k for r in windows.select("k").distinct().collect()) or [shingle]  # at most `shingle` numbers
    prefixes = stage(_prefixes(source, windows, sizes), "prefixes")
    unstage(windows)
    looked_up = stage(_looked_up(source, sizes, _bitmap_of(prefixes), window), "lookups")
    some = looked_up.where(F.size("places") > 0)
    found = stage(_found(some.dropDuplicates(["row"]) if repeated else some, prefixes), "contamination")
    unstage(prefixes)
    return looked_up, found


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, hits, items): the places of words inside any occurring window and the sorted item ids."""
    source = documents(docs, id_col, text_col).select(F.monotonically_increasing_id().cast("string").alias("row"), "doc_id", "text")
    looked_up, found = _contamination(source, items, window, shingle, item_id, item_text)
    none = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("hits", "items")]
    return looked_up.join(found, "row", "left").select("doc_id", "n_words", *none)


def judged(found: DataFrame, percent: int = 5) -> DataFrame:
    """The same rows with counts and `contaminated`: at least `percent` of the words are hit."""
    n_hit = F.size("hits").cast("long")
    return found.select(
        *[c for c in found.columns if c == "row"], "doc_id", "n_words", n_hit.alias("n_hit"), "items",
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not contaminated. The verdict is one on the text: rows go by the digest
    of theirs, whatever their doc_id, so that null and repeated ids neither save a row nor take another one with it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.sha2(text, 256).alias("row"), F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    looked_up, found = _contamination(source, items, window, shingle, item_id, item_text, repeated=True)
    whole = looked_up.where(F.size("places") > 0).select("row", "doc_id", "n_words").dropDuplicates(["row"]).join(found, "row")
    bad = judged(whole).where("contaminated").select(F.col("row").alias("_bad"))
    return docs.join(bad, F.sha2(text, 256) == bad["_bad"], "left_anti")
