"""Exact token-length histogram and what it answers: totals, quantiles and truncated totals for any context limit.

Null text counts as an empty document; repeated rows count each; other columns are ignored; an empty table gives an empty
histogram. Counts cover all documents: each task sums the lengths of its batches, one shuffle adds them by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import chunked, documents, stage, text_buffers, to_batch
from mnemospark.llm.tokens import END_ID, default_path, encoder

#: Lengths in one block of the two-level suffix sums.
BLOCK = 128


def length_histogram(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length, the end id included."""
    tokenizer = tokenizer or default_path()
    schema = pa.schema([("n_tokens", pa.int64()), ("n", pa.int64())])

    def lengths(batches):
        code = encoder(tokenizer, end_id)
        for batch in chunked(batches):
            _, offsets = code.encode(*text_buffers(batch.column(0)))
            values, n = np.unique(np.diff(offsets), return_counts=True)
            yield to_batch(schema, n_tokens=values, n=n)

    texts = documents(docs, id_col, text_col).select("text")
    return texts.mapInArrow(lengths, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Each length with what holds if it is the context limit.

    docs_from, tokens_from: documents at least that long and their tokens; docs_to: documents at most that long;
    truncated_total: tokens left when every document is cut to the length. Sums are taken within blocks of lengths and
    then over the few blocks, so no task sees all lengths. The histogram is written once, as it is read twice.
    """
    rows = stage(histogram, "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK lengths
    both = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(both).alias("d_all"), F.sum("t").over(both).alias("t_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = rows.join(blocks, "block").select(
        "n_tokens", "n_docs", "d_all", "t_all",
        (F.sum("n_docs").over(inside) + F.col("d_later")).alias("docs_from"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t_later")).alias("tokens_from"),
    )
    return out.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        (F.col("d_all") - F.col("docs_from") + F.col("n_docs")).alias("docs_to"),
        (F.col("t_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(max_tokens, docs_cut, tokens_left) for each limit: documents over it, tokens left when all are cut to it."""
    asked = [
        F.struct(
            F.lit(int(k)).cast("long").alias("max_tokens"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > k, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
            F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(k))), F.lit(0)).alias("tokens_left"),
        )
        for k in limits
    ]
    return sums.agg(F.array(*asked).alias("x")).select(F.inline("x"))


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least q of the documents do not exceed; null for no documents."""
    total = F.col("docs_from") + F.col("docs_to") - F.col("n_docs")
    asked = [F.struct(F.lit(float(q)).alias("q"), F.min(F.when(F.col("docs_to") >= F.lit(float(q)) * total, F.col("n_tokens"))).alias("n_tokens")) for q in qs]
    return sums.agg(F.array(*asked).alias("x")).select(F.inline("x"))
