"""Reranking, neighbour expansion, segments, packaging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T

NO_RANK = 1 << 60
MAX_TOKENS = 117_760
PLACEMENTS = ("keep", "front", "echo")


def apply_rerank(candidates: DataFrame, scores: DataFrame | None) -> DataFrame:
    """candidates (query_id, memory_id, rank) in score order, with `status`; scores: (query_id, idx, score), idx = rank.

    All or nothing a query: with a score missing, repeated, out of range, null or not finite the old order stays (degraded).
    """
    if scores is None:
        return candidates.withColumn("status", F.lit("disabled"))
    n = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    sane = scores.join(n, "query_id", "left").groupBy("query_id").agg(
        (F.bool_and(F.coalesce(finite & F.col("idx").between(0, F.col("n") - 1), F.lit(False))) & (F.count("*") == F.first("n")) & (F.count_distinct("idx") == F.first("n"))).alias("ok")
    )
    marked = candidates.join(sane, "query_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    joined = marked.join(scores.select("query_id", F.col("idx").alias("rank"), "score").dropDuplicates(["query_id", "rank"]), ["query_id", "rank"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("ok"), F.col("score"))), "rank")
    return joined.select("query_id", "memory_id", (F.row_number().over(order) - 1).alias("rank"), F.when(F.col("ok"), "called").otherwise("degraded").alias("status"))


def isolated(call: Callable[[pd.DataFrame], list], rows: pd.DataFrame, key: str, missing) -> tuple[list, list]:
    """(values, errors) of a model call on rows; if it raises, of a call for each key alone: rows of a key that fails again get `missing` and the error."""
    try:
        return list(call(rows)), [None] * len(rows)
    except Exception:
        values, errors = [missing] * len(rows), [None] * len(rows)
        for places in rows.reset_index(drop=True).groupby(key, sort=False).indices.values():
            try:
                got = list(call(rows.iloc[places]))
            except Exception as error:
                got = None
                said = f"{type(error).__name__}: {error}"[:500]
            for at, i in enumerate(places):
                if got is None:
                    errors[i] = said
                else:
                    values[i] = got[at]
        return values, errors


def score_pairs(candidates: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], batch_size: int = 64) -> DataFrame:
    """(query_id, idx, score) of candidates (query_id, memory_id, rank) by a model on Arrow batches.

    queries: (query_id, query); texts: (memory_id, text). scorer gets lists of queries and texts; a candidate without a text
    gets no score, so that apply_rerank() leaves its query as it was. Where the scorer raises, each query of the batch is tried alone, and
    the scores of those that fail again are null: they stay as they were too, and the others are reranked.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch_size):
                part = frame.iloc[i : i + batch_size]
                scores = isolated(lambda rows: np.asarray(scorer(rows["query"].tolist(), rows["text"].tolist()), np.float64), part, "query_id", None)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "idx": part["idx"].to_numpy(), "score": np.array(scores[0], np.float64)})

    pairs = candidates.join(queries.select("query_id", "query"), "query_id").join(texts.select("memory_id", "text"), "memory_id")
    return pairs.select("query_id", F.col("rank").cast("int").alias("idx"), "query", "text").mapInPandas(run, "query_id string, idx int, score double")


def expand_neighbors(ranked: DataFrame, blocks: DataFrame, seed_limit: int = 1000, radius: int = 2, save: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Selected memories (query_id, memory_id, rank, hop, missing): the candidates and their neighbours along prev/next links.

    Walks start from candidates ranked before seed_limit, in `radius` rounds of two joins on the id; memories that are
    already selected are neither added again nor walked through. Neighbours have no rank; ids without a block are missing.
    `save` writes a table once and reads it back; without it each round makes the ones before it anew.
    """
    save = save or (lambda df, name: df)
    links = blocks.select(F.col("id").alias("memory_id"), F.array_compact(F.array("prev_memory_id", "next_memory_id")).alias("near"))
    selected = save(ranked.select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"), F.lit(0).alias("hop")), "selected")
    frontier = selected.where(F.col("rank") < seed_limit).select("query_id", "memory_id")
    for hop in range(1, radius + 1):
        met = frontier.join(links, "memory_id").select("query_id", F.explode("near").alias("memory_id")).distinct()
        frontier = save(met.join(selected.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti"), f"frontier-{hop}")
        selected = selected.unionByName(frontier.select("query_id", "memory_id", F.lit(None).cast("long").alias("rank"), F.lit(hop).alias("hop")))
    known = blocks.select(F.col("id").alias("memory_id"), F.lit(False).alias("_known"))
    return selected.join(known, "memory_id", "left").select("query_id", "memory_id", "rank", "hop", F.coalesce("_known", F.lit(True)).alias("missing"))


def expansion_counts(expanded: DataFrame) -> DataFrame:
    return expanded.groupBy("query_id").agg(F.count_if((F.col("hop") > 0) & ~F.col("missing")).alias("neighbors_added"), F.count_if("missing").alias("missing_rows"))


def merge_segments(selected: DataFrame, blocks: DataFrame, placement: str = "keep", with_day: bool = False, count: Column | None = None, annotate=None) -> DataFrame:
    """Runs of selected blocks that follow each other by their links, as context segments.

    Windows carry ids only; texts are joined last. The anchor is the best-ranked member, or the first one if none has a rank.
    `annotate` maps (text, day) columns, e.g. annotate_relative_dates; `count` counts the tokens of the column `content`.
    """
    if placement not in PLACEMENTS:
        raise ValueError(f"placement must be one of {', '.join(PLACEMENTS)}")
    chain = ["query_id", "user_id", "session_id", "request_id"]
    places = blocks.select(F.col("id").alias("memory_id"), "user_id", "session_id", "request_id", "local_index", "next_memory_id")
    rows = selected.select("query_id", "memory_id", "rank").join(places, "memory_id")
    w = Window.partitionBy(*chain).orderBy("local_index")
    joins = F.coalesce(F.lag("next_memory_id").over(w) == F.col("memory_id"), F.lit(False))
    rows = rows.withColumn("run", F.sum((~joins).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*chain, "run")
    rows = rows.withColumn("anchor", F.min(F.struct(F.coalesce("rank", F.lit(NO_RANK)).alias("rank"), "local_index", "memory_id")).over(run))
    day = T.event_day(F.col("event_time"))
    text = T.render(F.col("question"), F.col("answer"), day if with_day else None)
    if annotate is not None:
        text = annotate(text, F.nullif(day, F.lit("")))
    texts = blocks.select(F.col("id").alias("memory_id"), text.alias("text"), "event_time")
    members = F.sort_array(F.collect_list(F.struct("local_index", "memory_id", "text", "event_time")))
    merged = rows.join(texts, "memory_id").groupBy(*chain, "run").agg(members.alias("m"), F.first("anchor").alias("anchor"), F.count("rank").alias("rerank_member_count"))
    is_anchor = lambda x: x["memory_id"] == F.col("anchor.memory_id")
    lead = F.filter("m", is_anchor)
    ordered = {"keep": F.col("m"), "front": F.concat(lead, F.filter("m", lambda x: ~is_anchor(x))), "echo": F.concat(lead, F.col("m"))}[placement]
    content = T.strip(F.array_join(F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t != ""), "\n"))
    out = merged.select(
        "query_id", F.transform("m", lambda x: x["memory_id"]).alias("source_memory_ids"), "user_id", "session_id", "request_id",
        F.get("m", F.lit(0))["local_index"].alias("start_local_index"), F.element_at("m", -1)["local_index"].alias("end_local_index"),
        F.col("anchor.memory_id").alias("anchor_memory_id"), F.col("anchor.rank").alias("best_rank"),
        F.get(lead, F.lit(0))["event_time"].alias("anchor_event_time"), content.alias("content"), "rerank_member_count",
    )
    return out.withColumn("token_count", T.token_count(F.col("content")) if count is None else count)


def limited(rows: DataFrame, top_k: int | DataFrame) -> tuple[DataFrame, Column]:
    """Rows with the limit of their query: one number, or a table (query_id, top_k)."""
    if isinstance(top_k, int):
        return rows, F.lit(top_k)
    return rows.join(top_k.select("query_id", F.col("top_k").alias("_top_k")), "query_id"), F.col("_top_k")


def package(segments: DataFrame, top_k: int | DataFrame, max_tokens: int = MAX_TOKENS, separator_tokens: int = 0) -> DataFrame:
    """Response items: of the first top_k segments of each query the longest prefix that fits the token budget."""
    order = Window.partitionBy("query_id").orderBy("best_rank", "anchor_memory_id")
    rows, most = limited(segments, top_k)
    rows = rows.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < most)
    used = F.sum(F.col("token_count") + F.when(F.col("position") > 0, separator_tokens).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("used", used).where(F.col("used") <= max_tokens)
    return rows.select("query_id", "position", F.col("anchor_memory_id").alias("id"), "content", T.event_day(F.col("anchor_event_time")).alias("created_at"), (1 / (F.col("position") + 1.0)).alias("score"), "token_count")


def package_summary(segments: DataFrame, items: DataFrame, top_k: int | DataFrame, separator_tokens: int = 0) -> DataFrame:
    """Per query: considered segments, both truncation flags and output tokens."""
    all_ = segments.groupBy("query_id").agg(F.count("*").alias("considered_segments"))
    got = items.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    n = F.coalesce("n", F.lit(0))
    all_, most = limited(all_, top_k)
    return all_.join(got, "query_id", "left").select(
        "query_id", "considered_segments", (F.col("considered_segments") > most).alias("truncated_by_top_k"),
        (n < F.least("considered_segments", most)).alias("truncated_by_budget"),
        (F.coalesce("t", F.lit(0)) + separator_tokens * F.greatest(n - 1, F.lit(0))).alias("output_tokens"),
    )
