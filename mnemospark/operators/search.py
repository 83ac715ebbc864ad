"""The whole search of many queries at once: route, retrieve, rerank, expand, merge, package, append facts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import facts as facts_of
from mnemospark.operators import embed, rank, retrieval

Save = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Options:
    """What a search is set up with; the limits are those of the reference's default profile."""

    prefetch: int = retrieval.ARM_LIMIT
    weights: tuple[float, float] = (0.5, 0.5)
    seed_limit: int = 1000
    radius: int = 2
    placement: str = "keep"
    with_day: bool = False
    annotate: Callable | None = None  # of columns (text, day), e.g. dates.annotate_relative_dates
    max_tokens: int = rank.MAX_TOKENS


@dataclass
class Memory:
    """The tables that a search reads; vectors, facts and names may be missing."""

    blocks: DataFrame
    lexical: retrieval.Bm25Index
    vectors: DataFrame | None = None  # (memory_id, user_id, dense)
    facts: DataFrame | None = None
    texts: DataFrame = field(init=False)

    def __post_init__(self):
        self.texts = self.blocks.select(F.col("id").alias("memory_id"), T.render(F.col("question"), F.col("answer")).alias("text"))


def retrieve(queries: DataFrame, memory: Memory, options: Options) -> DataFrame:
    """(query_id, memory_id, rank) by both arms, or by the lexical one where there are no vectors."""
    if memory.vectors is not None and "dense" in queries.columns:
        return retrieval.hybrid_search(queries, memory.lexical, memory.vectors, options.prefetch, options.weights).select("query_id", "memory_id", "rank")
    asked = queries.where(~T.is_blank(F.col("query")) & (F.col("top_k") > 0))
    found = retrieval.bm25_topk(asked, memory.lexical, options.prefetch)
    return found.join(asked.select("query_id", "top_k"), "query_id").where(F.col("rank") < F.col("top_k")).select("query_id", "memory_id", "rank")


def retrieve_isolated(queries: DataFrame, memory: Memory, options: Options, encode, save: Save) -> DataFrame:
    """retrieve() of queries (query_id, user_id, query, top_k) that are embedded first: (query_id, memory_id, rank, error). A query that can't be embedded
    has one row with its error, and the others their results."""
    made = save(embed.embed_queries(queries, encode), "query-vectors")
    found = retrieve(made.where("error is null").drop("error"), memory, options).withColumn("error", F.lit(None).cast("string"))
    none = made.where("error is not null").select("query_id", F.lit(None).cast("string").alias("memory_id"), F.lit(None).cast("int").alias("rank"), "error")
    return found.unionByName(none)


def search(
    queries: DataFrame,
    memory: Memory,
    save: Save,
    options: Options = Options(),
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    routes: DataFrame | None = None,
    multi_hop: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    entities: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(items, observations) of every query.

    queries: (query_id, user_id, query, top_k, perhaps dense, perhaps error); blank queries and those with top_k of 0 or less have no rows, those
    with an error (embed.embed_queries) no items but an observation with it.
    rerank: (candidates, queries) to scores as rank.apply_rerank() takes them, e.g. rank.score_pairs with a model.
    routes: (query_id, route); queries with MULTI_HOP go to multi_hop, which gives (candidates, stops) as those of operators.multihop, and are
    reranked by the query that stops name; where it finds nothing, and without it, they are searched like the others.
    entities: (query_id, entities): names whose facts fill what room is left up to top_k.
    save: writes a table once and reads it back; ranked candidates, frontiers and segments are used more than once.

    items: (query_id, position, id, content, created_at, score). observations: per query the route, the rerank's status,
    the counts of expansion and packaging, and the facts appended.
    """
    asked = save(queries.where(~T.is_blank(F.col("query")) & (F.col("top_k") > 0)), "asked")
    lost = None
    if "error" in asked.columns:
        lost = asked.where("error is not null").select("query_id", "error")
        asked = asked.where("error is null").drop("error")
    names = asked.select("query_id", "user_id", "query", "top_k")
    route = F.lit("DEFAULT")
    hopped = stops = None
    if routes is not None:
        names = save(names.join(routes.select("query_id", "route"), "query_id", "left").withColumn("route", F.coalesce("route", route)), "routes")
        route = F.col("route")
        if multi_hop is not None:
            hopped, stops = multi_hop(names.where("route = 'MULTI_HOP'"))
            hopped = save(hopped.select("query_id", "memory_id", "rank"), "hopped")
    plain = asked if hopped is None else asked.join(hopped.select("query_id").distinct(), "query_id", "left_anti")
    found = retrieve(plain, memory, options)
    candidates = save(retrieval.dedup_candidates(found if hopped is None else found.unionByName(hopped)), "candidates")

    by = names.select("query_id", "query")
    if stops is not None and "rerank_query" in stops.columns:
        by = by.join(stops.select("query_id", "rerank_query"), "query_id", "left").select("query_id", F.coalesce("rerank_query", "query").alias("query"))
    ranked = save(rank.apply_rerank(candidates, None if rerank is None else rerank(candidates, by)), "ranked")
    selected = save(rank.expand_neighbors(ranked.select("query_id", "memory_id", "rank"), memory.blocks, options.seed_limit, options.radius, save), "expanded")
    segments = save(rank.merge_segments(selected, memory.blocks, options.placement, options.with_day, annotate=options.annotate), "segments")
    packed = save(rank.package(segments, names, options.max_tokens), "items")
    items = packed.select("query_id", "position", "id", "content", "created_at", "score")
    added = None
    if memory.facts is not None and entities is not None:
        taken = packed.groupBy("query_id").agg(F.count("*").alias("n"))
        room = names.join(taken, "query_id", "left").select("query_id", "user_id", (F.col("top_k") - F.coalesce("n", F.lit(0))).cast("int").alias("limit")).where(F.col("limit") > 0)
        wanted = save(room.join(entities.select("query_id", "entities"), "query_id"), "wanted")
        known = facts_of.facts_for_entities(wanted, memory.facts, memory.blocks, save=save)
        shown = facts_of.rebind_owner(known, facts_of.owner_names(memory.facts))
        items = facts_of.append_facts(items, facts_of.fact_snippets(shown, 1 << 30), names)
        added = items.where(F.col("id").startswith("fact:")).groupBy("query_id").agg(F.count("*").alias("fact_snippets"))

    status = ranked.groupBy("query_id").agg(F.max("status").alias("rerank_status"))
    seen = names.select("query_id", route.alias("route")).join(status, "query_id", "left")
    for counts in (rank.expansion_counts(selected), rank.package_summary(segments, packed, names), added):
        seen = seen if counts is None else seen.join(counts, "query_id", "left")
    if stops is not None:
        seen = seen.join(stops.select("query_id", "stop_reason"), "query_id", "left")
    seen = seen.withColumn("rerank_status", F.coalesce("rerank_status", F.lit("disabled")))
    return items, seen if lost is None else seen.withColumn("error", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)
