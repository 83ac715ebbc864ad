"""Routing and multi-hop search as batch jobs over tables of model replies or callables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import helpers as H
from mnemospark.functions import replies as R
from mnemospark.functions import text as T
from mnemospark.operators.rank import apply_rerank

MAX_ROUNDS, PER_ROUND, SUFFICIENT = 4, 20, 0.8
RECOVERY_REASONS = ("dependency_unresolved", "binding_conflict", "invalid_output", "llm_unavailable", "plan_invalid")


def parse_routes(replies: DataFrame, reply: str = "reply", error: str = "error") -> DataFrame:
    """Replies with route, route_status and reason. No reply and no error: no model; an error keeps its name."""
    word = F.upper(T.strip(F.col(reply)))
    known = word.isin("MULTI_HOP", "DEFAULT")
    reason = F.when(F.col(error).isNotNull(), F.concat(F.lit("llm_"), error)).when(F.col(reply).isNull(), "model_none").when(~known, "invalid_output")
    return replies.withColumn("reason", reason).withColumn("route", F.when(F.col("reason").isNull(), word).otherwise("DEFAULT")).withColumn("route_status", F.when(F.col("reason").isNull(), "success").otherwise("degraded"))


def extract_json_object(replies: DataFrame, reply: str = "reply") -> DataFrame:
    return replies.withColumn("x", R.extracted_object(F.col(reply))).select("*", "x.json", "x.extraction").drop("x")


def parse_plans(replies: DataFrame, max_steps: int = 4, reply: str = "reply") -> DataFrame:
    """One row a step (or one with nulls for an invalid plan): query_id, plan_status, step_no and the step's fields."""
    rows = replies.withColumn("x", R.plan(F.col(reply), max_steps))
    return rows.select("query_id", F.col("x.status").alias("plan_status"), "x.extraction", F.posexplode_outer("x.steps").alias("step_no", "s")).select("query_id", "plan_status", "extraction", "step_no", "s.*")


def bind_placeholders(steps: DataFrame, answers: str = "answers", query: str = "query", max_steps: int = 4) -> DataFrame:
    """Steps with `executed_query` and `unbound`: {{sK}} slots filled from a map of answers in one pass.

    The query is cut at its slots, so braces inside answers are never read as slots.
    """
    slot = r"\{\{(s[0-9]+)\}\}"
    names = F.regexp_extract_all(F.col(query), F.lit(slot), F.lit(1))
    bound = steps.withColumn("_names", names).withColumn("_parts", F.split(query, slot, -1))
    value = lambda n: F.coalesce(F.try_element_at(F.col(answers), n), F.concat(F.lit("{{"), n, F.lit("}}")))
    pieces = F.zip_with("_parts", "_names", lambda part, n: F.concat(part, F.when(n.isNull(), "").otherwise(value(n))))
    unbound = F.array_distinct(F.filter("_names", lambda n: F.try_element_at(F.col(answers), n).isNull()))
    return bound.withColumns({"executed_query": F.array_join(pieces, ""), "unbound": unbound}).drop("_names", "_parts")


def parse_step_answers(replies: DataFrame, reply: str = "reply", documents: str = "documents") -> DataFrame:
    rows = replies.withColumn("x", R.step_answer(F.col(reply), F.col(documents)))
    return rows.select("*", "x.*").drop("x", documents, reply)


def parse_react_decisions(replies: DataFrame, reply: str = "reply", n_documents: str = "n_documents") -> DataFrame:
    rows = replies.withColumn("x", R.react_decision(F.col(reply), F.col(n_documents)))
    return rows.select("*", "x.*").drop("x", reply)


def round_pool(rounds: DataFrame, per_round: int = PER_ROUND) -> DataFrame:
    """(query_id, memory_id, rank): the first `per_round` of every round (query_id, round, memory_id, position), first seen first."""
    first = rounds.where(F.col("position") < per_round).groupBy("query_id", "memory_id").agg(F.min(F.struct("round", "position")).alias("at"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "memory_id")) - 1
    return first.select("query_id", "memory_id", n.alias("rank"))


def joint_queries(executed: DataFrame) -> DataFrame:
    """(query_id, query): the executed queries of all rounds, one a line."""
    rows = F.sort_array(F.collect_list(F.struct("round", "query")))
    return executed.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["query"]), "\n").alias("query"))


def cited_evidence(cited: DataFrame) -> DataFrame:
    """(query_id, evidence): distinct cited memories (query_id, round, position, memory_id) in first-cited order."""
    first = cited.groupBy("query_id", "memory_id").agg(F.min(F.struct("round", "position")).alias("at"))
    return first.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "memory_id"))), lambda x: x["memory_id"]).alias("evidence"))


def normal_query(query: Column) -> Column:
    """How queries are compared: case-folded, white space collapsed. ASCII stays in the JVM."""
    plain = T.collapse(query)
    return F.when(plain.rlike(r"^[\x00-\x7f]*$"), F.lower(plain)).otherwise(H.folded(plain))


def fault_of(error: Column) -> Column:
    """The stop reason of a failed call: the search failed (error `retrieval`), the model was not there, or it failed. Null without an error."""
    return F.when(error == "retrieval", "retrieval_error").when(error == "unavailable", "llm_unavailable").when(error.isNotNull(), "llm_error")


def react_stop(decisions: DataFrame, max_rounds: int = MAX_ROUNDS, sufficient: float = SUFFICIENT) -> DataFrame:
    """Decisions (round, is_sufficient, confidence_score, new_query, used: normalised queries so far) with `stop_reason`,
    null to go on."""
    query = T.strip(F.col("new_query"))
    blank, again = query == "", F.array_contains("used", normal_query(query))
    reason = (
        F.when(F.col("is_sufficient") & (F.col("confidence_score") >= sufficient), "sufficient")
        .when((blank | again) & F.col("is_sufficient"), "low_confidence")
        .when(blank, "empty_query").when(again, "duplicate_query")
        .when(F.col("round") >= max_rounds, "max_rounds")
    )
    return decisions.withColumn("stop_reason", reason)


def plan_stop(steps: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(query_id, stop_reason) of executed plans.

    steps: (query_id, plan_status, step_no from 0, unbound, valid, status, perhaps error). The first step that cannot be used
    decides, by a failed model call before anything else; a plan cut at max_rounds, all steps answered, ends as max_rounds.
    """
    ran = steps.where(F.coalesce("step_no", F.lit(0)) < max_rounds)
    failed = fault_of(F.col("error")) if "error" in steps.columns else F.lit(None).cast("string")
    fault = (
        F.when(failed.isNotNull(), failed)
        .when(F.col("plan_status") != "valid", "plan_invalid")
        .when(F.size("unbound") > 0, "unbound_placeholder")
        .when(~F.coalesce("valid", F.lit(False)), "invalid_output")
        .when(F.col("status") == "unresolved", "dependency_unresolved")
        .when(F.col("status") == "conflict", "binding_conflict")
    )
    first = ran.withColumn("fault", fault).groupBy("query_id").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("step_no", "fault"))).alias("x"))
    n = steps.groupBy("query_id").agg(F.count("*").alias("n"))
    end = F.when(F.col("n") > max_rounds, "max_rounds").otherwise("plan_complete")
    return first.join(n, "query_id").select("query_id", F.coalesce("x.fault", end).alias("stop_reason"))


def recovery_fill(pool: DataFrame, stops: DataFrame, found: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
    """(pool, statuses): after a stop that calls for recovery, plain search results of the original query fill the pool to top_k.

    pool and found: (query_id, memory_id, rank).
    """
    size = stops.select("query_id", "stop_reason").join(pool.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    calls = size.where(F.col("stop_reason").isin(*RECOVERY_REASONS))
    fresh = found.join(pool.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti").join(calls.where(F.col("n") < top_k), "query_id")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1 + F.col("n")
    added = fresh.withColumn("rank", at).where(F.col("rank") < top_k).select("query_id", "memory_id", F.col("rank").cast("int").alias("rank"))
    got = added.groupBy("query_id").agg(F.count("*").alias("added"))
    status = F.when(~F.col("stop_reason").isin(*RECOVERY_REASONS), "not_triggered").when(F.col("n") >= top_k, "skipped_pool_full").when(F.col("added") > 0, "success").otherwise("empty")
    return pool.select("query_id", "memory_id", F.col("rank").cast("int").alias("rank")).unionByName(added), size.join(got, "query_id", "left").select("query_id", "stop_reason", status.alias("recovery"))


def render_documents(rounds: DataFrame, order: tuple[str, ...] = ("position",)) -> DataFrame:
    """(query_id, round, documents, ids): numbered documents of a round (query_id, round, memory_id, day, body, …order).

    Memories without a body are left out. For decisions after earlier rounds order by ('selected_before', 'position').
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, "memory_id", "day", "body")))
    head = lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("]"), F.when(F.coalesce(x["day"], F.lit("")) != "", F.concat(F.lit(" Time: "), x["day"])).otherwise(""))
    grouped = rounds.where("body is not null").groupBy("query_id", "round").agg(rows.alias("r"))
    return grouped.select("query_id", "round", F.transform("r", lambda x, i: F.concat(head(x, i), F.lit("\n"), x["body"])).alias("documents"), F.transform("r", lambda x: x["memory_id"]).alias("ids"))


def render_plan(steps: DataFrame) -> DataFrame:
    """(query_id, plan): one line a step, with what it depends on."""
    after = F.when(F.size("depends_on") > 0, F.concat(F.lit("  (depends on "), F.array_join("depends_on", ", "), F.lit(")"))).otherwise("")
    lines = F.sort_array(F.collect_list(F.struct("step_no", F.concat("id", F.lit(": "), "query", after).alias("line"))))
    return steps.where("id is not null").groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("plan"))


def completed_history(steps: DataFrame) -> DataFrame:
    """(query_id, history): question, answer and sources of answered steps (step_no, id, executed_query, answer, sources)."""
    sources = F.coalesce(F.nullif(F.array_join("sources", ", "), F.lit("")), F.lit("(none)"))
    block = F.concat("id", F.lit(" question: "), "executed_query", F.lit("\n"), "id", F.lit(" answer: "), "answer", F.lit("\n"), "id", F.lit(" sources: "), sources)
    rows = F.sort_array(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("step_no", block.alias("block")))))
    return steps.groupBy("query_id").agg(F.coalesce(F.nullif(F.array_join(F.transform(rows, lambda x: x["block"]), "\n\n"), F.lit("")), F.lit("(none yet)")).alias("history"))


Save = Callable[[DataFrame, str], DataFrame]
Search = Callable[[DataFrame], DataFrame]


def _with_error(replies: DataFrame) -> DataFrame:
    """Replies with their `error`; a reply that is not there means that there was no model."""
    error = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    return replies.withColumn("error", F.when(error.isNotNull(), error).when(F.col("reply").isNull(), "unavailable"))


def _round_hits(ready: DataFrame, search: Search, rerank, per_round: int, save: Save, n: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, round, memory_id, position), the best of a round's results, reranked by the round's query where there is a scorer; and
    the (query_id) whose search failed: those with a row that has an `error`, where search gives that column."""
    asked = ready.select("query_id", "user_id", F.col("executed_query").alias("query"))
    hits = search(asked)
    failed = ready.select("query_id").limit(0)
    if "error" in hits.columns:
        hits = save(hits.select("query_id", "memory_id", "rank", "error"), f"searched-{n}")
        failed = hits.where("error is not null").select("query_id").distinct()
        hits = hits.join(failed, "query_id", "left_anti")
    hits = hits.select("query_id", "memory_id", "rank")
    if rerank is not None:
        hits = save(hits, f"found-{n}")
        hits = apply_rerank(hits, rerank(hits, asked))
    return save(hits.where(F.col("rank") < per_round).select("query_id", F.lit(n).alias("round"), "memory_id", F.col("rank").cast("int").alias("position")), f"hits-{n}"), failed


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def multi_hop_search(
    queries: DataFrame,
    search: Search,
    plan_replies: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    bodies: DataFrame,
    save: Save,
    top_k: int = PER_ROUND,
    max_rounds: int = MAX_ROUNDS,
    per_round: int = PER_ROUND,
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, stops): all planned queries advance one step a round together; failed plans fall back to plain search.

    queries: (query_id, user_id, query); search: such rows to (query_id, memory_id, rank); plan_replies: (query_id, reply,
    perhaps error), a query without one has no model; answer: (query_id, round, executed_query, documents, ids) to the same
    with `reply` and perhaps `error`; bodies: (memory_id, day, body); save: writes a table once and reads it back, which cuts
    the lineage of each round; rerank: (candidates, queries) to scores as apply_rerank() takes them, used in each round by its query.
    stops: (query_id, stop_reason, recovery, rerank_query): the queries that ran, joined, for a last rerank of the pool (the
    original where it was filled by recovery). A search may give rows with an `error` in place of results: then only their queries stop, with
    retrieval_error and what they had found before; with nothing found they are left to the plain search of search().
    """
    asked_plans = queries.select("query_id").join(plan_replies, "query_id", "left")
    failures = _with_error(asked_plans).select("query_id", "error")
    steps = save(parse_plans(asked_plans.select("query_id", "reply"), max_rounds).join(failures, "query_id"), "plans")
    answers = steps.select("query_id").distinct().withColumn("answers", F.create_map().cast("map<string,string>"))
    active = steps.where("plan_status = 'valid' and error is null").select("query_id").distinct()
    pool, records, executed = [], [], []
    for n in range(max_rounds):
        now = bind_placeholders(steps.where(F.col("step_no") == n).drop("error").join(active, "query_id", "left_semi").join(answers, "query_id"))
        ready = save(now.where(F.size("unbound") == 0).join(queries.select("query_id", "user_id"), "query_id"), f"ready-{n}")
        got, failed = _round_hits(ready, search, rerank, per_round, save, n)
        pool.append(got)
        executed.append(ready.select("query_id", F.lit(n).alias("round"), F.col("executed_query").alias("query")))
        shown = render_documents(got.join(bodies, "memory_id"))
        asked = ready.select("query_id", "id", "executed_query").join(failed, "query_id", "left_anti").join(shown, "query_id", "left").withColumn("round", F.lit(n))
        replied = _with_error(answer(asked.withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))))
        judged = parse_step_answers(replied)
        record = now.select("query_id", "plan_status", "step_no", "unbound").join(judged.select("query_id", "valid", "status", "answer", "id", "error"), "query_id", "left")
        record = record.join(failed.withColumn("lost", F.lit("retrieval")), "query_id", "left").withColumn("error", F.coalesce("lost", "error")).drop("lost")
        record = save(record, f"round-{n}")
        records.append(record)
        done = record.where("valid and status = 'answered' and error is null")
        new = done.select("query_id", F.create_map("id", "answer").alias("new"))
        answers = save(answers.join(new, "query_id", "left").select("query_id", F.map_concat("answers", F.coalesce("new", F.create_map().cast("map<string,string>"))).alias("answers")), f"answers-{n}")
        active = done.select("query_id")
        if active.isEmpty():
            break
    no_text, columns = F.lit(None).cast("string"), ["query_id", "plan_status", "step_no", "unbound", "valid", "status", "error"]
    broken = steps.where("plan_status <> 'valid' or error is not null").groupBy("query_id").agg(F.first("plan_status").alias("plan_status"), F.first("error").alias("error"))
    broken = broken.withColumns({"step_no": F.lit(0), "unbound": F.array().cast("array<string>"), "valid": F.lit(None).cast("boolean"), "status": no_text})
    ran = _union(records).select(*columns)
    stops = save(plan_stop(ran.unionByName(broken.select(*columns)), max_rounds), "stops")
    merged = save(round_pool(_union(pool), per_round), "pool")
    plain = search(queries.select("query_id", "user_id", "query"))
    plain = plain.where("error is null").drop("error") if "error" in plain.columns else plain
    filled, statuses = recovery_fill(merged, stops, plain, top_k)
    joint = joint_queries(_union(executed)).withColumnRenamed("query", "joint")
    statuses = statuses.join(joint, "query_id", "left").join(queries.select("query_id", "query"), "query_id")
    own = F.col("recovery") == "success"
    return filled.where(F.col("rank") < top_k), statuses.select("query_id", "stop_reason", "recovery", F.when(own, F.col("query")).otherwise(F.coalesce("joint", "query")).alias("rerank_query"))


def react_search(
    queries: DataFrame,
    search: Search,
    decide: Callable[[DataFrame], DataFrame],
    bodies: DataFrame,
    save: Save,
    max_rounds: int = MAX_ROUNDS,
    per_round: int = PER_ROUND,
    sufficient: float = SUFFICIENT,
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, stops): search, show the documents, and search again by the query that the model asks for.

    All queries that go on advance one round together. decide: (query_id, round, query, executed_query, used_queries, documents,
    ids) to the same with `reply` and perhaps `error`; documents are the round's new ones, then those picked before. The other
    arguments are those of multi_hop_search(). stops: (query_id, stop_reason, rounds, rerank_query, evidence): the last round's
    reason, all executed queries joined, the picked memories in the order they were first picked.
    """
    state = queries.select("query_id", "user_id", "query", F.col("query").alias("executed_query"), F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("asked_before"))
    pool, executed, picks, records = [], [], [], []
    for n in range(max_rounds):
        now = state.withColumns({"used": F.array_append("used", normal_query(F.col("executed_query"))), "asked_before": F.array_append("asked_before", F.col("executed_query"))})
        now = save(now, f"asked-{n}")
        got, failed = _round_hits(now, search, rerank, per_round, save, n)
        pool.append(got)
        executed.append(now.select("query_id", F.lit(n).alias("round"), F.col("executed_query").alias("query")))
        rows = got.select("query_id", "round", "memory_id", "position", F.lit(0).alias("selected_before"))
        if picks:
            first = _union(picks).groupBy("query_id", "memory_id").agg(F.min(F.struct("round", "position")).alias("at"))
            place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "memory_id")) - 1
            kept = first.select("query_id", F.lit(n).alias("round"), "memory_id", place.cast("int").alias("position"), F.lit(1).alias("selected_before"))
            kept = kept.join(now.select("query_id"), "query_id", "left_semi").join(got.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
            rows = rows.unionByName(kept)
        shown = render_documents(rows.join(bodies, "memory_id"), ("selected_before", "position")).drop("round")
        none = F.array().cast("array<string>")
        asked = now.join(failed, "query_id", "left_anti")
        asked = asked.select("query_id", F.lit(n).alias("round"), "query", "executed_query", F.col("asked_before").alias("used_queries"), "used").join(shown, "query_id", "left")
        asked = asked.withColumns({"documents": F.coalesce("documents", none), "ids": F.coalesce("ids", none)})
        replied = _with_error(decide(asked)).withColumn("n_documents", F.size("ids"))
        judged = react_stop(parse_react_decisions(replied).withColumn("round", F.col("round") + 1), max_rounds, sufficient)
        reason = F.coalesce(fault_of(F.col("error")), F.when(~F.coalesce("valid", F.lit(False)), "invalid_output"), F.col("stop_reason"))
        record = judged.select("query_id", (F.col("round") - 1).alias("round"), "ids", "evidence_indices", T.strip(F.col("new_query")).alias("new_query"), reason.alias("stop_reason"))
        lost = failed.select("query_id", F.lit(n).alias("round"), none.alias("ids"), F.lit(None).cast("array<int>").alias("evidence_indices"), F.lit(None).cast("string").alias("new_query"), F.lit("retrieval_error").alias("stop_reason"))
        record = save(record.unionByName(lost), f"round-{n}")
        records.append(record)
        places = record.where("evidence_indices is not null").select("query_id", "round", "ids", F.posexplode("evidence_indices").alias("position", "i"))
        picks.append(places.select("query_id", "round", "position", F.get("ids", F.col("i")).alias("memory_id")))
        on = record.where("stop_reason is null").select("query_id", "new_query")
        state = now.join(on, "query_id").withColumn("executed_query", F.col("new_query")).drop("new_query")
        if on.isEmpty():
            break
    last = _union([r.select("query_id", "round", "stop_reason") for r in records]).where("stop_reason is not null")
    stops = queries.select("query_id").join(last, "query_id", "left").join(joint_queries(_union(executed)), "query_id", "left").join(cited_evidence(_union(picks)), "query_id", "left")
    stops = stops.select("query_id", "stop_reason", (F.col("round") + 1).alias("rounds"), F.col("query").alias("rerank_query"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
    return save(round_pool(_union(pool), per_round), "pool"), save(stops, "stops")
