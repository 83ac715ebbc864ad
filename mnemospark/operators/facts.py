"""Facts: extraction records, gate, fact rows, storage rules, and governance at read time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import helpers as H
from mnemospark.functions import replies as R
from mnemospark.functions import text as T
from mnemospark.operators.rank import limited
from mnemospark.operators.tables import upsert

VERSION = "facts-v1"
GATE = 3
QUOTATION = "\nSource quotation:"


# ---------------------------------------------------------------- from blocks to facts


def extraction_records(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """One record a source message; a block without any falls back to its question (0, user) and answer (1, assistant)."""
    own = blocks.select(F.col("id").alias("parent_memory_id"), "user_id", "request_id", "local_index", "question", "answer", "event_time")
    keys = own.select("parent_memory_id", "user_id", "request_id", "local_index")
    stored = keys.join(messages.select("parent_memory_id", "source_index", "role", "content", "timestamp"), "parent_memory_id")
    lone = own.join(messages.select("parent_memory_id"), "parent_memory_id", "left_anti")
    side = lambda i, role, text: F.struct(F.lit(i).alias("source_index"), F.lit(role).alias("role"), F.col(text).alias("content"))
    fallback = lone.select("parent_memory_id", "user_id", "request_id", "local_index", F.col("event_time").alias("timestamp"), F.inline(F.array(side(0, "user", "question"), side(1, "assistant", "answer"))))
    rows = stored.unionByName(fallback.where("content is not null"))
    return rows.withColumn("side", F.when(F.col("role") == "user", "question").otherwise("answer"))


def lexicon_score(records: DataFrame, terms: list[str], threshold: int = GATE) -> DataFrame:
    """Records with the lexicon `terms` they hold, their number and whether they are admitted to the model.

    The lexicon, a table of a few thousand terms at most, is a parameter; one matcher a worker finds all of them in one pass.
    """
    scored = records.withColumn("terms", H.lexicon_terms(F.col("content"), terms))
    return scored.withColumn("n_terms", F.size("terms").cast("long")).withColumn("admitted", F.col("n_terms") >= threshold)


def domain_profile(scored: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(domain, records, hits): how a corpus is covered by the domains of a lexicon (term, domain)."""
    hits = scored.select("parent_memory_id", "source_index", F.explode("terms").alias("term")).join(lexicon.select("term", "domain").distinct(), "term")
    one = hits.groupBy("domain", "parent_memory_id", "source_index").agg(F.count("*").alias("n"))
    return one.groupBy("domain").agg(F.count("*").alias("records"), F.sum("n").alias("hits"))


def parse_fact_replies(records: DataFrame, reply: str = "reply") -> DataFrame:
    """One row a fact found in the reply of each record; bad replies give none."""
    items = records.withColumn("items", R.fact_items(F.col(reply), F.col("content")))
    return items.select("*", F.posexplode("items").alias("item", "x")).select("*", "x.*").drop("items", "x", reply)


def make_facts(parsed: DataFrame, version: str = VERSION) -> DataFrame:
    """Fact rows. The number in a fact's position counts the facts of its whole request, ordered by block, message and item."""
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("local_index", "source_index", "item")) - 1
    rows = parsed.withColumn("position", F.concat_ws(":", F.lit("model"), "source_index", n, "relation", "object"))
    day = T.event_day(F.col("timestamp"))
    statement = F.concat("subject", F.lit(" — "), "relation", F.lit(" — "), "object", F.lit("."))
    return rows.select(
        T.identity(F.lit(version), F.col("user_id"), F.col("parent_memory_id"), F.col("side"), F.col("position")).alias("id"),
        "parent_memory_id", "user_id", "subject", H.fact_key(F.col("subject")).alias("subject_key"),
        "relation", H.relation_key(F.col("relation")).alias("relation_key"), "object", H.fact_key(F.col("object")).alias("object_key"),
        F.create_map(F.lit("projection"), F.lit("fact"), F.lit("supersedes"), F.col("supersedes").cast("string")).alias("qualifiers"),
        F.col("side").alias("source_side"), F.col("quote").alias("source_quote"), statement.alias("statement"),
        T.render_evidence(statement, day, F.col("quote"), F.lit(False)).alias("content"),
        F.col("timestamp").alias("event_time"), day.alias("source_date"), "supersedes", F.lit(version).alias("version"),
    )


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(T.strip(value)).isin("true", "yes", "1"), F.lit(False))


def insert_facts(facts: DataFrame, blocks: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table after, rejected with `reason`): the parent must exist with the same user, the side be known, quotes not empty."""
    parents = blocks.select(F.col("id").alias("parent_memory_id"), F.col("user_id").alias("_owner"))
    reason = (
        F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("user_id")), "parent")
        .when(~F.coalesce(F.col("source_side").isin("question", "answer"), F.lit(False)), "side")
        .when(F.coalesce("source_quote", F.lit("")) == "", "quote")
        .when(F.try_element_at("qualifiers", F.lit("item_quote")) == "", "item_quote")
    )
    marked = facts.join(parents, "parent_memory_id", "left").withColumn("reason", reason).drop("_owner")
    matched = F.try_element_at("qualifiers", F.lit("match_object"))
    good = marked.where("reason is null").select(*existing.columns).withColumns({
        "subject_key": H.fact_key(F.col("subject")), "relation_key": H.relation_key(F.col("relation")),
        "object_key": H.fact_key(F.coalesce(matched, F.col("object"))), "supersedes": truthy(F.try_element_at("qualifiers", F.lit("supersedes"))),
    })
    return upsert(existing, good, ["id"], "ignore", ["parent_memory_id", "content"]), marked.where("reason is not null")


# ---------------------------------------------------------------- coverage


def unindexed_blocks(blocks: DataFrame, coverage: DataFrame, version: str = VERSION, limit: int | None = None) -> DataFrame:
    """Blocks without a coverage row of that version and user; with a limit the first ones by id."""
    done = coverage.where(F.col("version") == version).select(F.col("parent_memory_id").alias("id"), "user_id")
    left = blocks.join(done, ["id", "user_id"], "left_anti")
    return left if limit is None else left.orderBy("id").limit(limit)


def mark_coverage(coverage: DataFrame, facts: DataFrame, blocks: DataFrame, version: str = VERSION) -> DataFrame:
    """Coverage with the blocks that yielded a fact; a block's user must be the fact's."""
    done = facts.select(F.col("parent_memory_id").alias("id"), "user_id").distinct().join(blocks.select("id", "user_id"), ["id", "user_id"], "left_semi")
    return upsert(coverage, done.select(F.col("id").alias("parent_memory_id"), "user_id", F.lit(version).alias("version")), ["parent_memory_id", "version"])


def has_coverage(coverage: DataFrame, memory_id: str, version: str = VERSION) -> bool:
    return not coverage.where((F.col("parent_memory_id") == memory_id) & (F.col("version") == version)).isEmpty()


# ---------------------------------------------------------------- governance


def fact_order() -> list[Column]:
    return [F.col("event_time").isNull(), F.col("event_time"), F.col("parent_memory_id"), F.col("id")]


def apply_supersession(facts: DataFrame, group: tuple[str, ...] = ("user_id", "subject_key", "relation_key")) -> DataFrame:
    """Current facts: with a latest timed update in a group, what has no time, and what is not older and agrees with it.

    Two small aggregates (the cutoff of each group, the objects current at it) are joined back, so a group too large for one
    task is no trouble.
    """
    keys = list(group)
    updates = facts.where("supersedes and event_time is not null").groupBy(*keys, "object_key").agg(F.max("event_time").alias("at"))
    cutoff = updates.groupBy(*keys).agg(F.max("at").alias("cutoff"))
    current = updates.join(cutoff, keys).where("at = cutoff").select(*keys, "object_key", F.lit(True).alias("current"))
    marked = facts.join(cutoff, keys, "left").join(current, [*keys, "object_key"], "left")
    keep = F.col("cutoff").isNull() | F.col("event_time").isNull() | ((F.col("event_time") >= F.col("cutoff")) & F.col("current"))
    return marked.where(keep).select(*facts.columns)


def owner_names(facts: DataFrame, version: str = VERSION) -> DataFrame:
    """(user_id, owner, owner_key): the subject of each user's first `name` fact by date and id."""
    named = facts.where((F.col("relation_key") == "name") & (F.col("version") == version))
    return named.groupBy("user_id").agg(F.min_by(F.struct("subject", "subject_key"), F.struct("source_date", "id")).alias("x")).select("user_id", F.col("x.subject").alias("owner"), F.col("x.subject_key").alias("owner_key"))


def facts_for_entities(queries: DataFrame, facts: DataFrame, blocks: DataFrame, version: str = VERSION, entities: str = "entities", save=None) -> DataFrame:
    """Current facts of the groups that a query's entities name as subject or object: (query_id, fact columns, n).

    queries: (query_id, user_id, entities, limit). The whole history of a group is judged, then the limit holds a query. Two
    equi-joins find the groups; an OR in one join would compare all with all. `save` writes the groups once, as they are used twice.
    """
    asked = queries.select("query_id", "user_id", F.explode(entities).alias("entity")).where(~T.is_blank(F.col("entity")))
    asked = asked.select("query_id", "user_id", H.fact_key(F.col("entity")).alias("key")).distinct()
    speaker = asked.where(F.col("key").isin("user", "用户")).select("query_id", "user_id", F.explode(F.array(F.lit("i"), F.lit("我"))).alias("key"))
    asked = asked.unionByName(speaker).distinct()
    known = facts.where(F.col("version") == version)
    parents = blocks.select(F.col("id").alias("parent_memory_id"), "user_id")
    # the few keys come first: only facts that have one of them meet the blocks, and only their groups are read whole
    hits = None
    for side in ("subject_key", "object_key"):
        hit = known.join(asked.withColumnRenamed("key", side), ["user_id", side]).select("query_id", "user_id", "parent_memory_id", "subject_key", "relation_key")
        hits = hit if hits is None else hits.unionByName(hit)
    groups = hits.distinct().join(parents, ["parent_memory_id", "user_id"], "left_semi").select("query_id", "user_id", "subject_key", "relation_key").distinct()
    groups = groups if save is None else save(groups, "groups")
    touched = known.join(groups.drop("query_id").distinct(), ["user_id", "subject_key", "relation_key"], "left_semi")
    found = apply_supersession(touched).join(groups, ["user_id", "subject_key", "relation_key"]).join(queries.select("query_id", "limit"), "query_id")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(*fact_order()))
    return found.withColumn("n", n).where(F.col("n") <= F.col("limit")).drop("limit")


def rebind(text: Column, owner: Column) -> Column:
    """Before the quotation the first I's, My or my as the owner's; with none of them a leading `I ` as the owner."""
    at = F.locate(QUOTATION, text)
    head = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    tail = F.when(at > 0, F.substr(text, at)).otherwise(F.lit(""))
    own = r"(?Us)^(.*?)\b(?:I['’]s|My|my)\b(.*)$"
    possessive = F.concat(F.regexp_extract(head, own, 1), owner, F.lit("'s"), F.regexp_extract(head, own, 2))
    bound = F.when(head.rlike(own), possessive).when(head.startswith("I "), F.concat(owner, F.substr(head, F.lit(2)))).otherwise(head)
    return F.when((F.coalesce(owner, F.lit("")) == "") | (F.coalesce(text, F.lit("")) == ""), text).otherwise(F.concat(bound, tail))


def rebind_owner(facts: DataFrame, owners: DataFrame) -> DataFrame:
    """Facts as shown: first-person subjects and possessives become the owner's name."""
    named = facts.join(owners.select("user_id", "owner"), "user_id", "left")
    subject = F.when((F.coalesce("owner", F.lit("")) != "") & F.col("subject_key").isin(*H.FIRST_PERSON), F.col("owner")).otherwise(F.col("subject"))
    return named.withColumns({"subject": subject, "statement": rebind(F.col("statement"), F.col("owner")), "content": rebind(F.col("content"), F.col("owner"))}).drop("owner")


# ---------------------------------------------------------------- into the response


def parse_entities(replies: DataFrame, reply: str = "reply") -> DataFrame:
    return replies.withColumn("x", R.entity_query(F.col(reply))).select("*", F.col("x.status").alias("status"), F.col("x.entities").alias("entities")).drop("x")


def fact_snippets(found: DataFrame, limit: int, order: str = "n") -> DataFrame:
    """(query_id, position, content, parent_memory_id): distinct trimmed contents in order, at most `limit` a query."""
    rows = found.select("query_id", order, T.strip(F.col("content")).alias("content"), "parent_memory_id").where("content <> ''")
    rows = rows.withColumn("k", H.fact_key(F.col("content")))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("query_id", "k").orderBy(order))).where("first = 1")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(order)) - 1
    return rows.withColumn("position", at).where(F.col("position") < limit).select("query_id", "position", "content", "parent_memory_id")


def append_facts(items: DataFrame, snippets: DataFrame, top_k: int | DataFrame) -> DataFrame:
    """Items (query_id, position, id, content, created_at, score) with new snippets after them, up to top_k in all (a number,
    or a table of query_id and top_k)."""
    taken = items.groupBy("query_id").agg(F.count("*").alias("taken"))
    fresh = snippets.join(items.select("query_id", "content"), ["query_id", "content"], "left_anti").join(taken, "query_id", "left")
    taken_n = F.coalesce("taken", F.lit(0))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("position")) - 1
    fresh, most = limited(fresh.withColumn("position", n + taken_n), top_k)
    fresh = fresh.where(F.col("position") < most)
    return items.select("query_id", "position", "id", "content", "created_at", "score").unionByName(
        fresh.select("query_id", F.col("position").cast("int").alias("position"), F.concat(F.lit("fact:"), "position").alias("id"), "content", F.lit("").alias("created_at"), F.lit(0.0).alias("score"))
    )
