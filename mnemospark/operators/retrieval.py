"""Lexical and dense arms over many queries at once, fusion, consistency. Every join carries user_id: users never mix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T

K1, B = 1.2, 0.75
ARM_LIMIT = 200
RRF_K = 61
DIGITS = 6
#: Terms of texts that a task counts at once.
SLICE_TERMS = 1 << 18
#: Bytes of index vectors in one block, and query vectors that meet it at once.
BLOCK_BYTES, QUERY_CHUNK = 4 << 20, 256
#: Queries of one user whose best results a task holds before it passes them on.
HELD_QUERIES = 4096
#: Blocks of one user's vectors that one key of the join gets.
BLOCKS_PER_SALT = 4


def best_of(rows: DataFrame, keys: list[str], k: int, score: str = "score", tie: str = "memory_id") -> DataFrame:
    """The k best rows of each group with their 0-based `rank`. The filter is on the row number itself, so that Spark cuts
    each partition to k rows a group before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie)))
    return rows.withColumn("rank", n).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


# ---------------------------------------------------------------- lexical

Save = Callable[[DataFrame, str], DataFrame]


class Bm25Index:
    """Postings (user_id, memory_id, term, tf, length, first) and the totals of their scope.

    `first` marks one posting of each memory, so that memories are counted without a distinct.
    """

    def __init__(self, postings: DataFrame, totals: DataFrame, scope: list[str]):
        self.postings, self.totals, self.scope = postings, totals, scope


def _slices(lists: pa.ListArray, most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of lists with at most `most` values together; a longer list stands alone."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, end
        begin = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (memory_id, user_id, terms) to postings, SLICE_TERMS terms at once."""
    for whole in batches:
        for begin, end in _slices(whole.column(2), SLICE_TERMS):
            batch = whole.slice(begin, end - begin)
            lists = batch.column(2)
            lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
            coded = lists.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            parent = np.repeat(np.arange(len(length)), length)
            keys, tf = np.unique(parent * size + coded.indices.to_numpy(), return_counts=True)
            row = keys // size
            first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
            columns = [batch.column(1).take(pa.array(row)), batch.column(0).take(pa.array(row)), pa.array(length[row]), coded.dictionary.take(pa.array(keys % size)), pa.array(tf.astype(np.int64)), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, ["user_id", "memory_id", "length", "term", "tf", "first"])


def bm25_index(docs: DataFrame, idf_scope: str = "corpus", stop_words: list[str] | None = None, stem=None, save: Save | None = None) -> Bm25Index:
    """docs: (memory_id, user_id, text), one row a memory. Frequencies are taken over the corpus, or per user with idf_scope='user'.

    A text is taken apart once, by a Spark expression, and its terms are counted in Arrow batches, so postings need no shuffle. `save`
    writes a table once and reads it back; without it postings are made anew for each use.
    """
    found = T.terms(F.col("text"))
    if stop_words:
        found = F.filter(found, lambda t: ~t.isin(stop_words))
    if stem is not None:
        found = F.transform(found, stem)
    rows = docs.select(F.col("memory_id").cast("string").alias("memory_id"), F.col("user_id").cast("string").alias("user_id"), found.alias("terms"))
    postings = rows.mapInArrow(_counted, "user_id string, memory_id string, length long, term string, tf long, first boolean")
    if save is not None:
        postings = save(postings, "postings")
    scope = ["user_id"] if idf_scope == "user" else []
    totals = postings.groupBy(*scope).agg(F.count_if("first").alias("n_docs"), (F.sum("tf") / F.count_if("first")).alias("mean_length"))
    return Bm25Index(postings, totals, scope)


def _with_idf(asked: DataFrame, frequencies: DataFrame, index: Bm25Index | BlockIndex) -> DataFrame:
    """asked (query_id, user_id, term) with the term's idf and the mean length of its scope."""
    asked = asked.join(frequencies, [*index.scope, "term"])
    asked = asked.join(index.totals, index.scope) if index.scope else asked.crossJoin(F.broadcast(index.totals))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return asked.select("query_id", "user_id", "term", idf.alias("idf"), "mean_length")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "user_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))


def _impact() -> Column:
    """What a posting adds to a score for each unit of its term's idf."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))


def bm25_topk(queries: DataFrame, index: Bm25Index | BlockIndex, k: int = ARM_LIMIT) -> DataFrame:
    """queries: (query_id, user_id, query) -> (query_id, user_id, memory_id, score, rank): documents with a common term.

    Document frequencies are counted for the terms asked for only. The asked (user, term) rows, few, meet the postings; where
    they are too many to be broadcast, both sides are shuffled and a frequent term's postings are split among tasks. With a BlockIndex only
    blocks of postings that can matter are opened; the answers are the same.
    """
    if isinstance(index, BlockIndex):
        return _block_topk(queries, index, k)
    asked = _asked(queries)
    names = asked.select(*index.scope, "term").distinct()
    frequencies = index.postings.join(names, [*index.scope, "term"], "left_semi").groupBy(*index.scope, "term").agg(F.count("*").alias("df"))
    scored = _with_idf(asked, frequencies, index).join(index.postings, ["user_id", "term"]).groupBy("query_id", "user_id", "memory_id").agg(F.round(F.sum(F.col("idf") * _impact()), DIGITS).alias("score"))
    return best_of(scored, ["query_id"], k)


# ---------------------------------------------------------------- lexical, in blocks with maxima

#: Postings in a block, and postings that a task sorts at once.
BLOCK_POSTINGS, SLICE_POSTINGS = 128, 1 << 19
#: What rounding may add to a score.
SLACK = 2e-6


class BlockIndex:
    """Postings in blocks (user_id, term, part, n, top, rows), rows: structs (memory_id, impact), none above `top`; the totals and the
    scope of a Bm25Index, and `heads`, the blocks without their rows."""

    def __init__(self, blocks: DataFrame, totals: DataFrame, scope: list[str], save: Save):
        self.blocks, self.totals, self.scope, self.save = blocks, totals, scope, save
        self.heads = blocks.select("user_id", "term", "part", "n", "top")


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.Array]]:
    """The columns of batches, `most` rows or a batch more at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]
            held, n = [], 0
    if n:
        yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]


def _in_blocks(block: int, most: int):
    row = pa.struct([("memory_id", pa.string()), ("impact", pa.float64())])
    schema = pa.schema([("user_id", pa.string()), ("term", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("top", pa.float64()), ("rows", pa.list_(row))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for users, terms, memories, impacts in _gathered(batches, most):
            users, terms, impact = users.dictionary_encode(), terms.dictionary_encode(), impacts.to_numpy()
            word = users.indices.to_numpy().astype(np.int64) * len(terms.dictionary) + terms.indices.to_numpy()
            order = np.lexsort((-impact, word))
            word, impact = word[order], impact[order]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            place = np.arange(len(word)) - np.repeat(first, np.diff(first, append=len(word)))
            begin = np.flatnonzero(place % block == 0)
            n = np.diff(begin, append=len(word))
            rows = pa.StructArray.from_arrays([memories.take(pa.array(order)), pa.array(impact)], fields=list(row))
            rows = pa.ListArray.from_arrays(pa.array(np.append(begin, len(word)), pa.int32()), rows)
            user, term = (x.take(pa.array(i)) for x, i in ((users.dictionary, word[begin] // len(terms.dictionary)), (terms.dictionary, word[begin] % len(terms.dictionary))))
            whole = pa.RecordBatch.from_arrays([user, term, pa.array(part + np.arange(len(begin))), pa.array(n), pa.array(impact[begin]), rows], schema=schema)
            part += len(begin)
            for i in range(0, len(begin), 1 << 15):
                yield whole.slice(i, 1 << 15)

    return run


def block_index(index: Bm25Index, save: Save, block: int = BLOCK_POSTINGS) -> BlockIndex:
    """Postings of one user and term with like impacts go into blocks of at most `block`.

    Postings are shuffled once, by user and term; a task sorts SLICE_POSTINGS of them at a time by impact and cuts them into blocks. Which
    postings share a block does not matter to the answers, so Spark may split the partition of a common word of a large user among
    tasks. Blocks are numbered as tasks come to them, hence they must be saved.
    """
    rows = index.postings.where("user_id is not null")
    rows = rows.join(index.totals.select(*index.scope, "mean_length"), index.scope) if index.scope else rows.crossJoin(F.broadcast(index.totals.select("mean_length")))  # one row
    rows = rows.select("user_id", "term", "memory_id", _impact().alias("impact")).hint("rebalance", "user_id", "term")
    blocks = rows.mapInArrow(_in_blocks(block, SLICE_POSTINGS), "user_id string, term string, part long, n long, top double, rows array<struct<memory_id:string,impact:double>>")
    return BlockIndex(save(blocks, "blocks"), index.totals, index.scope, save)


def needed_blocks(queries: DataFrame, index: BlockIndex, k: int = ARM_LIMIT) -> DataFrame:
    """(query_id, user_id, term, part, idf, n): the blocks that can hold a posting of one of the k best documents of a query.

    The best blocks of each term, as many as hold k postings, are added up first; the k-th best of these partial scores is a
    threshold that k documents reach. A document with a posting in some block scores no more than the block's top and the
    tops of the query's other terms together; where that is below the threshold the block is of no use, and as this holds for each of
    its postings, the documents that remain have all their postings in the blocks that remain.
    """
    asked = _asked(queries)
    names = asked.select(*index.scope, "term").distinct()
    frequencies = index.heads.join(names, [*index.scope, "term"], "left_semi").groupBy(*index.scope, "term").agg(F.sum("n").alias("df"))
    heads = _with_idf(asked, frequencies, index).drop("mean_length").join(index.heads, ["user_id", "term"])
    of_term = Window.partitionBy("query_id", "term")
    before = F.sum("n").over(of_term.orderBy(F.desc("top"), "part").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumns({"most": F.max("top").over(of_term) * F.col("idf"), "lead": F.coalesce(before, F.lit(0)) < k})
    heads = index.save(heads, "heads")
    # only a query that asks for more than its leading blocks needs a threshold
    more = heads.groupBy("query_id").agg(F.bool_and("lead").alias("all")).where("not all").select("query_id")
    lead = heads.where("lead").join(more, "query_id", "left_semi")
    threshold = best_of(_added(lead, index, SLACK / 4), ["query_id"], k).where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("threshold"))
    tops = heads.select("query_id", "term", "most").distinct().groupBy("query_id").agg(F.sum("most").alias("all_tops"))
    bound = F.col("idf") * F.col("top") + F.col("all_tops") - F.col("most")
    kept = heads.join(tops, "query_id").join(threshold, "query_id", "left").where(F.col("threshold").isNull() | (bound >= F.col("threshold") - SLACK))
    return kept.select("query_id", "user_id", "term", "part", "idf", "n")


def _added(heads: DataFrame, index: BlockIndex, less: float = 0.0) -> DataFrame:
    """The scores of documents from some blocks of their queries' terms."""
    rows = heads.select("query_id", "user_id", "term", "part", "idf").join(index.blocks.select("user_id", "term", "part", "rows"), ["user_id", "term", "part"])
    found = rows.select("query_id", "user_id", "idf", F.inline("rows")).groupBy("query_id", "user_id", "memory_id")
    return found.agg(F.round(F.sum(F.col("idf") * F.col("impact")) - less, DIGITS).alias("score"))


def _block_topk(queries: DataFrame, index: BlockIndex, k: int) -> DataFrame:
    """Blocks of the words that are asked for are taken out of all blocks once, so that blocks with their rows are never shuffled whole."""
    mine = index.blocks.join(_asked(queries).select("user_id", "term").distinct(), ["user_id", "term"], "left_semi")
    heads, index = index.heads, BlockIndex(index.save(mine, "asked-blocks"), index.totals, index.scope, index.save)
    index.heads = heads  # document frequencies are those of all users
    return best_of(_added(needed_blocks(queries, index, k), index), ["query_id"], k)


# ---------------------------------------------------------------- dense


def _sizes(rows: DataFrame, per_block) -> DataFrame:
    """(user_id, dim, blocks): how many blocks of about `per_block` rows each user and dimension needs."""
    return rows.groupBy("user_id", "dim").agg(F.count("*").alias("n")).select("user_id", "dim", F.ceil(F.col("n") / per_block).cast("int").alias("blocks"))


def _blocked(rows: DataFrame, key: str, sizes: DataFrame, per_salt: int) -> DataFrame:
    """Rows (key, user_id, dim, dense) gathered in the blocks that sizes gives them: (user_id, dim, salt, rows)."""
    placed = rows.join(sizes, ["user_id", "dim"]).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
    placed = placed.withColumn("salt", F.pmod("block", F.ceil(F.col("blocks") / per_salt)).cast("int"))
    return placed.groupBy("user_id", "dim", "block", "salt").agg(F.collect_list(F.struct(F.col(key).alias("id"), "dense")).alias("rows")).drop("block")


def dense_topk(queries: DataFrame, index: DataFrame, k: int = ARM_LIMIT, per_salt: int = BLOCKS_PER_SALT) -> DataFrame:
    """queries: (query_id, user_id, dense); index: (memory_id, user_id, dense) -> like bm25_topk, scores are cosines.

    The vectors of users that are asked for are gathered in blocks of bounded size, the users' queries in chunks; a chunk and a block are
    multiplied at once and leave the best k a query, so no table of pairs is made and nothing passes the driver. A user's size
    decides how many salts the user has, one for each `per_salt` blocks; the user's few queries are copied to each of them, so a user of any
    size is spread over tasks by the join's own key, with adaptive execution or without. Only vectors of equal dimension are compared; null and
    empty vectors and those with nulls or values that are not finite are left out, a zero vector scores 0.
    """
    finite = ~F.exists("dense", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = lambda df, key: df.where((F.size("dense") > 0) & finite).select(key, "user_id", F.size("dense").alias("dim"), F.col("dense").cast("array<double>").alias("dense"))
    asked = clean(queries, "query_id")
    mine = clean(index, "memory_id").join(asked.select("user_id", "dim").distinct(), ["user_id", "dim"], "left_semi")
    sizes = _sizes(mine, F.greatest(F.lit(64), F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    right = _blocked(mine, "memory_id", sizes, per_salt).select("user_id", "dim", "salt", F.col("rows").alias("m"))
    left = _blocked(asked, "query_id", _sizes(asked, F.lit(QUERY_CHUNK)), 1).select("user_id", "dim", F.col("rows").alias("q")).join(sizes, ["user_id", "dim"])
    left = left.select("user_id", "dim", F.explode(F.sequence(F.lit(0), F.ceil(F.col("blocks") / per_salt).cast("int") - 1)).alias("salt"), "q")
    both = left.join(right, ["user_id", "dim", "salt"]).select("user_id", "q", "m")
    found = both.mapInArrow(_best_of_blocks(k), "query_id string, user_id string, memory_id string, score double")
    return best_of(found, ["query_id"], k)


def _best_of_blocks(k: int):
    schema = pa.schema([("query_id", pa.string()), ("user_id", pa.string()), ("memory_id", pa.string()), ("score", pa.float64())])

    def columns(rows: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
        ids, vectors = rows.values.field(0), rows.values.field(1).flatten().to_numpy()
        x = vectors.reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.array(ids.to_pylist(), object).astype(str), x / np.where(norm > 0, norm, 1)

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best, equal scores by id."""
        if len(scores) > k:
            some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[some], scores[some]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        of = None

        def passed():
            for query, (ids, scores) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(ids), pa.string()), pa.array([of] * len(ids), pa.string()), pa.array(ids.tolist(), pa.string()), pa.array(scores)], schema=schema)
            held.clear()

        for batch in batches:
            for user, q, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if user != of or len(held) > HELD_QUERIES:
                    yield from passed()
                    of = user
                (names, x), (ids, y) = columns(q), columns(m)
                for name, scores in zip(names.tolist(), np.round(x @ y.T, DIGITS), strict=True):
                    if name in held:
                        before = held[name]
                        held[name] = best(np.concatenate([before[0], ids]), np.concatenate([before[1], scores]))
                    else:
                        held[name] = best(ids, scores)
        yield from passed()

    return run


# ---------------------------------------------------------------- fusion


def rrf_fuse(arms: list[DataFrame], k: int = RRF_K, weights: tuple[float, ...] = (0.5, 0.5), prefetch: int = ARM_LIMIT, top_k: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of arms (query_id, memory_id, rank), ranks from 0.

    Keeps 2 x prefetch candidates a query, ordered by score, then memory_id, and cuts them to top_k.
    """
    if k != RRF_K:
        raise ValueError(f"k must be {RRF_K} for ranks from 0")
    if len(weights) != len(arms) or min(weights) < 0 or not any(weights):
        raise ValueError("one weight an arm, none negative and not all zero")
    if prefetch <= 0 or top_k is not None and top_k <= 0:
        raise ValueError("limits must be positive")
    parts = None
    for arm, w in zip(arms, weights, strict=True):
        part = arm.select("query_id", "memory_id", (F.lit(float(w)) / (F.col("rank") + k)).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    # decimals, so that the order of adding does not matter
    fused = parts.groupBy("query_id", "memory_id").agg(F.round(F.sum(F.col("part").cast("decimal(20,12)")), 10).cast("double").alias("score"))
    return best_of(fused, ["query_id"], min(2 * prefetch, top_k or 2 * prefetch))


def arm_rankings(lexical: DataFrame, dense: DataFrame, n: int = ARM_LIMIT) -> DataFrame:
    """(query_id, lexical, dense): the two arms' ordered id lists, empty where an arm has nothing."""
    both = lexical.select("query_id", "memory_id", "rank", F.lit(0).alias("arm")).unionByName(dense.select("query_id", "memory_id", "rank", F.lit(1).alias("arm"))).where(F.col("rank") < n)
    ids = lambda arm: F.transform(F.sort_array(F.collect_list(F.when(F.col("arm") == arm, F.struct("rank", "memory_id")))), lambda x: x["memory_id"])
    return both.groupBy("query_id").agg(ids(0).alias("lexical"), ids(1).alias("dense"))


def hybrid_search(queries: DataFrame, index: Bm25Index | BlockIndex, vectors: DataFrame, prefetch: int = ARM_LIMIT, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """queries: (query_id, user_id, query, top_k, dense). Blank queries and top_k of 0 or less have no rows."""
    asked = queries.where(~T.is_blank(F.col("query")) & (F.col("top_k") > 0))
    fused = rrf_fuse([bm25_topk(asked, index, prefetch), dense_topk(asked, vectors, prefetch)], weights=weights, prefetch=prefetch)
    return fused.join(asked.select("query_id", "user_id", "top_k"), "query_id").where(F.col("rank") < F.col("top_k")).drop("top_k")


def dedup_candidates(candidates: DataFrame, position: str = "rank") -> DataFrame:
    """The first occurrence of each memory, ranks numbered anew from 0."""
    first = candidates.groupBy("query_id", "memory_id").agg(F.min(position).alias("_at"))
    w = Window.partitionBy("query_id").orderBy("_at", "memory_id")
    return first.select("query_id", "memory_id", (F.row_number().over(w) - 1).alias("rank"))


def rank_consistency(rankings: DataFrame) -> DataFrame:
    """arm_rankings() with `consistent`: same first, or three of the first five shared, or the lexical first among the dense
    first three; never with an empty arm."""
    top = lambda c, n: F.slice(c, 1, n)
    both = (F.size("lexical") > 0) & (F.size("dense") > 0)
    first = F.get("lexical", F.lit(0))
    agree = (first == F.get("dense", F.lit(0))) | (F.size(F.array_intersect(top("lexical", 5), top("dense", 5))) >= 3) | F.array_contains(top("dense", 3), first)
    return rankings.withColumn("consistent", F.coalesce(both & agree, F.lit(False)))


def would_trigger_rate(decisions: DataFrame) -> DataFrame:
    """The share of known decisions that are false; null if none is known."""
    return decisions.agg(F.round(F.avg(F.when(F.col("consistent").isNotNull(), (~F.col("consistent")).cast("int"))), DIGITS).alias("rate"))
