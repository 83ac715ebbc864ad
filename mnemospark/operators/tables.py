"""Table maintenance: upserts, ordered scans, lookups, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_of_each(incoming: DataFrame, keys: list[str], mode: str, order: list[str] | None = None) -> DataFrame:
    """Of rows with equal keys the first by `order` (all other columns by default) in ignore mode, the last in replace mode."""
    by = [F.col(c) for c in (order or [c for c in incoming.columns if c not in keys])] or [F.lit(1)]
    w = Window.partitionBy(*keys).orderBy(*(c.desc() if mode == "replace" else c.asc() for c in by))
    return incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], mode: str = "ignore", order: list[str] | None = None) -> DataFrame:
    """`ignore`: rows already there win; `replace`: incoming rows win. Of incoming rows with equal keys one counts (one_of_each).

    For stored tables streaming.tables.Tables.merge does this by writing only the folders that hold a key of `incoming`.
    """
    if mode not in ("ignore", "replace"):
        raise ValueError(f"mode must be ignore or replace, not {mode!r}")
    one = one_of_each(incoming, keys, mode, order)
    if mode == "ignore":
        return existing.unionByName(one.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))
    return existing.join(one.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(one.select(*existing.columns))


def read_blocks(blocks: DataFrame, user_id: str | None = None, buckets: int | None = None) -> DataFrame:
    """Blocks of one user or of all, in order.

    With `buckets`, blocks must have the column `bucket` that write_table or Tables makes, out of so many: then the user's folder
    alone is opened.
    """
    found = blocks if user_id is None else blocks.where(F.col("user_id") == user_id)
    if user_id is not None and buckets is not None:
        # a number, not an expression: Spark prunes folders by it while it plans
        number = blocks.sparkSession.range(1).select(F.pmod(F.xxhash64(F.lit(user_id)), F.lit(buckets)).cast("int")).first()[0]
        found = found.where(F.col("bucket") == number)
    return found.orderBy("user_id", "session_id", "request_id", "local_index")


def blocks_of_request(blocks: DataFrame, request_id: str, user_id: str | None = None, buckets: int | None = None) -> DataFrame:
    """Blocks of a request; with its user and `buckets` only the user's folder is opened."""
    found = blocks if user_id is None else read_blocks(blocks, user_id, buckets)
    return found.where(F.col("request_id") == request_id).orderBy("local_index")


def fetch_by_ids(blocks: DataFrame, ids: DataFrame, id_col: str = "ids", user_col: str | None = None, buckets: int | None = None) -> DataFrame:
    """The blocks of id lists, in the order of each list; unknown ids are left out. Other columns of `ids` are kept.

    With `user_col`, the column of `ids` that names the blocks' user, and `buckets` (see read_blocks), only folders of these
    users are opened.
    """
    if user_col is not None and buckets is not None:
        number = F.pmod(F.xxhash64(F.col(user_col)), F.lit(buckets)).cast("int")
        wanted = [r.bucket for r in ids.select(number.alias("bucket")).distinct().collect()]  # at most `buckets` numbers
        blocks = blocks.where(F.col("bucket").isin(wanted)) if wanted else blocks.limit(0)
    wanted = ids.select(*[c for c in ids.columns if c != id_col], F.posexplode(id_col).alias("position", "id"))
    return wanted.join(blocks, "id")


def index_count(index: DataFrame, per_user: bool = False) -> DataFrame:
    return index.groupBy("user_id").agg(F.count("*").alias("n")) if per_user else index.agg(F.count("*").alias("n"))


def user_bucket(buckets: int):
    """Which of a fixed number of folders a user's rows go to; raw users would make too many."""
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, buckets: int = 64, mode: str = "append") -> None:
    """Parquet, in folders by user bucket if there is a user_id. A bucket is spread over as many tasks as it needs."""
    if "user_id" not in df.columns:
        df.write.mode(mode).parquet(path)
        return
    out = df.withColumn("bucket", user_bucket(buckets))
    out.hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def write_metrics(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("overwrite").json(path)
