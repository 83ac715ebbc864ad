"""Embedding cache and index build. Encoders are callables on lists of texts, run on Arrow batches of distinct misses."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.rank import isolated
from mnemospark.operators.tables import upsert

Encode = Callable[[list[str]], list]
QUERY_PREFIX = "query:"


def template_version(with_day: bool) -> str:
    return "v1+abs_time" if with_day else "v1"


def embedding_coordinate(model: str, render_template: str, dim: int) -> str:
    """A key under which vectors of one model, template and dimension are kept; vectors never mix across keys."""
    parts = json.dumps({"dim": dim, "model": model, "template": render_template}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(parts.encode()).hexdigest()[:16]


def content_hash(text: Column, query: bool = False) -> Column:
    """Where a text's vector is kept; query texts have keys of their own."""
    return F.sha2(F.concat(F.lit(QUERY_PREFIX if query else ""), text), 256)


def encode_distinct(texts: DataFrame, encode: Encode, batch_size: int) -> DataFrame:
    """(content_hash, text) rows to (content_hash, dim, vec)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch_size):
                part = frame.iloc[i : i + batch_size]
                vectors = [np.asarray(v, np.float32) for v in encode(part["text"].tolist())]
                yield pd.DataFrame({"content_hash": part["content_hash"].to_numpy(), "dim": [len(v) for v in vectors], "vec": vectors})

    return texts.select("content_hash", "text").mapInPandas(run, "content_hash string, dim int, vec array<float>")


def embed_queries(queries: DataFrame, encode: Encode, batch_size: int = 64) -> DataFrame:
    """queries (query_id, query, ...) with `dense` and `error`: a query whose encoding fails, in its batch and alone, has no vector and
    says why; it does not fail the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch_size):
                part = frame.iloc[i : i + batch_size]
                vectors, errors = isolated(lambda rows: [np.asarray(v, np.float32) for v in encode(rows["query"].tolist())], part, "query_id", None)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "dense": vectors, "error": errors})

    made = queries.select("query_id", "query").mapInPandas(run, "query_id string, dense array<float>, error string")
    return queries.join(made, "query_id")


def embed_missing(texts: DataFrame, cache: DataFrame, encode: Encode, coordinate: str, batch_size: int = 64, query: bool = False, created_at: int = 0, concurrency: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts with `vec`, new cache rows). Each distinct text that the cache lacks is encoded once; all its rows get the vector.

    The model call is the dear part: write the new rows before joining a second time. `concurrency` caps the tasks that call
    the model.
    """
    hashed = texts.withColumn("content_hash", content_hash(F.col("text"), query))
    own = cache.where(F.col("coordinate") == coordinate)
    missing = hashed.select("content_hash", "text").dropDuplicates(["content_hash"]).join(own.select("content_hash"), "content_hash", "left_anti")
    if concurrency:
        missing = missing.repartition(concurrency)
    made = encode_distinct(missing, encode, batch_size)
    new = made.select(F.lit(coordinate).alias("coordinate"), "content_hash", "dim", "vec", F.lit(created_at).cast("long").alias("created_at"))
    known = own.select("content_hash", "vec").unionByName(new.select("content_hash", "vec"))
    return hashed.join(known, "content_hash").drop("content_hash"), new


def check_dimensions(vectors: DataFrame, expected: int) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): vectors of the expected dimension, and those that are null, empty, of another one or not finite."""
    good = F.coalesce((F.size("vec") == expected) & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return vectors.where(good), vectors.where(~good)


def dimension_report(vectors: DataFrame, key: str = "coordinate") -> DataFrame:
    """Per coordinate: the dimensions in use and how many vectors; more than one dimension is a fault."""
    return vectors.groupBy(key).agg(F.array_sort(F.collect_set(F.size("vec"))).alias("dims"), F.count("*").alias("n"))


def build_index(blocks: DataFrame, cache: DataFrame, encode: Encode, coordinate: str, existing: DataFrame | None = None, with_day: bool = False, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(index records, new cache rows) of blocks with a rendered text; records replace existing ones of the same memory."""
    day = T.event_day(F.col("event_time")) if with_day else None
    rendered = blocks.withColumn("text", T.render(F.col("question"), F.col("answer"), day)).where("text <> ''")
    vectors, new = embed_missing(rendered, cache, encode, coordinate, **kwargs)
    index = vectors.select(
        F.col("id").alias("memory_id"), T.point_id(F.col("id")).alias("point_id"), "user_id", "session_id", "local_index", "event_time",
        "text", T.terms(F.col("text")).alias("terms"), F.col("vec").alias("dense"),
    )
    return (index if existing is None else upsert(existing, index, ["memory_id"], "replace", ["text"])), new
