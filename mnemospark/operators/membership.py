"""Bloom filters kept as tables: which ids a registry surely doesn't hold, without reading it.

A filter is a set of rows (bucket, chunks, chunk, bits): an id's hash names one of a bucket's `chunks` chunks of 32,768 bits, and HASHES bits
in it. Chunks are OR-ed together by bitmap aggregates, so filters of many batches merge like any other rows, and a lookup reads one row for
each id and batch, whatever the size of the registry. With 16 bits an id a new id is taken for a known one with a
chance of about 0.3 percent; a fuller filter only lets more ids through to the exact lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER = "chunks int, chunk int, bits binary"
CHUNK_BITS, HASHES = 1 << 15, 4


def chunk_of(value: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), value), F.lit(chunks)).cast("int")


def _places(value: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(2 + i), value), F.lit(CHUNK_BITS)) for i in range(HASHES)))


def filter_of(ids: DataFrame, key: str, chunks: int) -> DataFrame:
    """ids (bucket, key) to filter rows."""
    places = ids.select("bucket", chunk_of(F.col(key), chunks).alias("chunk"), F.explode(_places(F.col(key))).alias("place"))
    return places.groupBy("bucket", "chunk").agg(F.bitmap_construct_agg("place").alias("bits")).select("bucket", F.lit(chunks).alias("chunks"), "chunk", "bits")


def merged(filters: DataFrame) -> DataFrame:
    """One row for each chunk of filters of several batches."""
    return filters.groupBy("bucket", "chunks", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))


def chunks_for(n: int, buckets: int, bits: int = 16) -> int:
    """Chunks a bucket that give n ids so many bits each: a power of two."""
    return 1 << max(0, -(-n * bits // (CHUNK_BITS * buckets)) - 1).bit_length()


def may_hold(ids: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """Those ids (key, bucket) that filter rows, of any numbers of chunks, don't rule out; a null id is ruled out."""
    sizes = [r.chunks for r in filters.select("chunks").distinct().collect()]  # one, or two while a larger filter takes over
    if not sizes:
        return ids.limit(0)
    byte = lambda place: F.conv(F.hex(F.substr("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    has = lambda place: F.call_function("shiftright", byte(place), (place % 8).cast("int")).bitwiseAND(1) == 1
    asked = ids.select("bucket", F.col(key).alias("_id"), F.explode(F.array(*map(F.lit, sizes))).alias("chunks")).distinct()
    asked = asked.select("bucket", "_id", "chunks", F.pmod(F.xxhash64(F.lit(1), "_id"), F.col("chunks")).cast("int").alias("chunk"))
    seen = asked.join(filters, ["bucket", "chunks", "chunk"]).where(F.forall(_places(F.col("_id")), has))
    return ids.join(seen.select(F.col("_id").alias(key)).distinct(), key, "left_semi")
