"""Shared pieces of the text operators: staging tables, Arrow text access, word scanning and hashing.

Word scanning works on whole Arrow buffers with numpy: one pass lower-cases and classifies bytes,
then sums over bytes times random factors give every word a 64-bit hash without a Python loop over words.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
CHUNK_BYTES = 1 << 19
#: Bits of the bitmap that keeps texts without candidates out of joins (1 MB); more of them let fewer through.
BITMAP = 1 << 23
#: Bytes in one block of rows that are compared with each other.
BLOCK_BYTES = 1 << 20


# ---------------------------------------------------------------- staged tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            _OWN_DIR[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def small_arrow_batches(spark: SparkSession) -> Iterator[None]:
    """While jobs run in it, Python workers get 8 MB at once and not the session's limit; for rows of whole blocks and of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "8m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; null text becomes empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# ---------------------------------------------------------------- Arrow text access


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most about `most` text bytes (a longer document stands alone), so memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, int(offsets[begin]) + most, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_as_arrow(columns[f.name], f.type) for f in schema], schema=schema)


def _as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.cast(kind)
    return pa.array(values, kind)


def bitmap(bits: DataFrame) -> np.ndarray:
    """BITMAP booleans, true where x (its one column, from 0 on) is: of a fixed size whatever the number of rows."""
    parts = bits.select((F.col("x") + 1).alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("m"))
    size = BITMAP // 8
    whole = np.zeros(size + 4096 * 8, np.uint8)
    for r in parts.collect():  # at most BITMAP / 32768 rows of 4 KB
        whole[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return np.unpackbits(whole, bitorder="little").astype(bool)


def _bits_of(ids: DataFrame) -> np.ndarray:
    """The bitmap of ids (one column)."""
    return bitmap(ids.select(F.pmod(F.xxhash64(ids.columns[0]), F.lit(BITMAP)).alias("x")))


def bit_filter(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key may be among ids (one column): surely not, if its bit is not set."""
    sent, columns = rows.sparkSession.sparkContext.broadcast(_bits_of(ids)), rows.columns

    def keep(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                yield batch.select(columns).filter(pa.array(sent.value[batch.column(len(columns)).to_numpy()]))

    return rows.withColumn("_bit", F.pmod(F.xxhash64(key), F.lit(BITMAP))).mapInArrow(keep, rows.schema)


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of documents that may be among ids (one column)."""
    return bit_filter(docs.select("doc_id", "text"), "doc_id", ids)


def pair_blocks(rows: DataFrame, key: list[str], by: list[str], fields: list[str], block: int, spread: int, weight: Column | None = None, active: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(*key, x, y): arrays of structs of `fields`, so that any two rows of one key meet, in an x and a y or in an x whose y is null.

    The rows of a key are cut into blocks of about `block` rows (and of about BLOCK_BYTES of `weight`), by a hash of the
    columns `by`; a block meets the others in tasks of `spread` blocks, so a key of any size is spread over tasks. A key of one
    block is not shuffled again. With `active`, a boolean column, rows that are not active meet active ones only. key must
    hold no nulls. counted: the same rows, or a few more, where they are cheaper to count (without weight).
    """
    flag = F.lit(True) if active is None else F.col(active)
    weight = F.lit(0) if weight is None else weight
    many = lambda kind: F.expr(f"int(ceil(greatest(_n{kind} / {block}, _w{kind} / {BLOCK_BYTES})))")
    sums = [x.alias(f"_{n}{k}") for k, cond in ((1, flag), (0, ~flag)) for n, x in (("n", F.count_if(cond)), ("w", F.coalesce(F.sum(F.when(cond, weight)), F.lit(0))))]
    sizes = (rows if counted is None else counted).groupBy(*key).agg(*sums).where("_n1 > 0 and _n1 + _n0 > 1").select(*key, many(1).alias("_blocks"), many(0).alias("_rest"))
    sized = rows.join(stage(sizes, "sizes"), key)
    spot = F.xxhash64(*key, *by)
    place = F.when(flag, F.pmod(spot, F.col("_blocks"))).otherwise(F.col("_blocks") + F.pmod(spot, F.greatest("_rest", F.lit(1)))).cast("int")
    sized = sized.withColumn("_block", place)
    blocks = stage(sized.groupBy(*key, "_block", "_blocks", "_rest").agg(F.collect_list(F.struct(*fields)).alias("rows")), "blocks")
    nothing = F.lit(None).cast(blocks.schema["rows"].dataType)
    alone = blocks.where("_block < _blocks").select(*key, F.col("rows").alias("x"), nothing.alias("y"))
    met = blocks.where("_blocks + _rest > 1")
    salts = F.expr(f"int(ceil(_blocks / {spread}))")
    left = met.where("_block < _blocks").select(*key, (F.col("_block") % salts).cast("int").alias("_salt"), F.col("_block").alias("_i"), F.col("rows").alias("x"))
    right = met.select(*key, F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"), F.col("_block").alias("_j"), F.col("rows").alias("y"))
    return alone.unionByName(left.join(right, [*key, "_salt"]).where("_i < _j").select(*key, "x", "y"))


# ---------------------------------------------------------------- words and hashes

_M = np.uint64
_factors = np.zeros(0, np.uint64)


def _factor_table(n: int) -> np.ndarray:
    """At least n random factors, one for each place in a word; the same in every process, whatever n."""
    global _factors
    if len(_factors) < n:
        _factors = np.random.default_rng(0x5EED).integers(0, 1 << 64, max(n, 1 << 10), dtype=np.uint64)
    return _factors


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
        return x ^ (x >> _M(31))


class Alphabet:
    """Which bytes are word bytes, and what each byte becomes."""

    def __init__(self, is_word, lower: bool = True):
        self.is_word = np.array([bool(is_word(b)) for b in range(256)])
        self.becomes = np.arange(256, dtype=np.uint8)
        if lower:
            self.becomes[65:91] += 32


#: Everything but white space (space, U+0009 to U+000D), A-Z lower-cased or as it is.
NON_SPACE = Alphabet(lambda b: b != 32 and not 9 <= b <= 13)
NON_SPACE_AS_IS = Alphabet(lambda b: b != 32 and not 9 <= b <= 13, lower=False)
#: ASCII letters and digits, and every byte of a code point above U+007F.
ALNUM = Alphabet(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """Words of a batch of texts: byte spans in `low`, the document each lies in and its 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
        self.low = low = alphabet.becomes[data]
        n = len(low)
        is_word = alphabet.is_word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = is_word[:-1], is_word[1:]
            full = offsets[1:] > offsets[:-1]
            before[offsets[:-1][full]] = False
            after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)  # index of each document's first word, and one past the last
        self.count = np.diff(self.first)
        length = self.end - self.start
        begin = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        self.hash = np.zeros(0, np.uint64)
        if len(length):
            # a sum of bytes times random factors; unlike a polynomial it has no structured texts that always collide
            with np.errstate(over="ignore"):
                value = (low[is_word].astype(np.uint64) + _M(1)) * _factor_table(int(length.max()))[place]
                self.hash = mix(np.add.reduceat(value, begin) + length.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def lanes(self, which: np.ndarray, lane: int) -> np.ndarray:
        """Bytes 8 * lane to 8 * lane + 8 of the given words (which have more than 8 * lane) as one number, zeros after the end."""
        if not hasattr(self, "_wide"):
            padded = np.concatenate([self.low, np.zeros(8, np.uint8)])
            self._wide = np.ndarray(len(self.low) + 1, "<u8", padded, 0, (1,))
        at = self.start[which] + 8 * lane
        return self._wide[at] & _LANE_MASK[np.minimum(self.end[which] - at, 8)]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes (none if there are fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _M(0xD6E8FEB86659FD93) + words[i : i + n]
        return mix(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle of all its words, no words give none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words, min(k, len(words))))
