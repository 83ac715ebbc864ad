"""Token-id files: flat unsigned integers, 64-bit document offsets, one manifest.

A dataset folder holds, for each part, `part-N.ids` (uint16 or uint32, little-endian), `part-N.offsets` (uint64, one more
than the part's documents, counted from the part's first id) and `part-N.docs` (int64 document ids). Parts follow each
other in ascending doc_id order; the manifest's bases, prefix sums of the parts' sizes, make offsets global.

Nulls: null text is an empty document (only the end id); rows with a null doc_id come first, and the manifest says how many
of a part's documents have none. Repeated rows stay repeated, in an order fixed by doc_id, a hash of the text and the text, by
which also a doc_id of very many rows is spread over parts. An empty table gives a dataset with no documents. Other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import chunked, documents, new_path, text_buffers, to_batch
from mnemospark.llm.tokens import END_ID, default_path, encoder

_READ_IDS = 1 << 20


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, dtype: str, schema: pa.Schema):
    code, names, outs = encoder(tokenizer, end_id), None, None
    docs = ids_written = nulls = 0
    store, base = pafs.FileSystem.from_uri(folder)
    attempt, part = uuid.uuid4().hex, -1
    for batch in chunked(batches):
        if outs is None:
            part = batch.column(batch.schema.get_field_index("part"))[0].as_py()
            names = [f"{base}/part-{part:06d}.{x}" for x in ("ids", "offsets", "docs")]
            outs = [store.open_output_stream(f"{n}.{attempt}") for n in names]
            outs[1].write(np.zeros(1, "<u8").tobytes())
        ids, offsets = code.encode(*text_buffers(batch.column(batch.schema.get_field_index("text"))))
        outs[0].write(ids.astype(dtype).tobytes())
        outs[1].write((offsets[1:] + ids_written).astype("<u8").tobytes())
        doc_id = batch.column(batch.schema.get_field_index("doc_id"))
        outs[2].write(doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        nulls += doc_id.null_count
        docs, ids_written = docs + batch.num_rows, ids_written + len(ids)
    if outs is None:
        return
    for out, name in zip(outs, names, strict=True):
        out.close()
        store.move(f"{name}.{attempt}", name)  # a lost or repeated attempt never leaves half a part under its name
    yield to_batch(schema, part=[part], docs=[docs], ids=[ids_written], nulls=[nulls])


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all documents and write them, in ascending doc_id order, as token files; returns the folder.

    Only the list of parts (one row a partition) comes to the driver.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_path()
    folder = folder or new_path(spark, "token-files")
    _make(folder)
    dtype = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"
    ordered = (
        documents(docs, id_col, text_col)
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    schema = pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("nulls", pa.int64())])
    rows = ordered.mapInArrow(lambda it: _write_part(it, folder, tokenizer, end_id, dtype, schema), "part long, docs long, ids long, nulls long").collect()
    parts, base = [], 0
    for r in sorted(rows):
        parts.append({"part": r.part, "docs": r.docs, "ids": r.ids, "nulls": r.nulls, "base": base})
        base += r.ids
    store, path = pafs.FileSystem.from_uri(folder)
    with store.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "end_id": end_id, "ids": base, "parts": parts}).encode())
    for info in store.get_file_info(pafs.FileSelector(path)):  # what failed attempts have left
        if re.search(r"/part-[0-9]+\.[a-z]+\.[0-9a-f]{32}$", info.path):
            store.delete_file(info.path)
    return folder


def _make(folder: str) -> None:
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path)


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def read_manifest(folder: str) -> dict:
    store, path = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


class FlatFile:
    """An array file, memory-mapped where the store is a local or mounted folder, else read by ranges."""

    def __init__(self, uri: str, dtype: str):
        self.store, self.path = pafs.FileSystem.from_uri(uri)
        self.dtype = np.dtype(dtype)
        size = self.store.get_file_info(self.path).size // self.dtype.itemsize
        local = isinstance(self.store, pafs.LocalFileSystem)
        self.mapped = np.memmap(self.path, self.dtype, "r") if local and size else None
        self.size = size

    def __len__(self) -> int:
        return self.size

    def read(self, begin: int, end: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[begin:end]
        if begin >= end:
            return np.zeros(0, self.dtype)
        with self.store.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at((end - begin) * self.dtype.itemsize, begin * self.dtype.itemsize), self.dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a dataset; ids are little-endian uint32 bytes, start counts all ids before."""
    manifest = read_manifest(folder)
    parts, dtype = {p["part"]: p for p in manifest["parts"]}, manifest["dtype"]
    numbers = list(parts)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def rows(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                part = parts[numbers[i]]
                name = f"{folder}/part-{part['part']:06d}"
                ids, offsets, docs = FlatFile(f"{name}.ids", dtype), FlatFile(f"{name}.offsets", "<u8"), FlatFile(f"{name}.docs", "<i8")
                begin = 0
                while begin < part["docs"]:
                    at = offsets.read(begin, min(begin + 1 + 4096, part["docs"] + 1)).astype(np.int64)
                    n = max(1, int(np.searchsorted(at, at[0] + _READ_IDS, side="right")) - 1)
                    at = at[: n + 1]
                    flat = ids.read(int(at[0]), int(at[-1])).astype("<u4")
                    cut = ((at - at[0]) * 4).tolist()
                    raw = flat.tobytes()
                    doc_ids = docs.read(begin, begin + n)
                    yield to_batch(schema, doc_id=pa.array(doc_ids, mask=np.arange(begin, begin + n) < part["nulls"]), start=at[:-1] + part["base"], n_tokens=np.diff(at), ids=[raw[a:b] for a, b in zip(cut, cut[1:], strict=False)])
                    begin += n

    return spark.range(0, len(numbers), 1, max(1, len(numbers))).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def with_crc32(rows: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """The unsigned CRC-32 of a binary column, in place of it."""
    return rows.withColumn(name, F.crc32(F.col(ids))).drop(ids)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
