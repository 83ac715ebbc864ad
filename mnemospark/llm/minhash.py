"""MinHash near-duplicate groups: minima of many universal hashes, bands, verification, components.

Copies with the same shingle set form a class at once and only its least document goes on. Bands of signature rows give
buckets. First every document of a bucket is compared with the bucket's lead only, so a group of copies, however large, is
never expanded into pairs. In half of the buckets the lead is the document that meets most others (the original of edited
copies, as a rule), in the other half it is a random one. Verified links are joined into components, which makes them large
early. Then, in every bucket that holds different components, all pairs across them are compared, whatever the bucket's
size: it is cut into blocks, and pairs of blocks are spread over tasks, which give the links that connect components and not
all of them. Pairs are checked on lengths and signatures first (far below the threshold: dropped) and then on the full
shingle sets.

With 45 bands of 6 rows a pair of similarity 0.8 shares no bucket with a probability of about one in a million.

Null, empty and wordless texts have no shingles, are linked with nothing and are always kept. Rows with a null doc_id are
linked with nothing, have a null component and are kept. Repeated rows of one doc_id are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from mnemospark.llm.common import NON_SPACE, Words, among, chunked, documents, pair_blocks, shingle_set, small_arrow_batches, stage, text_buffers, to_batch, unstage
from mnemospark.llm.components import components

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 45, 6
#: Standard errors (less likely together than a pair that shares no bucket) that a signature's estimate may lie below the threshold before a pair is dropped unseen.
SLACK_SIGMAS = 5.0
#: Documents of a bucket that the last step handles as one block, and blocks that meet all others in one task.
BLOCK, SPREAD = 256, 8
_SEED = 20_240_229


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of (a x + b) mod 2^32 over all shingles, for every hash of the family."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 512):  # blocks that stay in the cache
            np.minimum(out, (a[:, None] * x[None, i : i + 512] + b[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Per document: number of shingles, fingerprint of the set, one byte a hash, one key a band."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sign(batches):
        from hashlib import blake2b

        a, b = _hash_family(bands * rows)
        spread = np.random.default_rng(_SEED + 1).integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)
        empty_sets: tuple = (None, None, None)
        for batch in chunked(batches):
            w = Words(*text_buffers(batch.column(1)), NON_SPACE)
            n, out = [], []
            for i, j in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
                s = shingle_set(w.hash[i:j], shingle)
                n.append(len(s))
                if not len(s):
                    out.append(empty_sets)
                    continue
                m = minima(s, a, b)
                with np.errstate(over="ignore"):
                    mixed = m.reshape(bands, rows).astype(np.uint64) * spread
                    keys = np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(29)), axis=1) * spread[:, 0]
                out.append((blake2b(s.tobytes(), digest_size=16).digest(), (m & np.uint32(255)).astype(np.uint8).tobytes(), keys.view(np.int64)))
            sets, signs, keys = zip(*out, strict=True) if out else ((), (), ())
            yield to_batch(schema, doc_id=batch.column(0), n_shingles=n, set_id=list(sets), signature=list(signs), keys=list(keys))

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_id binary, signature binary, keys array<long>")


def _similar_signatures(pairs: DataFrame, signs: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Pairs (u, v) whose signatures agree nearly as much as the threshold asks for."""
    p = percent / 100
    least = p - SLACK_SIGMAS * np.sqrt(p * (1 - p) / hashes)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def agree(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            same = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= least
            yield batch.select([0, 1]).filter(pa.array(same)).cast(schema)

    left = signs.select(F.col("rep").alias("u"), F.col("signature").alias("x"))
    right = signs.select(F.col("rep").alias("v"), F.col("signature").alias("y"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")
    return both.mapInArrow(agree, "u long, v long")


def _candidates(x, y, key: int, percent: int, least: float):
    """For each row of x the rows of y (of x after it, where y is None) that could be linked with it: other component, lengths and
    signatures near enough, and no earlier bucket in common, which has this pair already. Fields of x and y as in _columns()."""
    p, c, n, s, k = x[:5]
    _, d, m, t, h = (x if y is None else y)[:5]
    for i in range(len(p)):
        j = np.flatnonzero((d != c[i]) & (np.minimum(n[i], m) * 100 >= np.maximum(n[i], m) * percent))
        if y is None:
            j = j[j > i]
        j = j[((s[i] == t[j]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= least]
        same = k[i] == h[j]
        yield i, j[k[i][same.argmax(axis=1)] == key]


def _columns(rows):
    """rep, component, n_shingles, signatures, keys and, where they are there, shingle sets of one block; None for null."""
    if rows is None:
        return None
    rep, component, n = (rows.field(i).to_numpy() for i in range(3))
    signature = np.frombuffer(b"".join(rows.field(3).to_pylist()), np.uint8).reshape(len(rep), -1)
    keys = rows.field(4).flatten().to_numpy().reshape(len(rep), -1)
    sets = [np.frombuffer(x, np.uint64) for x in rows.field(5).to_pylist()] if rows.type.num_fields > 5 else None
    return rep, component, n, signature, keys, sets


def _across_components(members: DataFrame, joined: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, percent: int, hashes: int) -> DataFrame:
    """Links (u, v) of similar documents of one bucket that are in different components: of every two blocks of a bucket's
    documents as many as connect what is linked among them, never all pairs.

    Lengths and signatures come first and leave the documents that could have a link; these meet again with their full shingle
    sets. A pair is compared in the first bucket that it shares.
    """
    p = percent / 100
    least = p - SLACK_SIGMAS * np.sqrt(p * (1 - p) / hashes)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    set_schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])
    left_schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def near(batches):
        for batch in batches:
            for key, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x, y = _columns(a.values), _columns(b.values)
                found = [np.zeros(0, np.int64)]
                for i, j in _candidates(x, y, key, percent, least):
                    if len(j):
                        found += [x[0][i : i + 1], (x if y is None else y)[0][j]]
                reps = np.unique(np.concatenate(found))
                if len(reps):
                    yield to_batch(left_schema, key=np.full(len(reps), key), rep=reps)

    def sets(batches):
        for batch in chunked(batches):
            w = Words(*text_buffers(batch.column(1)), NON_SPACE)
            found = [shingle_set(w.hash[i:j], shingle).tobytes() for i, j in zip(w.first.tolist(), w.first[1:].tolist(), strict=False)]
            yield to_batch(set_schema, rep=batch.column(0), shingles=found)

    def link(batches):
        for batch in batches:
            for key, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x, y = _columns(a.values), _columns(b.values)
                z = x if y is None else y
                root: dict[int, int] = {}
                u, v = [], []

                def find(i: int, root=root) -> int:
                    while (j := root.get(i, i)) != i:
                        i = j
                    return i

                for i, others in _candidates(x, y, key, percent, least):
                    for j in others.tolist():
                        left, right = find(int(x[1][i])), find(int(z[1][j]))
                        if left == right:
                            continue
                        s, t = x[5][i], z[5][j]
                        common = len(np.intersect1d(s, t, assume_unique=True))
                        if common and 100 * common >= percent * (len(s) + len(t) - common):
                            root[max(left, right)] = min(left, right)
                            u.append(min(x[0][i], z[0][j]))
                            v.append(max(x[0][i], z[0][j]))
                if u:
                    yield to_batch(schema, u=u, v=v)

    placed = members.select("key", "rep", "n_shingles").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = stage(placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key"), "mixed")
    placed = stage(placed.join(mixed, "key"), "placed")
    fields = ["rep", "component", "n_shingles", "signature", "keys"]
    short = placed.join(reps.select("rep", "signature", "keys"), "rep")
    met = pair_blocks(short, ["key"], ["rep"], fields, BLOCK, SPREAD)
    with small_arrow_batches(docs.sparkSession):
        left = stage(met.mapInArrow(near, "key long, rep long").distinct(), "near")
        full = stage(among(docs, left.select("rep")).mapInArrow(sets, "rep long, shingles binary"), "sets")
    rows = placed.join(left, ["key", "rep"]).join(reps.select("rep", "signature", "keys"), "rep").join(full, "rep")
    met = pair_blocks(rows, ["key"], ["rep"], [*fields, "shingles"], BLOCK, SPREAD, F.octet_length("shingles") + F.octet_length("signature") + 8 * F.size("keys"))
    with small_arrow_batches(docs.sparkSession):
        out = stage(met.mapInArrow(link, "u long, v long").distinct(), "links")
    unstage(mixed, placed, left, full)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                x, y = (Words(*text_buffers(part.column(i)), NON_SPACE) for i in (2, 3))
                for i in range(part.num_rows):
                    s, t = (shingle_set(w.hash[w.first[i] : w.first[i + 1]], shingle) for w in (x, y))
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep[row + i] = bool(common) and 100 * common >= percent * (len(s) + len(t) - common)
            yield batch.select([0, 1]).filter(pa.array(keep)).cast(schema)

    left, right = docs.select(F.col("doc_id").alias("u"), F.col("text").alias("x")), docs.select(F.col("doc_id").alias("v"), F.col("text").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(compare, "u long, v long").distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row a document row; component_id is the least doc_id reachable."""
    source = documents(docs, id_col, text_col)
    with small_arrow_batches(docs.sparkSession):
        signed = stage(signatures(source, shingle, bands, rows), "signatures")
    named = signed.where("set_id is not null and doc_id is not null")
    classes = stage(named.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stage(
        named.join(classes, "set_id").where("doc_id = rep").dropDuplicates(["set_id"]).select("rep", "n_shingles", "signature", "keys"), "representatives"
    )

    members = reps.select(F.explode("keys").alias("key"), "rep", "n_shingles")
    shared = stage(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    sized = stage(members.join(shared, "key"), "buckets")
    met = sized.groupBy("rep").agg(F.sum("size").alias("met"))
    hub = F.struct(F.col("met").alias("a"), (-F.col("rep")).alias("b"))
    drawn = F.struct(F.xxhash64("rep", "key").alias("a"), F.col("rep").alias("b"))
    members = stage(sized.join(met, "rep").select("key", "rep", "n_shingles", "size", F.when(F.expr("key & 1 = 0"), hub).otherwise(drawn).alias("priority")), "buckets")

    unstage(sized, shared)
    signs = reps.select("rep", "signature")
    leads = stage(members.groupBy("key").agg(F.max(F.struct("priority", "rep")).alias("x")).select("key", F.col("x.rep").alias("lead")), "leads")
    pairs = stage(members.join(leads, "key").where("rep <> lead").select(F.least("lead", "rep").alias("u"), F.greatest("lead", "rep").alias("v")).distinct(), "pairs")
    with small_arrow_batches(docs.sparkSession):
        links = stage(_verified(_similar_signatures(pairs, signs, percent, bands * rows), source, shingle, percent), "links")
    joined = components(links)
    more = _across_components(members, joined, reps, source, shingle, percent, bands * rows)
    if not more.isEmpty():
        first, joined = joined, components(links.union(more))
        unstage(first)
    unstage(members, leads, pairs, links, more, reps)

    where = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(where, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """The documents, with all their columns, of which one of each group stays; of repeated rows of a doc_id the one of least
    text stays (of equal texts, the one whose other columns hash lowest). Rows with a null doc_id all stay."""
    groups = near_duplicate_groups(docs, id_col=id_col, **kwargs)
    kept = groups.where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    named = named.join(kept, named[id_col] == kept["_kept"], "left_semi")
    hashed = [F.col(f.name) for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    order = F.struct(F.coalesce(F.col(kwargs.get("text_col", "text")), F.lit("")), F.xxhash64(*hashed))
    one = named.groupBy(F.col(id_col).alias("_id")).agg(F.min_by(F.struct(*docs.columns), order).alias("_row")).select("_row.*")
    return one.unionByName(docs.where(F.col(id_col).isNull()))
