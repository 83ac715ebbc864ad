"""Token files, packing and length histogram against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemospark.llm import common, packing, token_counts, token_files
from mnemospark.llm.tokens import ChunkEncoder, default_path

ODD = [
    None, "", "  ", "a<|endoftext|>b x", "x\x1cy \x0b z\x85q r", "é ́x Σς ΟΔΟΣ İ ſ ﬁ", "it's don't 's 'LL ''s", " a　b", "1234 ²³ ⅷ", "a\x00b",
    "日本 語テキスト👍🏽 x", "'\ns", "É. Öß!! a= ≠ ×÷ aé?! x", "hello " * 3000, "word", "word", "x" * 5000,
]
SCHEMA = "doc_id long, text string, start string, length int"


@pytest.fixture(scope="module")
def library():
    return ChunkEncoder(default_path()).tokenizer


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1000 - 7 * i, t, "x", 3) for i, t in enumerate(ODD)] + [(5, "again and again", "x", 1)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, library):
    folder = token_files.write_token_files(docs)
    got = sorted(token_files.with_crc32(token_files.read_token_files(spark, folder)).collect(), key=lambda r: r.start)
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = ids_of(library, r.text)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.read_manifest(folder)["ids"] == start


def test_token_files_of_nothing_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_files.read_token_files(spark, token_files.write_token_files(empty)).count() == 0
    df = spark.createDataFrame([(None, "a b", None, None)], SCHEMA)
    row = token_files.read_token_files(spark, token_files.write_token_files(df)).first()
    assert row.doc_id is None and row.n_tokens == 3
    df = spark.createDataFrame([(None, "a", None, None), (-(1 << 63), "b", None, None), (0, "c", None, None), (None, "d", None, None)], SCHEMA)
    rows = token_files.read_token_files(spark, token_files.write_token_files(df)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, -(1 << 63), 0]


def test_packing_places_every_piece_once(spark, docs, library):
    rows = token_files.with_crc32(packing.pack(docs)).collect()
    want = []
    for r in docs.collect():
        ids = ids_of(library, r.text)
        want += [(r.doc_id, k, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) == -(-sum(r.length for r in rows) // 4096)


def test_packing_sends_texts_in_small_batches_and_no_ids(spark, docs, monkeypatch):
    limits, write = {}, packing.stage

    def stage(df, name):
        limits[name] = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
        return write(df, name)

    monkeypatch.setattr(packing, "stage", stage)
    placed = packing.pack(docs)
    assert limits["pieces"] == "8m" and limits["piece-ranks"] != "8m"
    assert "MapInArrow" not in placed._jdf.queryExecution().executedPlan().toString()


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_all_counts_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(256, rng.lognormal(3.5, 1.0, 3000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=257)
    plan = packing.pack_counts(counts, 256)
    used = np.zeros(257, int)
    for times, parts in plan:
        assert sum(n * k for n, k in parts) <= 256
        for n, k in parts:
            used[n] += times * k
    assert (used == counts).all()
    assert sum(t for t, _ in plan) <= 1.02 * -(-lengths.sum() // 256) + 1


def test_exact_complements_of_one_two_and_three():
    counts = np.zeros(11, int)
    counts[[10, 7, 3, 6, 1]] = [2, 1, 1, 1, 4]
    plan = packing.pack_counts(counts, 10)
    assert sum(t for t, _ in plan) == 4 and (1, [(6, 1), (1, 4)]) in plan


def test_length_histogram_and_answers(spark, docs, library):
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(docs))
    sizes = np.array([len(ids_of(library, r.text)) for r in docs.collect()])
    for r in sums.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_from, r.docs_to) == ((sizes == n).sum(), (sizes >= n).sum(), (sizes <= n).sum())
        assert r.tokens_from == sizes[sizes >= n].sum() and r.truncated_total == np.minimum(sizes, n).sum()
    got = {r.max_tokens: (r.docs_cut, r.tokens_left) for r in token_counts.truncated_totals(sums, [1, 4, 100_000]).collect()}
    assert got == {k: ((sizes > k).sum(), np.minimum(sizes, k).sum()) for k in (1, 4, 100_000)}
    half = token_counts.quantiles(sums, [0.5]).first().n_tokens
    assert half == np.sort(sizes)[-(-len(sizes) // 2) - 1]


def test_length_histogram_of_nothing(spark):
    empty = token_counts.with_suffix_sums(token_counts.length_histogram(spark.createDataFrame([], SCHEMA)))
    assert empty.count() == 0 and token_counts.quantiles(empty, [0.5]).first().n_tokens is None


def thue_morse(n=2048):
    bits = np.array([bin(i).count("1") % 2 for i in range(n)])
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def coded(code, texts):
    raw = [t.encode() for t in texts]
    ids, offsets = code.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_structured_chunks_do_not_share_ids(spark, library):
    """A string and its complement that any polynomial hash modulo a power of two confuses."""
    texts = [*thue_morse(), *thue_morse(64), *thue_morse()[::-1], " ".join(thue_morse(32) * 3)]
    want = [ids_of(library, t) for t in texts]
    assert coded(ChunkEncoder(default_path()), texts) == want
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    files = token_files.with_crc32(token_files.read_token_files(spark, token_files.write_token_files(df)))
    assert {r.doc_id: r.ids_crc32 for r in files.collect()} == dict(enumerate(map(crc, want)))
    packed = {r.doc_id: bytes(r.ids) for r in packing.pack(df).collect()}
    assert packed == {i: np.array(x, "<u4").tobytes() for i, x in enumerate(want)}
    assert {r.n_tokens: r.n_docs for r in token_counts.length_histogram(df).collect()} == Counter(map(len, want))


def test_equal_hashes_of_different_chunks(monkeypatch, library):
    """With hashes of three bits nearly all chunks collide; bytes tell them apart."""
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + [" ".join(f"w{rng.randrange(60)}{'x' * rng.randrange(90)}" for _ in range(80)) for _ in range(9)]
    want = [ids_of(library, t) for t in texts]
    monkeypatch.setattr(common, "mix", lambda x: x & np.uint64(7))
    code = ChunkEncoder(default_path())
    assert coded(code, texts) == want and coded(code, texts[::-1]) == want[::-1]


def test_tokenizer_that_codes_white_space_gets_whole_texts():
    import public_tokenizers

    code = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), None)
    texts = [t or "" for t in ODD]
    assert not code.chunkwise and ChunkEncoder(default_path()).chunkwise
    assert coded(code, texts) == [code.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
