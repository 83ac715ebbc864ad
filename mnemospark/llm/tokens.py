"""Encoding with a public tokenizer: exact, but each distinct chunk of a text is encoded only once a worker.

A tokenizer that lower-cases, drops white space and pre-tokenizes within it gives a text the ids of its white-space
chunks in a row. Chunks repeat a lot, so their ids come from a per-worker hash table (looked up for a whole batch with
numpy) and only unseen chunks go to the library, many in one call. A chunk counts as known only if its bytes are equal to
those in the table; where hashes agree and bytes don't, the chunk is encoded by itself. Texts with the mark of a special token
or a zero byte go to the library whole, and so does every text if the tokenizer is not made that way (checked when it is loaded).
"""

from __future__ import annotations

import itertools
import json
import os
import re
from functools import lru_cache

import numpy as np

from mnemospark.llm.common import NON_SPACE, Words

END_ID = 1
#: Chunks kept a worker; the table starts anew beyond it, so memory is bounded. Longer chunks are not kept.
TABLE_ENTRIES = 950_000
KEPT_CHUNK_BYTES = 64
_JOINED = 512


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: Chunks of many kinds; texts made of them show whether a tokenizer works chunk by chunk.
_PROBES = ("The", "cat's", "don't", "x", "12345", "3.14", "(a+b)", "...", "'s", "É", "naïve", "Straße", "\u0301", "日本語", "한국어", "👍🏽", "\u00a0", "a\u00a0b", "\u2003", "ﬁ", "I", "am", "_", "$9.99", "A", "\u200d", "Ω")


class HashTable:
    """64-bit keys to entry numbers, open addressing, a whole array of keys at a time."""

    def __init__(self, entries: int):
        self.mask = np.uint64((1 << (2 * entries - 1).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.zeros(int(self.mask) + 1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        at, left, wanted = keys & self.mask, np.arange(len(keys)), keys
        while len(left):
            found = self.keys[at]
            hit = found == wanted
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (found != 0)
            left, wanted, at = left[more], wanted[more], (at[more] + np.uint64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be new and distinct."""
        at = keys & self.mask
        while len(keys):
            _, first = np.unique(at, return_index=True)
            placed = np.zeros(len(keys), bool)
            placed[first] = self.keys[at[first]] == 0
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + np.uint64(1)) & self.mask


#: Chunks of Latin letters, then perhaps other printable ASCII but digits and apostrophes: one or two pieces.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+([!-&(-/:-@\[-`{-~]*)")


class ChunkEncoder:
    """Texts to token ids, with `end_id` after each text (None: nothing after it)."""

    def __init__(self, path: str, end_id: int | None = END_ID, entries: int = TABLE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.entries = Tokenizer.from_file(path), end_id, entries
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self.ends = None
        self.chunkwise = self._is_chunkwise()
        if suffix:  # then the ends of pieces can be told from ids, and many chunks share one call
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
        self._clear()

    def _is_chunkwise(self) -> bool:
        """Whether probe texts have the ids of their chunks in a row; so for tokenizers that drop white space, not for those that code it."""
        probes = [" ".join(_PROBES), "\n\n".join(_PROBES[::-1]), "".join(a + b for a, b in zip(_PROBES, itertools.cycle(["  ", "\t", " \r\n", "\x0b\x0c"]), strict=False))]
        known = {c: ids.tolist() for c, ids in zip(_PROBES, self._library(list(_PROBES)), strict=True)}
        return all(ids.tolist() == [i for c in _CHUNK.findall(text) for i in known[c]] for text, ids in zip(probes, self._library(probes), strict=True))

    def _clear(self) -> None:
        self.table = HashTable(self.entries)
        #: bytes of the known chunks, eight to a number
        self.lanes, self.first_lane, self.bytes, self.lanes_used = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0
        self.flat = np.array([self.end_id or 0], np.uint32)
        self.begin, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.length[0] = 1
        self.used = self.n = 1  # entry 0 is the end id

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids in a row and the number of ids of each chunk."""
        plain = [_PLAIN.fullmatch(c) for c in chunks]
        sizes, parts = np.zeros(len(chunks), np.int64), [None] * len(chunks)
        alone = [i for i, m in enumerate(plain) if m is None or self.ends is None]
        for i, ids in zip(alone, self._library([chunks[i].decode() for i in alone]), strict=True):
            parts[i], sizes[i] = ids, len(ids)
        if self.ends is not None:
            joined = [i for i, m in enumerate(plain) if m is not None]
            groups = [joined[i : i + _JOINED] for i in range(0, len(joined), _JOINED)]
            for group, ids in zip(groups, self._library([b" ".join(chunks[i] for i in g).decode() for g in groups]), strict=True):
                pieces = np.cumsum([1 + bool(plain[i][1]) for i in group])
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != pieces[-1]:  # not as expected: one by one
                    for i, own in zip(group, self._library([chunks[i].decode() for i in group]), strict=True):
                        parts[i], sizes[i] = own, len(own)
                    continue
                cuts = stops[pieces - 1].tolist()
                for i, a, b in zip(group, [0, *cuts], cuts, strict=False):
                    parts[i], sizes[i] = ids[a:b], b - a
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), sizes

    def _remember(self, ids: np.ndarray, sizes: np.ndarray, words: Words, which: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Put coded chunks into the entries, and the bytes of the kept ones; the entries' numbers."""
        while self.n + len(sizes) > len(self.begin):
            self.begin, self.length, self.first_lane, self.bytes = (np.concatenate([x, x * 0]) for x in (self.begin, self.length, self.first_lane, self.bytes))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(ids)))
        at = np.arange(self.n, self.n + len(sizes))
        self.begin[at], self.length[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used, self.n = self.used + len(ids), self.n + len(sizes)

        which, to = which[kept], at[kept]
        n_bytes = words.end[which] - words.start[which]
        n_lanes = -(-n_bytes // 8)
        total = self.lanes_used + int(n_lanes.sum())
        if total > len(self.lanes):
            self.lanes = np.resize(self.lanes, max(2 * len(self.lanes), total))
        self.bytes[to], self.first_lane[to] = n_bytes, self.lanes_used + np.cumsum(n_lanes) - n_lanes
        for lane in range(int(n_lanes.max(initial=0))):
            some = n_lanes > lane
            self.lanes[self.first_lane[to[some]] + lane] = words.lanes(which[some], lane)
        self.lanes_used = total
        return at

    def _differ(self, words: Words, which: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Of words and the kept entries of their hashes, those (their places) whose bytes are not the same."""
        n_bytes = words.end[which] - words.start[which]
        wrong = n_bytes != self.bytes[entry]
        left = np.flatnonzero(~wrong)
        lane = 0
        while len(left):
            other = words.lanes(which[left], lane) != self.lanes[self.first_lane[entry[left]] + lane]
            wrong[left[other]] = True
            lane += 1
            left = left[~other & (n_bytes[left] > 8 * lane)]
        return np.flatnonzero(wrong)

    def _encode_missing(self, words: Words, keys: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Entries of words that the table does not have; words of equal hash are one chunk only if their bytes are equal."""
        new, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
        first = missing[first]
        n_bytes = words.end - words.start
        like = first[which]
        wrong = n_bytes[missing] != n_bytes[like]
        left = np.flatnonzero(~wrong & (missing != like))
        lane = 0
        while len(left) and lane < KEPT_CHUNK_BYTES // 8:
            other = words.lanes(missing[left], lane) != words.lanes(like[left], lane)
            wrong[left[other]] = True
            lane += 1
            left = left[~other & (n_bytes[missing[left]] > 8 * lane)]
        for i in left.tolist():  # longer chunks
            wrong[i] = words.word(missing[i]) != words.word(like[i])
        odd = missing[wrong]
        coded = np.concatenate([first, odd])
        ids, sizes = self._encode_chunks([words.word(i) for i in coded.tolist()])
        kept = np.zeros(len(coded), bool)
        kept[: len(first)] = n_bytes[first] <= KEPT_CHUNK_BYTES
        kept &= self.n + len(coded) <= int(self.table.mask) * 3 // 4
        at = self._remember(ids, sizes, words, coded, kept)
        self.table.add(new[kept[: len(first)]], at[: len(first)][kept[: len(first)]])
        out = at[which]
        out[wrong] = at[len(first) :]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and n + 1 offsets of n texts: all ids in a row (uint32) and the n + 1 offsets in it."""
        raw = data.tobytes()
        if not self.chunkwise or b"<|" in raw or b"\0" in raw:
            return self._encode_some_whole(raw, data, offsets)
        if self.n > self.entries or self.used > 6 * self.entries:
            self._clear()
        words = Words(data, offsets, NON_SPACE)
        keys = words.hash | np.uint64(1 << 63)  # never 0
        entry = self.table.find(keys)
        known = np.flatnonzero(entry >= 0)
        odd = known[self._differ(words, known, entry[known])]
        if len(odd):
            ids, sizes = self._encode_chunks([words.word(i) for i in odd.tolist()])
            entry[odd] = self._remember(ids, sizes, words, odd, np.zeros(len(odd), bool))
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            entry[missing] = self._encode_missing(words, keys, missing)
        counts = words.count
        if self.end_id is not None:
            entry = np.insert(entry, np.cumsum(counts), 0)
            counts = counts + 1
        sizes = self.length[entry].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[entry] - (ends - sizes), sizes) + np.arange(total)]
        at = np.concatenate([[0], ends])
        return ids, at[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)

    def _encode_some_whole(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            if not self.chunkwise or b"<|" in (text := raw[a:b]) or b"\0" in text:
                ids = self._library([raw[a:b].decode()])[0]
                out.append(ids if self.end_id is None else np.append(ids, np.uint32(self.end_id)))
            else:
                out.append(self.encode(data[a:b], np.array([0, b - a]))[0])
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int | None = END_ID) -> ChunkEncoder:
    """One encoder a worker process and tokenizer."""
    return ChunkEncoder(path, end_id)
