"""Byte-level BPE encoding and decoding in batched array rounds.

Distinct pre-tokens of many texts lie in one flat symbol array. Each round finds the rank of
every neighbouring pair by binary search over sorted pair keys, takes each word's lowest rank,
merges its occurrences from left to right and drops the words that have none left. A word of
over ``HEAP_FROM`` symbols, for which rounds would cost the square of its length, is merged
with a heap instead; the ids are the same.

Defined cases: null and empty texts have no ids; texts are never cut; repeated rows are
encoded alike; rows of other columns pass untouched; the special token's own string in a text
is the special token, as the library reads it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderloom.llm import arrays, scratch

HEAP_FROM = 2048
NONE = np.int32(2**31 - 1)


@functools.lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        of_byte = {c: b for b, c in enumerate(byte_symbols())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special, self.special_id = next(iter(added.items()), ("\0none\0", -1))
        size = max([*vocab.values(), *added.values()]) + 1
        content = [b""] * size
        for token, i in vocab.items():
            content[i] = bytes(of_byte[c] for c in token) if all(c in of_byte for c in token) else token.encode()
        for token, i in added.items():
            content[i] = token.encode()
        self.lengths = np.fromiter(map(len, content), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(content), np.uint8)
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        key, made = left << 32 | right, np.array([vocab[m[0] + m[1]] for m in merges], np.int32)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], order.astype(np.int32), made[order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.rank[i], NONE), i

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        symbols = self.first[np.frombuffer(b"".join(data), np.uint8)]
        owner = np.repeat(np.arange(len(data)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if (long := np.flatnonzero(size > HEAP_FROM)).size:
            for w in long.tolist():
                ids = self._by_heap(self.first[np.frombuffer(data[w], np.uint8)].tolist())
                done.append((np.array(ids, np.int32), np.full(len(ids), w)))
            rest = size[owner] <= HEAP_FROM
            symbols, owner = symbols[rest], owner[rest]
        rank, at = self.ranks(symbols[:-1], symbols[1:])
        rank, at = np.append(np.where(owner[1:] == owner[:-1], rank, NONE), NONE), np.append(at, 0)
        while len(symbols):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(symbols)))
            lowest = np.repeat(lowest, length)
            if (over := lowest == NONE).any():
                done.append((symbols[over], owner[over]))
            pick = np.flatnonzero((rank == lowest) & ~over)
            if not len(pick):
                break
            run = np.append(True, pick[1:] != pick[:-1] + 1)  # of one symbol repeated, every other pair
            since = np.arange(len(pick)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            pick = pick[since % 2 == 0]
            symbols[pick] = self.made[at[pick]]
            keep = ~over
            keep[pick + 1] = False
            place = np.cumsum(keep)[pick] - 1
            symbols, owner, rank, at = symbols[keep], owner[keep], rank[keep], at[keep]
            left = np.concatenate((place, place[place > 0] - 1))  # only pairs beside a merged symbol have new ranks
            rank[left] = NONE
            left = left[left + 1 < len(symbols)]
            left = left[owner[left] == owner[left + 1]]
            rank[left], at[left] = self.ranks(symbols[left], symbols[left + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(data), np.int64)
        ids, owner = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(data)).astype(np.int64)

    def _pair(self, a: int, b: int) -> tuple[int, int] | None:
        key = a << 32 | b
        i = int(np.searchsorted(self.keys, key))
        return (int(self.rank[i]), int(self.made[i])) if i < len(self.keys) and self.keys[i] == key else None

    def _by_heap(self, s: list[int]) -> list[int]:
        n = len(s)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        known: dict[tuple[int, int], tuple[int, int] | None] = {}
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0:
                pair = s[i], s[j]
                if pair not in known:
                    known[pair] = self._pair(*pair)
                if found := known[pair]:
                    heapq.heappush(heap, (found[0], i, *pair, found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in s if x >= 0]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text from its ids; invalid bytes read as the replacement character."""
        lengths = self.lengths[ids]
        flat = self.bytes[arrays.ragged(self.starts[ids], lengths)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)].tolist()
        out, a = [], 0
        for b in ends:
            out.append(flat[a:b].decode("utf-8", "replace").encode())
            a = b
        return out


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(2)
def _cache(path: str) -> arrays.PieceCache:
    return arrays.PieceCache(vocabulary(path).encode_words)


def encode(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    v = vocabulary(path)
    return arrays.encode_texts(_cache(path), texts, v.special, v.special_id)


@functools.lru_cache(1)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of each id with a comma behind, right-aligned, and which of the columns count."""
    width = len(str(size)) + 1
    text = np.frombuffer("".join(f"{i},".rjust(width) for i in range(size)).encode(), np.uint8).reshape(size, width)
    return text, text != 0x20


def id_digests(ids: np.ndarray, counts: np.ndarray, size: int) -> list[str]:
    """SHA-256 of each text's decimal ids joined by commas."""
    text, used = _decimals(size)
    flat = text[ids][used[ids]].tobytes()
    ends = np.concatenate(([0], np.cumsum(used.sum(axis=1)[ids])))[np.cumsum(counts)].tolist()
    out, a = [], 0
    for b in ends:
        out.append(hashlib.sha256(flat[a : max(a, b - 1)]).hexdigest())
        a = b
    return out


def tokenize(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the ids of every whole text."""
    scratch.ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw in arrays.text_chunks(batch.column(1)):
                ids, counts = encode(path, [x.decode() for x in raw])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(arrays.tidy(work), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode every whole text; see the query for the columns."""
    scratch.ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo, hi, raw in arrays.text_chunks(batch.column(1)):
                ids, counts = encode(path, [x.decode() for x in raw])
                back = [hashlib.sha256(x).hexdigest() for x in v.decode(ids, counts)]
                cols = [pa.array(counts, pa.int64()), pa.array(id_digests(ids, counts, len(v.lengths))), pa.array(back)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(arrays.tidy(work), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
