"""Vectorised text primitives: word and pre-token boundaries and rolling 64-bit hashes.

A polynomial hash over 64-bit wrap-around integers is prefix-summable, so the hash of any
stretch is one subtraction and one product; ``mix`` then spreads it over all bits.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE2 = U(0xC2B2AE3D27D4EB4F)
#: Bytes or characters that one vectorised step holds, unless one text alone is longer.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; one array is held for each base."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(1 << max(10, (n - 1).bit_length()), base, U)
        held[0] = 1
        held = _powers[int(base)] = np.multiply.accumulate(held)
    return held[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


class Rolling:
    """Hashes of stretches [a, b) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse(base), n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k consecutive values."""
        n = len(self.sums) - 1 - k + 1
        return mix((self.sums[k:] - self.sums[: n]) * self.back[:n])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    have = 1
    out = a
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if have < w else out


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(work: Work) -> Work:
    """The same work, after which a worker that waits for its next task gives freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every libc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to limit at most, or of one item."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(lo, hi, UTF-8 bytes of the texts lo .. hi) of a column; a chunk's texts alone are taken out of it at once."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for lo, hi in chunks(sizes, limit):
        yield lo, hi, raw_bytes(column.slice(lo, hi - lo))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, start, end) of each word (runs of other than ASCII white space) of the texts joined by a line end."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(buf):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, z
    word = np.concatenate(([False], ~SPACE[buf], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[0::2], edges[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return Rolling(_BYTE[buf]).of(start, end), np.searchsorted(ends, start, side="right"), start, end


# -- pre-tokens of the byte-level vocabulary ------------------------------------------------

LETTER, NUMBER, OTHER, WHITE = range(4)
#: The white space of Unicode, and the endings that an apostrophe takes along.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


#: Letters and numbers that Unicode 16 added, for Pythons that know 15 only.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@functools.lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point, from its Unicode category."""
    out = np.full(0x110000, OTHER, np.int8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            out[cp] = LETTER
        elif c == "N":
            out[cp] = NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[WHITE_SPACE] = WHITE
    return out


@functools.lru_cache(1)
def _char_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=U) * U(0xA0761D6478BD642F))


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, text index, code points of the joined texts) of all pre-tokens of some texts.

    The rule: an optional blank and a run of letters, of numbers or of other characters; an
    apostrophe that starts such a run takes a listed ending along; of white space, the last
    character before something else stands apart (and is that blank, if it is one).
    """
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), z, cp
    kind = char_classes()[cp]
    first = np.zeros(n + 1, bool)  # first characters of texts
    first[0] = True
    first[ends] = True
    cut = first.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    last = np.concatenate((white[:-1] & ~white[1:] & ~first[1:n], [False]))  # last white one before something else
    blank = last & (cp == 0x20)
    cut[:n] |= last
    cut[1:n] &= ~blank[:-1] | first[1:n]
    quote = np.flatnonzero((cp[:-1] == 0x27) & cut[: n - 1] & (kind[1:] == LETTER) & ~first[1:n])
    quote = quote[(quote == 0) | ~blank[quote - 1] | first[quote]]
    if len(quote):
        limit = ends[np.searchsorted(ends, quote, side="right")]
        for q, stop in zip(quote.tolist(), limit.tolist(), strict=True):
            for e in ENDINGS:
                if joined.startswith(e, q + 1) and q + 1 + len(e) <= stop:
                    cut[q + 1] = False
                    cut[q + 1 + len(e)] = True
                    break
    cut[n] = True
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    return start, end, Rolling(_char_values()[cp]).of(start, end), np.searchsorted(ends, start, side="right"), cp


@functools.lru_cache(1)
def lower_case() -> np.ndarray:
    """The lower-case code point of each code point that has a single one, else itself."""
    out = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        if len(low := chr(cp).lower()) == 1:
            out[cp] = ord(low)
    return out


@dataclass
class LetterRuns:
    """Runs of letters of some texts, lower-cased one code point for one, so that offsets are the text's own."""

    cp: np.ndarray  # of the texts as they are, each followed by a line end
    low: np.ndarray  # the same in lower case
    start: np.ndarray  # of each run in cp
    end: np.ndarray
    key: np.ndarray  # a hash of each run
    text: np.ndarray  # index of each run's text
    first: np.ndarray  # where each text starts in cp


def letter_runs(texts: list[str]) -> LetterRuns:
    joined = "\n".join([*texts, ""])
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = np.append(0, first)
    low = lower_case()[cp]
    letter = np.concatenate(([False], char_classes()[cp] == LETTER, [False]))
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = edges[0::2], edges[1::2]
    key = Rolling(_char_values()[low]).of(start, end) if len(cp) else np.zeros(0, U)
    return LetterRuns(cp, low, start, end, key, np.searchsorted(first, start, side="right") - 1, first[:-1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, .. of consecutive stretches."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


class SpanCache:
    """What ``encode`` says of distinct words, held in flat arrays of bounded size.

    A hash only finds the place: every occurrence is compared with the held word character by
    character, and those that differ (texts can be made to collide) are encoded by themselves.
    encode: of some words, (ids of all in a row, number of ids of each).
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1 << 19, most_chars: int = 1 << 23):
        self.encode, self.most, self.most_chars = encode, most, most_chars
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.n, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.chars, self.place, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = i < len(self.keys)
        hit[inside] = self.keys[i[inside]] == keys[inside]
        return i, hit

    def _add(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray, cp: np.ndarray) -> None:
        flat, n = self.encode(strings(cp, start, end))
        size = end - start
        keys = np.concatenate((self.keys, keys))
        at = np.concatenate((self.at, len(self.ids) + np.cumsum(n) - n))
        place = np.concatenate((self.place, len(self.chars) + np.cumsum(size) - size))
        n, size = np.concatenate((self.n, n)), np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, flat))
        self.chars = np.concatenate((self.chars, cp[ragged(start, end - start)]))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.n, self.place, self.size = (x[order] for x in (keys, at, n, place, size))

    def spans(self, start: np.ndarray, end: np.ndarray, key: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, n, ids): the ids of the word cp[start:end] are ids[at : at + n]. key: a hash of each word."""
        distinct, where, inverse_ = np.unique(key, return_index=True, return_inverse=True)
        _, hit = self._find(distinct)
        if not hit.all():
            if len(self.keys) > self.most or len(self.chars) > self.most_chars:
                self._clear()
                hit[:] = False
            new = np.flatnonzero(~hit)
            self._add(distinct[new], start[where[new]], end[where[new]], cp)
        i, _ = self._find(distinct)
        slot = i[inverse_]
        at, n, ids = self.at[slot], self.n[slot], self.ids
        odd = self._differ(slot, start, end - start, cp)
        if len(odd):
            words = strings(cp, start[odd], end[odd])
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            flat, m = self.encode(list(number))
            own = np.fromiter((number[w] for w in words), np.int64, len(words))
            at[odd], n[odd] = len(ids) + (np.cumsum(m) - m)[own], m[own]
            ids = np.concatenate((ids, flat))
        return at, n, ids

    def _differ(self, slot: np.ndarray, start: np.ndarray, size: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """Occurrences whose characters are not those of the word held under their hash."""
        bad = self.size[slot] != size
        like = np.flatnonzero(~bad)
        if len(like):
            other = cp[ragged(start[like], size[like])] != self.chars[ragged(self.place[slot[like]], size[like])]
            if other.any():
                bad[like] = np.logical_or.reduceat(other, np.cumsum(size[like]) - size[like])
        return np.flatnonzero(bad)


class PieceCache(SpanCache):
    """The same for pre-tokens of whole texts."""

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        start, end, key, text, cp = pretokens(texts)
        at, n, ids = self.spans(start, end, key, cp)
        counts = np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)
        return ids[ragged(at, n)], counts


def strings(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The words cp[start:end] of code points."""
    flat = cp[ragged(start, end - start)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(end - start)
    return [flat[a:b] for a, b in zip((ends - (end - start)).tolist(), ends.tolist(), strict=True)]


def split_special(texts: list[str], special: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at a special token: (parts, index of each part's text, whether the token follows)."""
    if not any(special in t for t in texts):
        return texts, np.arange(len(texts)), np.zeros(len(texts), bool)
    parts, owner, follows = [], [], []
    for i, t in enumerate(texts):
        own = t.split(special)
        parts += own
        owner += [i] * len(own)
        follows += [True] * (len(own) - 1) + [False]
    return parts, np.array(owner, np.int64), np.array(follows, bool)


def encode_texts(cache: PieceCache, texts: list[str], special: str, special_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts in a row and the number of ids of each; special becomes its own id."""
    parts, owner, follows = split_special(texts, special)
    ids, counts = cache.look_up(parts)
    if follows.any():
        at = np.cumsum(counts)[follows]
        ids = np.insert(ids, at, special_id)
        counts = counts + follows
    return ids, np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
