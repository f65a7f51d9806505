"""Runs of words that repeat with a period, found by counting matches at each lag.

A text is its words. For each lag the number of places where a word equals the one that far on is
counted exactly: words that occur often (heavy) by the autocorrelation of their places, one
Fourier transform each and one back for their sum; the others (light) by the differences of all
their pairs, over a whole batch of texts at once. A run of period q and length n holds n - q such
places in a row, so only lags with enough of them are looked at island by island, the smallest
first. What a run of period p found before explains at its multiples is taken off the counts
there: a run of a larger smallest period q shares fewer than q words with it, hence none of these
places. A text of one repeated word is therefore one scan, and results do not depend on which
words count as heavy.

A run is a stretch of words with smallest period q, not to be extended to either side, of at least
``least`` words and ``times`` periods. Runs of three periods and more with different smallest
periods never contain each other.

Each text is worked on whole and by itself, without a shuffle. Places and words are told apart
exactly (dictionary codes of their bytes, no hashes).

Defined cases: null and word-less texts have no runs and collapse to nothing; repeated rows count
alike; no rows give no rows; other columns do not matter; ``planted`` leaves rows with a null
doc_id as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderloom.llm import arrays, scratch

#: From so many occurrences in one text on a word is heavy, or from the square root of the text's words on.
HEAVY = 32

#: (doc_id, number of words) to the order in which its words are taken, or None
Order = Callable[[int | None, int], "np.ndarray | None"]


def coded(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code of each word, bytes of the text, start and end of each word); equal codes are equal words."""
    buf = np.frombuffer(text, np.uint8)
    word = np.concatenate(([False], ~arrays.SPACE[buf], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[0::2], edges[1::2]
    ends = np.append(0, np.cumsum(end - start))
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf[word[1:-1]])])
    return whole.dictionary_encode().indices.to_numpy().astype(np.int64), buf, start, end


def heavy_counts(codes: np.ndarray, words: np.ndarray, lags: int) -> np.ndarray:
    """How often each of some words stands 0 .. lags places before itself: autocorrelation by Fourier transforms."""
    n = len(codes)
    size = 1 << (n + lags).bit_length()  # beyond n + lags nothing wraps round into the lags
    power = np.zeros(size // 2 + 1)
    for w in words.tolist():
        f = np.fft.rfft((codes == w).astype(float), size)
        power += f.real**2 + f.imag**2
    return np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)


def light_counts(place: np.ndarray, word: np.ndarray, base: np.ndarray, limit: np.ndarray, total: int) -> np.ndarray:
    """Number of pairs of equal words at each lag. place, word: sorted by word; base: of the counts of each one's text; limit: its largest lag."""
    out = np.zeros(total, np.int64)
    k, at = 1, np.arange(len(place))
    while True:
        at = at[at + k < len(place)]
        at = at[word[at + k] == word[at]]
        if not len(at):
            return out
        gap = place[at + k] - place[at]
        near = gap <= limit[at]
        at = at[near]  # pairs further apart lie beyond every later lag too
        out += np.bincount(base[at] + gap[near], minlength=total)
        k += 1


def counts_of(codes: list[np.ndarray], least_heavy: int = HEAVY) -> list[np.ndarray]:
    """For each text the number of equal pairs at lags 0 .. a third of its words (at lag 0 none)."""
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    limit = sizes // 3
    base = np.cumsum(limit + 1) - (limit + 1)
    many = []
    keys, step = [], 0
    for c, n in zip(codes, sizes.tolist(), strict=True):
        often = np.bincount(c) if n else np.zeros(0, np.int64)
        heavy = np.flatnonzero(often >= max(least_heavy, int(n**0.5)))
        many.append(heavy)
        own = c + step
        if len(heavy):
            own = np.where(np.isin(c, heavy), -1, own)
        keys.append(own)
        step += len(often)
    key = np.concatenate([*keys, np.zeros(0, np.int64)])
    text = np.repeat(np.arange(len(codes)), sizes)
    place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    light = np.flatnonzero(key >= 0)
    light = light[np.argsort(key[light], kind="stable")]
    flat = light_counts(place[light], key[light], base[text[light]], limit[text[light]], int((limit + 1).sum()))
    out = [flat[b : b + m + 1] for b, m in zip(base.tolist(), limit.tolist(), strict=True)]
    for i, heavy in enumerate(many):
        if len(heavy) and limit[i]:
            out[i] = out[i] + heavy_counts(codes[i], heavy, int(limit[i]))
            out[i][0] = 0
    return out


def _inside(start: np.ndarray, end: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each stretch lies in one of the runs (start, length, period)."""
    if not runs:
        return np.zeros(len(start), bool)
    known = np.array(sorted((s, s + n) for s, n, _ in runs))
    reach = np.maximum.accumulate(known[:, 1])
    at = np.searchsorted(known[:, 0], start, side="right") - 1
    return (at >= 0) & (reach[np.maximum(at, 0)] >= end)


def runs_of(codes: np.ndarray, counts: np.ndarray, *, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. counts: equal pairs at each lag up to a third of the words."""
    lags = np.arange(len(counts))
    need = np.maximum(np.maximum(least - lags, (times - 1) * lags), 1)
    left = counts.copy()  # what no run found so far explains
    found: list[tuple[int, int, int]] = []
    q = 0
    while True:
        more = np.flatnonzero(left[q + 1 :] >= need[q + 1 :])
        if not len(more):
            return sorted(found, key=lambda r: (r[0], r[2]))
        q += 1 + int(more[0])
        equal = np.concatenate(([False], codes[q:] == codes[:-q], [False]))
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        start, size = edges[0::2], edges[1::2] - edges[0::2]
        long = size >= need[q]
        start, size = start[long], size[long] + q
        new = ~_inside(start, start + size, found)
        for s, n in zip(start[new].tolist(), size[new].tolist(), strict=True):
            found.append((s, n, q))
            far = min(n, len(left))
            left[2 * q : far : q] -= n - lags[2 * q : far : q]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: none that a run holds behind its first period."""
    cover = np.zeros(n + 1, np.int64)
    for s, size, q in runs:
        cover[s + q] += 1
        cover[s + size] -= 1
    return np.cumsum(cover)[:n] == 0


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, compared exactly; then the first, then that of least period."""
    best = None
    for s, n, q in runs:  # by start, then period: the first of equals stays
        if best is None or n * best[2] > best[1] * q:
            best = s, n, q
    return best


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of a document's n words in which one of ten documents repeats its end, by the crc32 of its doc_id."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def collapsed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(start):
        return b""
    size = end - start + 1
    at = arrays.ragged(start, size)
    gap = np.cumsum(size) - 1
    at[gap] = 0
    out = buf[at]
    out[gap] = 0x20
    return out[:-1].tobytes()


def _results(ids: list, raw: list[bytes], order: Order | None, how: dict) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs, collapsed text) of each text."""
    read = [coded(t) for t in raw]
    if order:
        for k, (i, (codes, buf, start, end)) in enumerate(zip(ids, read, strict=True)):
            if (by := order(i, len(codes))) is not None:
                read[k] = codes[by], buf, start[by], end[by]
    for (codes, buf, start, end), counts in zip(read, counts_of([r[0] for r in read]), strict=True):
        runs = runs_of(codes, counts, **how)
        keep = kept_words(len(codes), runs) if runs else slice(None)
        yield runs, collapsed(buf, start[keep], end[keep])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _applied(docs: DataFrame, row, columns: list[tuple[str, pa.DataType]], schema: str, order: Order | None, how: dict) -> DataFrame:
    scratch.ship(docs.sparkSession)
    names = ["doc_id", *(c for c, _ in columns)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, raw in arrays.text_chunks(batch.column(1)):
                rows = [row(*r) for r in _results(ids[lo:hi], raw, order, how)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(arrays.tidy(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def find_runs(docs: DataFrame, *, order: Order | None = None, **how) -> DataFrame:
    """(doc_id, runs, collapsed) of every whole text: its runs, and the text without their repeats, words joined by one space."""
    row = lambda runs, text: ([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], text.decode())
    return _applied(docs, row, [("runs", pa.list_(RUN)), ("collapsed", pa.string())], "runs array<struct<start:long,length:long,period:long>>, collapsed string", order, how)


def digests(docs: DataFrame, *, order: Order | None = planted, **how) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): what ``find_runs`` gives, in digests."""

    def row(runs: list[tuple[int, int, int]], text: bytes) -> tuple:
        s, n, q = greatest(runs) or (None, None, None)
        told = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        return len(runs), s, n, q, None if q is None else 1000 * n // q, hashlib.sha256(told).hexdigest(), hashlib.sha256(text).hexdigest()

    longs = [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    return _applied(
        docs, row, [*longs, ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())],
        "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", order, how,
    )
