"""Exact substring dedup over a compacted De Bruijn graph of word windows.

Edges of the graph are the windows of ``window`` words; consecutive windows overlap in all but
one word. Windows are compacted before they are shuffled: a run of consecutive windows that
share the occurrence of their least inner gram (the minimizer, chosen by content) is one path,
and equal windows always lie in paths of equal minimizer. The steps:

1. minimizers that occur once have no repeated edge; a count and a semi join drop their paths;
2. of equal paths (same minimizer and same words) the earliest source coordinate stands;
3. a minimizer with one distinct path does not branch: the whole path repeats as a unit;
4. paths of branching minimizers, one for each content, are expanded to edges; of equal edges
   the earliest coordinate stands;
5. back at each document, source coordinates decide: a window of a repeated path is removed
   unless it stands by step 3 or 4, and the words that removed windows cover go.

Rolling hashes only choose minimizers, where a collision makes a path branch and costs time.
What is equal is told by 128-bit BLAKE2b digests of the words themselves, read at the coordinates
of the path or edge. Rows that move are paths and coordinates; text moves twice, by document.
Hot passages are met by partial aggregates and by joins that adaptive execution can split.

Defined cases: null texts have no words; texts below the window keep all words; documents
with a null doc_id count as the smallest id; rows that repeat a doc_id and its text are one
document and all get its result; rows that share a doc_id and differ in text are documents of
their own, in the order of their texts' SHA-256; no rows give no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm import arrays, scratch

POSITIONS = 22  # bits; longer stretches of words are cut, with an overlap


def _inner(window: int) -> tuple[int, int]:
    """(words of a minimizer gram, grams in a window)."""
    gram = max(1, window * 3 // 10)
    return gram, window - gram + 1


class Words:
    """Words of some texts in one buffer, set apart by one blank each."""

    def __init__(self, texts: list[bytes]):
        parts = [b" ".join(t.split()) for t in texts]
        self.buffer = b"\n".join(parts)
        self.hashes, self.text, self.start, self.end = arrays.word_hashes(parts)

    def digests(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of the digest of each run of words [first, stop)."""
        buffer, blake = self.buffer, hashlib.blake2b
        spans = zip(self.start[first].tolist(), self.end[stop - 1].tolist(), strict=True)
        flat = np.frombuffer(b"".join([blake(buffer[a:b], digest_size=16).digest() for a, b in spans]), np.int64).reshape(-1, 2)
        return flat[:, 0], flat[:, 1]


def _paths(words: np.ndarray, text: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(minimizer, text, first word of all, first word in the text, windows) of the paths of some texts' word hashes."""
    gram, grams = _inner(window)
    begins = np.searchsorted(text, text)  # index of the first word of each word's text
    most = (1 << POSITIONS) - window
    for lo in range(0, len(words), most):
        hi = min(len(words), lo + most + window - 1)
        n = hi - lo - window + 1
        if n <= 0:
            continue
        w, t = words[lo:hi], text[lo:hi]
        g = arrays.Rolling(w).grams(gram)
        bits = np.uint64(POSITIONS)
        least = arrays.sliding_min(g >> bits << bits | np.arange(len(g), dtype=np.uint64), grams)
        at = (least & np.uint64((1 << POSITIONS) - 1)).astype(np.int64)
        ok = t[window - 1 :] == t[:n]
        new = ok.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
        yield g[at[first]], t[first], first + lo, first + lo - begins[first + lo], stop - first


def minimizers(docs: DataFrame, window: int) -> DataFrame:
    """(m): the minimizer of every path."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in arrays.text_chunks(batch.column(0)):
                words, text, _, _ = arrays.word_hashes(texts)
                for m, *_ in _paths(words, text, window):
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64))], ["m"])

    return docs.select("text").mapInArrow(arrays.tidy(work), "m long")


def paths(docs: DataFrame, window: int) -> DataFrame:
    """(m, s1, s2, doc_id, at): at holds the first word's index and, in 8 bits, the number of windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, texts in arrays.text_chunks(batch.column(1)):
                words = Words(texts)
                for m, t, begin, first, n in _paths(words.hashes, words.text, window):
                    s1, s2 = words.digests(begin, begin + n + window - 1)
                    ids = batch.column(0).take(pa.array(t + lo))
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(s1), pa.array(s2), ids, pa.array(first << 8 | n)], ["m", "s1", "s2", "doc_id", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(arrays.tidy(work), f"m long, s1 long, s2 long, doc_id {kind}, at long")


def _edges(docs: DataFrame, window: int) -> DataFrame:
    """(h1, h2, doc_id, at) of every edge of the listed paths. docs: doc_id, text, paths array<long>."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in arrays.text_chunks(batch.column(1)):
                words = Words(texts)
                lists = batch.column(2).slice(lo, hi - lo)
                packed = lists.flatten().to_numpy()
                owner = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy())
                first, n = packed >> 8, packed & 255
                at = arrays.ragged(np.searchsorted(words.text, owner) + first, n)
                where = arrays.ragged(first, n)
                h1, h2 = words.digests(at, at + window)
                ids = batch.column(0).take(pa.array(np.repeat(owner, n) + lo))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), ids, pa.array(where)], ["h1", "h2", "doc_id", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "paths").mapInArrow(arrays.tidy(work), f"h1 long, h2 long, doc_id {kind}, at long")


def covered(n_words: int, packed: np.ndarray, window: int) -> np.ndarray:
    """Which words go. packed: first word, 8 bits of windows, 1 bit that says whether they stand."""
    n = max(0, n_words - window + 1)
    marks = []
    for stands in (0, 1):
        own = packed[(packed & 1) == stands] >> 1
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.minimum(own >> 8, n), 1)
        np.add.at(edge, np.minimum((own >> 8) + (own & 255), n), -1)
        marks.append(np.cumsum(edge[:n]) > 0)
    gone = np.flatnonzero(marks[0] & ~marks[1])
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + window, -1)
    return np.cumsum(edge[:n_words]) > 0


def identity(docs: DataFrame) -> Column:
    """What tells documents apart: doc_id, and where some rows share one, 120 bits of the text's SHA-256 too."""
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return F.col("doc_id")
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    part = lambda at: F.conv(F.substring(text, at, 15), 16, 10).cast("long")
    return F.struct("doc_id", part(1).alias("t1"), part(16).alias("t2"))


def repeats(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """(doc_id, packed): for each document with repeated paths, what goes and what stands."""
    spark = docs.sparkSession
    if not 2 <= window <= 250:
        raise ValueError("window is from 2 to 250 words")
    scratch.ship(spark)
    # written out, so that the joins below meet plain shuffles, whose hot partitions adaptive execution can split
    often = scratch.stash(minimizers(docs, window).groupBy("m").agg(F.count("*").alias("n")).filter("n > 1").select("m"), "often")
    scratch.sweep(spark)
    found = scratch.stash(paths(docs, window).join(often, "m", "left_semi"), "paths")
    scratch.sweep(spark)
    place = F.struct("doc_id", "at")
    # equal paths have equal lengths, so the digest fixes the number of windows
    earliest = scratch.stash(found.groupBy("m", "s1", "s2").agg(F.min(place).alias("o")).select("m", "o.doc_id", "o.at"), "earliest")
    branching = scratch.stash(earliest.groupBy("m").agg(F.count("*").alias("n")).filter("n > 1").select("m"), "branching")
    straight = earliest.join(branching, "m", "left_anti").select("doc_id", "at")
    forks = earliest.join(branching, "m", "left_semi").groupBy("doc_id").agg(F.collect_list("at").alias("paths"))
    opened = docs.select("doc_id", "text").withColumnRenamed("doc_id", "own").join(forks, F.col("own").eqNullSafe(F.col("doc_id"))).select("doc_id", "text", "paths")
    edges = _edges(opened, window)
    standing = edges.groupBy("h1", "h2").agg(F.min(place).alias("o")).select("o.doc_id", (F.col("o.at") * 256 + 1).alias("at"))
    stands = scratch.stash(standing.unionByName(straight), "standing")
    scratch.sweep(spark)
    both = found.select("doc_id", (F.col("at") * 2).alias("x")).unionByName(stands.select("doc_id", (F.col("at") * 2 + 1).alias("x")))
    return both.groupBy("doc_id").agg(F.collect_list("x").alias("packed"))


def remove_repeats(docs: DataFrame, *, window: int = 20, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every document."""
    own = docs.select(identity(docs).alias("key"), "doc_id", "text")
    spans = repeats(own.select(F.col("key").alias("doc_id"), "text"), window=window).withColumnRenamed("doc_id", "of")
    joined = own.join(spans, F.col("key").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "packed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, text = [], [], [], []
            none = batch.column(2).is_null().to_pylist()
            for i, raw in enumerate(t for _, _, texts in arrays.text_chunks(batch.column(1)) for t in texts):
                words = raw.split()
                n, removed = len(words), 0
                if not none[i]:
                    gone = covered(n, batch.column(2)[i].values.to_numpy(), window)
                    removed = int(gone.sum())
                    words = list(compress(words, (~gone).tolist()))
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(removed)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    text.append(kept.decode())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(text, pa.string())] * with_text, names + ["kept"] * with_text)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(arrays.tidy(work), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def strip_repeats(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """docs with repeated spans cut from text (the kept words joined by one blank) and n_chars set anew.

    Texts that lose nothing stay byte for byte, and every row stays a row.
    """
    key, of, packed_ = scratch.unused(docs, "key", "of", "packed")
    own = docs.withColumn(key, identity(docs))
    spans = repeats(own.select(F.col(key).alias("doc_id"), "text"), window=window).withColumnsRenamed({"doc_id": of, "packed": packed_})
    joined = own.join(spans, F.col(key).eqNullSafe(F.col(of)), "left").select(*scratch.named(docs), packed_)
    at = {c: i for i, c in enumerate(docs.columns)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, column = batch.column(len(at)), batch.column(at["text"])
            changed: dict[int, str] = {}
            for i in np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False)).tolist():
                words = (column[i].as_py() or "").encode().split()
                gone = covered(len(words), packed[i].values.to_numpy(), window)
                if gone.any():
                    changed[i] = b" ".join(compress(words, (~gone).tolist())).decode()
            cols = [batch.column(i) for i in range(len(at))]
            if changed:  # texts that stay are not taken out of their column
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                replace = lambda c, values: pc.replace_with_mask(c, pa.array(mask), pa.array(values, c.type))  # noqa: E731, B023
                cols[at["text"]] = replace(column, list(changed.values()))
                if "n_chars" in at:
                    cols[at["n_chars"]] = replace(batch.column(at["n_chars"]), [len(t) for t in changed.values()])
            yield pa.RecordBatch.from_arrays(cols, list(at))

    return scratch.positional(joined).mapInArrow(arrays.tidy(work), docs.schema)
