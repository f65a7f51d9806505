"""Periodic runs against a plain version: islands of every lag, those inside a run of a smaller period left out."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orderloom.llm import periodic


def plain_runs(w, least=24, times=3):
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, times * q):
                found.append((s, i - s + q, q))
            i += 1
    return sorted((r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)), key=lambda r: (r[0], r[2]))


def codes_of(words):
    return np.unique(np.array(words), return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)


def planted_words(rnd):
    k = rnd.choice([1, 2, 3, 5, 20])
    w = [rnd.randrange(k) for _ in range(rnd.randint(0, 90))]
    for _ in range(rnd.randint(0, 3)):
        at, unit = rnd.randrange(len(w) + 1), [rnd.randrange(k) for _ in range(rnd.randint(1, 12))]
        w[at:at] = (unit * 12)[: rnd.randint(1, 80)]
    return w


def test_runs_whatever_words_count_as_heavy():
    rnd, n = random.Random(1), 0
    for _ in range(300):
        w, least = planted_words(rnd), rnd.choice([24, 24, 6])
        want = plain_runs(w, least)
        for heavy in (1, 4, 1000):
            codes = codes_of(w)
            assert periodic.runs_of(codes, periodic.counts_of([codes], heavy)[0], least=least) == want
        n += len(want)
    assert n > 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=5), st.integers(1, 6))
def test_counts_of_many_texts_at_once(texts, heavy):
    for w, got in zip(texts, periodic.counts_of([codes_of(w) for w in texts], heavy), strict=True):
        assert got.tolist() == [0] + [sum(a == b for a, b in zip(w, w[q:], strict=False)) for q in range(1, len(w) // 3 + 1)]


def test_long_texts_of_one_word_and_of_many():
    one = np.zeros(300_000, np.int64)
    assert periodic.runs_of(one, periodic.counts_of([one])[0]) == [(0, 300_000, 1)]
    seven = np.arange(100_000) % 7
    assert periodic.runs_of(seven, periodic.counts_of([seven])[0]) == [(0, 100_000, 7)]
    assert periodic.runs_of(np.arange(50_000), periodic.counts_of([np.arange(50_000)])[0]) == []


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    s, n, q = best or (None, None, None)
    told = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), s, n, q, None if q is None else 1000 * n // q, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_digests_of_documents(spark):
    rnd = random.Random(3)
    words = ["a", "bé", "c d", "e\x1ff", "the", "of", "x" * 300]
    make = lambda: rnd.choice([" ", "  ", "\n", "\t\x0b"]).join(words[i % 7] for i in planted_words(rnd))
    rows = [(i, make()) for i in range(150)] + [(7, None), (None, "z " * 60), (None, None), (10, ""), (10, " \n"), (11, "z " * 24), (12, "z " * 23), (-5, "q" * 9000), (13, "k l " * 3000), (13, "k l " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], "doc_id long, text string, start int, runs string, period int").repartition(4)
    got = periodic.digests(docs)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert periodic.digests(docs.limit(0)).count() == 0


def test_runs_and_texts_without_repeats(spark):
    docs = spark.createDataFrame([(1, "go " * 30 + "on"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(docs).collect()}
    assert got == {1: ([(0, 30, 1)], "go on"), 2: ([], "a b c"), 3: ([], "")}
