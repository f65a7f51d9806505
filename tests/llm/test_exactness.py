"""Results that must not rest on hashes, row identity, or on the sizes at which a method changes."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import arrays, bpe, packing, queries, substring, token_counts

PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def twins():
    """Two words that have one hash under every polynomial of an odd base modulo 2 ** 64."""
    a = [0]
    for _ in range(10):
        a += [1 - x for x in a]
    pair = "".join("ab"[x] for x in a), "".join("ba"[x] for x in a)
    h = arrays.word_hashes([x.encode() for x in pair])[0]
    assert h[0] == h[1] and pair[0] != pair[1]
    return pair


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def twin_docs(spark, twins):
    a, b = twins
    texts = {1: a, 2: b, 3: f"{b} {a}", 4: f"x {a} y {b}", 5: "x"}
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), texts


def test_colliding_words_are_encoded_by_themselves(twin_docs, tokenizer):
    docs, texts = twin_docs
    for _ in range(2):  # the second time from the cache
        for r in bpe.digests(docs, PATH).collect():
            ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_colliding_words_are_packed_by_themselves(twin_docs, tokenizer):
    docs, texts = twin_docs
    for r in packing.pack_documents(docs, PATH).collect():
        ids = [*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_colliding_words_make_no_repeat(spark, twins):
    a, b = twins
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_rows_of_one_doc_id_that_differ(spark):
    words = [f"w{i}" for i in range(60)]
    one, two, three = " ".join(words), " ".join(["x"] * 3 + words[5:50]), " ".join(words[20:45] + ["tail"] * 30)
    rows = [(7, one), (7, two), (7, two), (8, three), (None, three), (None, one[: len(one) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    first, want = {}, {}
    for n, (_, t) in enumerate(order):
        w = t.split()
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (n, p))
    for n, (i, t) in enumerate(order):
        w = t.split()
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (n, p):
                gone |= set(range(p, p + 20))
        want[i, t] = len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs).collect())
    assert got == Counter((i, *want[i, t]) for i, t in rows)
    assert substring.strip_repeats(docs).count() == len(rows)


def test_stripping_with_clashing_names(spark):
    t = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, t, 0, "a"), (2, t, 1, "b")], "doc_id long, text string, of int, packed string").withColumn("key", F.lit(5)).withColumn("a.b", F.lit(6))
    got = {r["doc_id"]: r for r in substring.strip_repeats(docs).collect()}
    assert got[1]["text"] == t and got[2]["text"] == "" and got[2]["packed"] == "b" and got[2]["a.b"] == 6 and list(got[1].asDict()) == docs.columns


@pytest.mark.parametrize("size", [bpe.HEAP_FROM - 1, bpe.HEAP_FROM, bpe.HEAP_FROM + 1])
def test_bpe_on_both_sides_of_the_heap(tokenizer, size):
    rnd = random.Random(size)
    words = ["".join(rnd.choice("abcdelrst") for _ in range(size)), "ab" * (size // 2) + "a" * (size % 2), "a" * size]
    ids, counts = bpe.vocabulary(PATH).encode_words(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


@functools.lru_cache(1)
def piece_scores():
    """From the vocabulary file alone: the printable stand-ins of bytes, and a score for each piece."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte, n = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            byte[chr(256 + n)] = b
            n += 1
    vocab = spec["model"]["vocab"]
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    special = {t["content"] for t in spec["added_tokens"]}
    pieces = {bytes(byte[c] for c in p): i for p, i in vocab.items() if p not in special}
    return {p: -round(1e6 * math.log((i if len(p) > 1 else size) + 1)) for p, i in pieces.items()}


def best_cut(word: bytes) -> int:
    scores = piece_scores()
    known = {len(word): (0, 0)}
    for at in range(len(word) - 1, -1, -1):  # from the end, unlike the operator
        ways = [(scores[word[at:to]] + known[to][0], known[to][1] - 1) for to in range(at + 1, len(word) + 1) if word[at:to] in scores]
        known[at] = max(ways)
    return -known[0][1]


def test_token_counts_by_the_vocabulary_file(spark, twin_docs):
    import regex
    from public_tokenizers import PATTERN

    rnd = random.Random(5)
    some = "abehilorst 'é1漢.\n"
    texts = {i: "".join(rnd.choice(some) for _ in range(rnd.randint(0, 80))) for i in range(150)}
    texts |= {200 + n: "".join(rnd.choice("abeinrst") for _ in range(n)) for n in (token_counts.LONG - 1, token_counts.LONG, token_counts.LONG + 1, 400)} | {900: None, 901: ""}
    texts |= {1000 + i: t for i, t in twin_docs[1].items()}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] * 2, "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(docs, PATH).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        words = regex.findall(PATTERN, texts[r["doc_id"]] or "")
        assert (r["n_pretokens"], r["n_tokens"], r["n_bytes"]) == (len(words), sum(best_cut(w.encode()) for w in words), len((texts[r["doc_id"]] or "").encode()))


def test_trie_that_begins_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 50)
    u, rnd = token_counts.Unigram(PATH), random.Random(3)
    for _ in range(5):
        words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 20))) for _ in range(40)]
        assert u.count_words(words)[0].tolist() == [best_cut(w.encode()) for w in words]
