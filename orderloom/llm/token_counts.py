"""Token counts under a unigram model, with forward scores shared along a trie.

A worker keeps one trie of the distinct pre-tokens it has met, level by level; new pre-tokens
are inserted as they come. The forward score of a node (the best sum of piece scores over all
ways to cut its prefix into pieces) and the number of pieces of that way are computed once, when
the node is made, whatever the number of pre-tokens that pass through it; a terminal node's
number of pieces is its pre-tokens' count, and a text's count is the sum over its pre-tokens.
The pieces that end at a node are found by walking up from it in step with a second trie, that of
the vocabulary's reversed pieces, so nothing rests on hashes.

The pieces are a public vocabulary's; a piece of rank r scores -log(r + 1) in millionths, a
single byte as if it were last, so that whole numbers are compared; of equal scores the fewer
pieces win. A pre-token of over ``LONG`` bytes runs through the same recurrence outside the trie,
whose levels it would make many; the counts are the same.

Defined cases: null and empty texts have no tokens; repeated rows count alike; no rows give no
rows; other columns do not matter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderloom.llm import arrays, bpe, scratch

LONG = 96
#: Nodes that a worker's trie holds before it begins anew.
MOST_NODES = 1 << 23
FAR = -(1 << 60)


class Unigram:
    """Piece scores, and a trie of the reversed pieces: sorted keys state << 8 | byte to next states."""

    def __init__(self, path: str):
        v = bpe.vocabulary(path)
        data = v.bytes.tobytes()
        pieces = [data[a : a + n] for a, n in zip(v.starts.tolist(), v.lengths.tolist(), strict=True)]
        self.score: dict[bytes, int] = {}
        for i, p in enumerate(pieces):
            if p and i != v.special_id:
                cost = -round(1e6 * float(np.log((i if len(p) > 1 else len(pieces)) + 1)))
                self.score[p] = max(cost, self.score.get(p, FAR))
        self.longest = max(map(len, self.score))
        states: dict[bytes, int] = {b"": 0}
        for p in self.score:
            for k in range(1, len(p) + 1):
                states.setdefault(p[: -k - 1 : -1], len(states))
        self.value = np.full(len(states), FAR, np.int64)
        for p, s in self.score.items():
            self.value[states[p[::-1]]] = s
        key = np.array([states[s[:-1]] << 8 | s[-1] for s in states if s], np.int64)
        order = np.argsort(key)
        self.keys, self.next = key[order], np.arange(1, len(states))[order]
        self.clear()

    def clear(self) -> None:
        """An empty trie. Of each level: sorted keys parent << 8 | byte with their nodes, then arrays by node."""
        none = np.zeros(0, np.int64)
        self.found = [(none, none)]
        self.parent, self.byte = [none], [np.zeros(0, np.uint8)]
        self.best, self.count = [np.zeros(1, np.int64)], [np.zeros(1, np.int32)]
        self.nodes = 1

    def count_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of each word, ones)."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        out = np.zeros(len(data), np.int32)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self.count_one(data[i])
        short = np.flatnonzero(size <= LONG)
        if len(short):
            out[short] = self._by_trie([data[i] for i in short.tolist()], size[short])
        return out, np.ones(len(data), np.int64)

    def count_one(self, word: bytes) -> int:
        best, n = [0], [0]
        for d in range(1, len(word) + 1):
            top = (FAR, 0)
            for k in range(1, min(d, self.longest) + 1):
                s = self.score.get(word[d - k : d])
                if s is not None:
                    top = max(top, (best[d - k] + s, -(n[d - k] + 1)))
            best.append(top[0])
            n.append(-top[1])
        return n[-1]

    def _by_trie(self, data: list[bytes], size: np.ndarray) -> np.ndarray:
        if self.nodes > MOST_NODES:
            self.clear()
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(data), np.uint8)
        out = np.zeros(len(data), np.int32)
        words = np.arange(len(data))
        node = np.zeros(len(data), np.int64)
        for d in range(1, int(size.max(initial=0)) + 1):
            alive = size[words] >= d
            words, node = words[alive], node[alive]
            children, of = np.unique(node << 8 | flat[begin[words] + d - 1], return_inverse=True)
            node = self._insert(d, children)[of]
            ends = size[words] == d
            out[words[ends]] = self.count[d][node[ends]]
        return out

    def _insert(self, d: int, children: np.ndarray) -> np.ndarray:
        """Nodes of level d for sorted distinct keys parent << 8 | byte; those that are new get their scores."""
        if d == len(self.found):
            none = np.zeros(0, np.int64)
            self.found.append((none, none))
            self.parent.append(none)
            self.byte.append(np.zeros(0, np.uint8))
            self.best.append(none)
            self.count.append(np.zeros(0, np.int32))
        keys, nodes = self.found[d]
        at = np.searchsorted(keys, children)
        new = np.ones(len(children), bool)
        inside = at < len(keys)
        new[inside] = keys[at[inside]] != children[inside]
        if new.any():
            fresh = children[new]
            first = len(self.parent[d])
            self.parent[d] = np.concatenate((self.parent[d], fresh >> 8))
            self.byte[d] = np.concatenate((self.byte[d], (fresh & 255).astype(np.uint8)))
            best, count = self._forward(d, np.arange(first, first + len(fresh)))
            self.best[d], self.count[d] = np.concatenate((self.best[d], best)), np.concatenate((self.count[d], count))
            keys, nodes = np.insert(keys, at[new], fresh), np.insert(nodes, at[new], np.arange(first, first + len(fresh)))
            self.found[d] = keys, nodes
            self.nodes += len(fresh)
            at = np.searchsorted(keys, children)
        return nodes[at]

    def _forward(self, d: int, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best scores of new nodes of level d, and their numbers of pieces."""
        top, n = np.full(len(made), FAR, np.int64), np.zeros(len(made), np.int32)
        who, above, state = np.arange(len(made)), made, np.zeros(len(made), np.int64)
        for k in range(1, min(d, self.longest) + 1):
            level = d - k + 1
            key = state << 8 | self.byte[level][above]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key  # where no piece ends with these bytes, longer ones need no look
            if not on.any():
                break
            who, above, state = who[on], self.parent[level][above[on]], self.next[at[on]]
            value = self.value[state]
            hit = np.flatnonzero(value > FAR)
            if not len(hit):
                continue
            w = who[hit]
            s, m = self.best[level - 1][above[hit]] + value[hit], self.count[level - 1][above[hit]] + 1
            better = (s > top[w]) | ((s == top[w]) & (m < n[w]))
            top[w[better]], n[w[better]] = s[better], m[better]
        return top, n


@functools.lru_cache(2)
def _cache(path: str) -> arrays.PieceCache:
    return arrays.PieceCache(Unigram(path).count_words)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_pretokens, n_tokens) of every whole text."""
    scratch.ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        for batch in batches:
            for lo, hi, raw in arrays.text_chunks(batch.column(1)):
                n, words = cache.look_up([x.decode() for x in raw])
                owner = np.repeat(np.arange(hi - lo), words)
                total = np.bincount(owner, weights=n, minlength=hi - lo).astype(np.int64)
                size = np.fromiter(map(len, raw), np.int64, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, (size, words, total))], ["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(arrays.tidy(work), f"doc_id {kind}, n_bytes long, n_pretokens long, n_tokens long")
