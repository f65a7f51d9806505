"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tokens are runs of letters, in lower case. Token labels come from labelled documents: a feature
(a word, or its first characters) marks tokens of toxic documents when documents with it are toxic
far more often than others, counted over all training rows and, so that copies of a text are no
evidence, over distinct pairs of neighbouring words. Marked tokens of toxic training texts carry
the tag toxic, all other tokens the tag other.

The field has two tags. Its moves (four weights), its bias and the weights of a marked token's
observations (log-odds of its word and of its best prefix, capitals, an exclamation mark behind,
other marked tokens nearby) are fitted together on the likelihood of whole tag sequences:
gradients are observed minus expected uses, the latter by forward and backward passes. A token
without any marked feature has one and the same potential, so a stretch of such tokens is a power
of a 2 x 2 matrix, whose derivative is found by doubling: likelihood and marginals are exact, and
the work per text follows its marked tokens. A logistic layer maps the marginals of a document to
a probability.

Labels, language, source and doc_id are never inputs of a score. What executors get is all
marked features, however many; while contexts are counted, ``at_once`` of them in each pass. The
fit itself reads a sample of at most ``most_docs`` training rows and ``most_marks`` marked
tokens (documented bounds); counts cover all training rows.

Defined cases: null and word-less texts get the score of a text without toxic tokens; rows
with a null label or doc_id do not train; conflicting repeated labels all count; with no
labelled rows or one class only, the score is the smoothed share of label 1 (a quarter without any
label); no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm import arrays, scratch

PREFIXES = (4, 5, 6)
FOLDS = 5
NEARBY = 3  # tokens to either side in which another marked token counts as near
OBSERVED = 6  # numbers of a marked token's observation


@dataclass
class Model:
    """Marked features with their log-odds, the field's weights and the logistic layer."""

    odds: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # scores of a move, from (other, toxic) to (other, toxic)
    bias: float = 0.0  # of the toxic tag, at every token
    weights: np.ndarray = field(default_factory=lambda: np.zeros(OBSERVED))  # of a marked token's observations, for the toxic tag
    layer: tuple[float, float, float] = (0.0, 0.0, 0.0)  # constant, highest marginal, log of the expected number of toxic tokens
    prior: float = 0.5


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


# -- marked tokens of texts -----------------------------------------------------------------


@dataclass
class Marks:
    """The marked tokens of some texts, text by text."""

    size: np.ndarray  # tokens of each text
    count: np.ndarray  # marked tokens of each text
    at: np.ndarray  # position of each marked token among its text's tokens
    seen: np.ndarray  # its observation, one row each
    start: np.ndarray  # its first character in its text
    end: np.ndarray


class Marker:
    """Finds marked tokens. Distinct words are looked up once; see ``arrays.SpanCache``."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.known = [(0.0, 0.0)]
        self.number = {self.known[0]: 0}
        self.cache = arrays.SpanCache(self._look_up)

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for w in words:
            own, *prefixes = (self.odds.get(f, 0.0) for f in features(w))
            pair = own, max(prefixes, default=0.0)
            if pair not in self.number:
                self.number[pair] = len(self.known)
                self.known.append(pair)
            out.append(self.number[pair])
        return np.array(out, np.int32), np.ones(len(words), np.int64)

    def marks(self, texts: list[str]) -> Marks:
        r = arrays.letter_runs(texts)
        at, _, ids = self.cache.spans(r.start, r.end, r.key, r.low)
        kind = ids[at]
        hit = np.flatnonzero(kind)
        size = np.bincount(r.text, minlength=len(texts)).astype(np.int64)
        text, start, end = r.text[hit], r.start[hit], r.end[hit]
        place = hit - (np.cumsum(size) - size)[text]
        near = np.zeros(len(hit), bool)
        if len(hit) > 1:
            close = (np.diff(place) <= NEARBY) & (np.diff(text) == 0)
            near[1:] |= close
            near[:-1] |= close
        upper = np.concatenate(([0], np.cumsum(r.cp != r.low)))
        capitals = (upper[end] - upper[start] == end - start) & (end - start > 1)
        loud = r.cp[np.minimum(end, len(r.cp) - 1)] == 0x21 if len(r.cp) else np.zeros(0, bool)
        known = np.array(self.known)[kind[hit]].reshape(-1, 2)
        seen = np.column_stack((np.ones(len(hit)), known, capitals, loud, near)).astype(float)
        return Marks(size, np.bincount(text, minlength=len(texts)).astype(np.int64), place, seen, start - r.first[text], end - r.first[text])


# -- the field -----------------------------------------------------------------------------


class Chains:
    """Texts as chains of marked tokens with stretches of unmarked ones between them."""

    def __init__(self, size: np.ndarray, count: np.ndarray, at: np.ndarray):
        some = np.flatnonzero(size > 0)  # a text without tokens has one, empty, sequence
        self.size, self.count, self.at = size[some], count[some], at
        self.n = len(some)
        self.last = np.cumsum(self.count)
        self.first = self.last - self.count
        marked = self.count > 0
        owner = np.repeat(np.arange(self.n), self.count)
        head = np.zeros(len(at), bool)
        head[self.first[marked]] = True
        before = np.empty(len(at), np.int64)  # steps into unmarked tokens between a marked token and what stands before it
        before[head] = at[head] - 1  # the text's first token is not stepped into; -1: it is this one
        before[~head] = (at[1:] - at[:-1] - 1)[~head[1:]]
        tail = self.size - 1
        tail[marked] = (self.size[marked] - 1) - at[self.last[marked] - 1]
        self.head, self.owner = head, owner
        self.gaps, where = np.unique(np.concatenate((before, tail)), return_inverse=True)
        self.before, self.tail = where[: len(at)], where[len(at) :]

    def stretches(self, step: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Powers of ``step`` for every gap, scaled; the logarithms of the scales; derivatives for each of ``parts``, scaled alike."""
        n = np.maximum(self.gaps, 0)
        power, log, slope = np.tile(np.eye(2), (len(n), 1, 1)), np.zeros(len(n)), np.zeros((len(n), len(parts), 2, 2))
        base, base_log, base_slope = step.copy(), 0.0, parts.copy()
        while n.any():
            odd = n & 1 == 1
            slope[odd] = slope[odd] @ base + power[odd][:, None] @ base_slope
            power[odd] = power[odd] @ base
            top = power[odd].max(axis=(1, 2))
            power[odd] /= top[:, None, None]
            slope[odd] /= top[:, None, None, None]
            log[odd] += base_log + np.log(top)
            base_slope = base_slope @ base + base @ base_slope
            base = base @ base
            top = base.max()
            base, base_slope, base_log = base / top, base_slope / top, 2 * base_log + math.log(top)
            n = n >> 1
        return power, log, slope

    def run(self, moves: np.ndarray, bias: float, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log of each text's sum over tag sequences, marginals of the toxic tag at marked tokens, expected uses).

        score: what each marked token adds to the bias. Expected uses: of the four moves, and of
        the toxic tag at any token, summed over all texts.
        """
        step, plain = np.exp(moves), np.array([1.0, math.exp(bias)])
        into = step * plain
        parts = np.zeros((5, 2, 2))
        for i in range(4):
            parts[i, i // 2, i % 2] = into[i // 2, i % 2]
        parts[4, :, 1] = into[:, 1]
        power, log, slope = self.stretches(into, parts)
        potential = np.exp(np.stack((np.zeros(len(score)), np.clip(bias + score, -300, 300)), axis=1))
        k = len(score)
        alpha, beta, total = np.empty((k, 2)), np.empty((k, 2)), np.zeros(self.n)
        starts = self.gaps[self.before] < 0  # marked tokens that are their text's first
        most = int(self.count.max(initial=0))
        rank = np.argsort(-self.count, kind="stable")
        having = np.searchsorted(-self.count[rank], -np.arange(1, most + 1), side="right")  # texts with that many marked tokens
        for j in range(most):
            texts = rank[: having[j]]
            e = self.first[texts] + j
            before = np.tile(plain, (len(e), 1)) if j == 0 else alpha[e - 1]
            g = self.before[e]
            v = np.einsum("ni,nij->nj", before, power[g]) @ step
            if j == 0:
                v[starts[e]] = 1.0
            v = v * potential[e]
            scale = v.sum(axis=1)
            alpha[e] = v / scale[:, None]
            total[texts] += np.log(scale) + log[g]
        marked = self.count > 0
        end = self.last[marked] - 1
        last = np.tile(plain, (self.n, 1))
        last[marked] = alpha[end]
        close = np.einsum("nij->ni", power[self.tail])  # a stretch, then any tag
        whole = (last * close).sum(axis=1)
        total += np.log(whole) + log[self.tail]
        uses = np.einsum("ni,npij,n->p", last, slope[self.tail], 1 / whole)
        uses[4] += (plain[1] * close[~marked, 1] / whole[~marked]).sum()  # the first token of a text without marked ones
        for j in range(most - 1, -1, -1):
            texts = rank[: having[j]]
            e = self.first[texts] + j
            ends = j == self.count[texts] - 1
            b = np.empty((len(e), 2))
            b[ends] = close[texts[ends]]
            after = e[~ends] + 1
            right = (potential[after] * beta[after]) @ step.T
            b[~ends] = np.einsum("nij,nj->ni", power[self.before[after]], right)
            beta[e] = b / b.sum(axis=1, keepdims=True)
        both = alpha * beta
        marginal = both[:, 1] / both.sum(axis=1)
        # moves: in the stretch before each marked token, and into the token itself
        left = np.tile(plain, (k, 1))
        left[~self.head] = alpha[np.flatnonzero(~self.head) - 1]
        go = ~starts
        left, right, g = left[go], potential[go] * beta[go], self.before[go]
        inner = np.einsum("ni,nij->nj", left, power[g])
        weight = 1 / np.einsum("ni,ij,nj->n", inner, step, right)
        uses += np.einsum("ni,npij,nj,n->p", left, slope[g], right @ step.T, weight)
        uses[:4] += (np.einsum("ni,nj,n->ij", inner, right, weight) * step).ravel()
        uses[4] += marginal.sum()
        first = go & self.head  # an unmarked first token
        pick = first[go]
        uses[4] += (plain[1] * np.einsum("nj,nj->n", power[g[pick]][:, 1, :], right[pick] @ step.T) * weight[pick]).sum()
        return total, marginal, uses


def observed(chains: Chains, tag: np.ndarray) -> np.ndarray:
    """Uses of the four moves and of the toxic tag, where marked tokens have these tags and others the tag other."""
    next_ = np.zeros(len(tag), bool)
    next_[1:] = ~chains.head[1:] & (chains.gaps[chains.before[1:]] == 0)
    pair = next_[1:]
    toxic = tag.sum()
    stays = (tag[1:] * tag[:-1] * pair).sum()
    first = (tag * (chains.gaps[chains.before] < 0)).sum()
    end = chains.last[chains.count > 0] - 1
    final = (tag[end] * (chains.gaps[chains.tail[chains.count > 0]] == 0)).sum()
    steps = (chains.size - 1).sum()
    into, out = toxic - first - stays, toxic - final - stays
    return np.array([steps - into - out - stays, into, out, stays, toxic], float)


def likelihood(chains: Chains, seen: np.ndarray, tag: np.ndarray, theta: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Log-likelihood of the tags less a ridge, and its gradient. theta: moves, bias, weights."""
    moves, bias, weights = theta[:4].reshape(2, 2), float(theta[4]), theta[5:]
    total, marginal, uses = chains.run(moves, bias, seen @ weights)
    have = observed(chains, tag)
    value = have[:4] @ theta[:4] + have[4] * bias + (seen @ weights) @ tag - total.sum()
    slope = np.concatenate((have - uses, seen.T @ (tag - marginal)))
    return float(value - ridge / 2 * theta @ theta), slope - ridge * theta


def ascend(value: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, rounds: int) -> np.ndarray:
    """Maximum of a concave function by quasi-Newton steps (BFGS) with backtracking."""
    f, g = value(theta)
    hold = np.eye(len(theta)) / max(1.0, float(np.linalg.norm(g)))
    for _ in range(rounds):
        way = hold @ g
        rise = float(way @ g)
        if rise < 1e-9 * max(1.0, abs(f)):
            break
        size = min(1.0, 5.0 / float(np.abs(way).max()))
        while True:
            then, slope = value(theta + size * way)
            if then >= f + 1e-4 * size * rise or size < 1e-10:
                break
            size /= 2
        if then <= f:
            break
        s, y = size * way, g - slope
        theta, f, g = theta + s, then, slope
        if (sy := float(s @ y)) > 1e-12:
            side = np.eye(len(theta)) - np.outer(s, y) / sy
            hold = side @ hold @ side.T + np.outer(s, s) / sy
    return theta


# -- scores of texts -----------------------------------------------------------------------


def marginals(model: Model, marks: Marks) -> np.ndarray:
    """Marginals of the toxic tag at the marked tokens."""
    return Chains(marks.size, marks.count, marks.at).run(model.moves, model.bias, marks.seen @ model.weights)[1]


def summaries(marks: Marks, p: np.ndarray) -> np.ndarray:
    """(highest marginal, log of one more than the expected number of toxic tokens) of each text."""
    out = np.zeros((len(marks.count), 2))
    have = np.flatnonzero(marks.count)
    if len(have):
        begin = np.cumsum(marks.count)[have] - marks.count[have]
        out[have, 0] = np.maximum.reduceat(p, begin)
        out[have, 1] = np.log1p(np.add.reduceat(p, begin))
    return out


def score_texts(model: Model, marker: Marker, texts: list[str]) -> tuple[np.ndarray, Marks, np.ndarray]:
    """(score of each text, marked tokens, their marginals)."""
    if not model.odds:
        none = Marker({}).marks([""] * len(texts))
        return np.full(len(texts), model.prior), none, np.zeros(0)
    marks = marker.marks(texts)
    p = marginals(model, marks)
    z = model.layer[0] + summaries(marks, p) @ np.array(model.layer[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), marks, p


# -- training ------------------------------------------------------------------------------


def train_rows(docs: DataFrame, labels: DataFrame, most_sent: int = 1_000_000) -> DataFrame:
    """(doc_id, text, y, fold): labelled documents; fold is crc32 of the doc_id's text modulo 5.

    Up to most_sent labels (two numbers each) go to all executors, so that texts stay where they
    are; more are joined by a shuffle. The rows are the same.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if own.count() <= most_sent:
        own = F.broadcast(own)
    return docs.select("doc_id", "text").join(own, "doc_id").withColumn("fold", fold(F.col("doc_id")))


def fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


class _Numbers:
    """A number for each distinct feature, in the order they come."""

    def __init__(self, wanted: frozenset[str] | None = None):
        self.wanted = wanted
        self.of: dict[str, int] = {}
        self.cache = arrays.SpanCache(self._look_up)

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, n = [], []
        for w in words:
            own = [f for f in features(w) if self.wanted is None or f in self.wanted]
            flat += [self.of.setdefault(f, len(self.of)) for f in own]
            n.append(len(own))
        return np.array(flat, np.int32), np.array(n, np.int64)


def _feature_counts(rows: DataFrame, least_docs: int, most_held: int = 1 << 18) -> DataFrame:
    """(feature, toxic, clean): in how many training texts of each label a feature occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = _Numbers(), np.zeros((2, 0), np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, hi, raw in arrays.text_chunks(batch.column(0)):
                r = arrays.letter_runs([x.decode() for x in raw])
                at, n, ids = numbers.cache.spans(r.start, r.end, r.key, r.low)
                pairs = np.unique(np.repeat(r.text, n) << 32 | ids[arrays.ragged(at, n)])
                label = y[lo:hi][pairs >> 32]
                counts = np.pad(counts, ((0, 0), (0, len(numbers.of) - counts.shape[1])))
                for k in (0, 1):
                    counts[k] += np.bincount(pairs[label == k] & 0xFFFFFFFF, minlength=counts.shape[1])
                if len(numbers.of) > most_held:
                    yield from told(numbers, counts)
                    numbers, counts = _Numbers(), np.zeros((2, 0), np.int64)
        yield from told(numbers, counts)

    def told(numbers: _Numbers, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = list(numbers.of)
        for lo in range(0, len(names), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[part], pa.string()), pa.array(counts[1, part]), pa.array(counts[0, part])], ["feature", "toxic", "clean"])

    made = rows.select("text", "y").mapInArrow(arrays.tidy(work), "feature string, toxic long, clean long")
    return made.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= least_docs)


def _context_counts(rows: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(feature, toxic, clean): in how many distinct pairs of neighbouring words of each label it occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(wanted)
        for batch in batches:
            found: set[tuple[int, bytes, int]] = set()
            y = batch.column(1).to_pylist()
            for lo, _, raw in arrays.text_chunks(batch.column(0)):
                r = arrays.letter_runs([x.decode() for x in raw])
                at, n, ids = numbers.cache.spans(r.start, r.end, r.key, r.low)
                hit = np.flatnonzero(n)
                sides = []
                for side in (-1, 1):  # the word before and the one behind, empty at a text's ends
                    near = np.clip(hit + side, 0, max(0, len(r.text) - 1))
                    there = (near != hit) & (r.text[near] == r.text[hit])
                    sides.append(arrays.strings(r.low, r.start[near], np.where(there, r.end[near], r.start[near])))
                for a, m, before, behind, text in zip(at[hit].tolist(), n[hit].tolist(), *sides, r.text[hit].tolist(), strict=True):
                    near = hashlib.blake2b(f"{before} {behind}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    found.update((f, near, y[lo + text]) for f in ids[a : a + m].tolist())
            names, cols = list(numbers.of), list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array([names[f] for f in cols[0]], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32())], ["feature", "near", "y"])

    made = rows.select("text", "y").mapInArrow(arrays.tidy(work), "feature string, near binary, y int").distinct()
    return made.groupBy("feature").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))


def fit(
    docs: DataFrame, labels: DataFrame, *, most_docs: int = 20_000, most_marks: int = 400_000, at_once: int = 50_000, least_docs: int = 3, least_odds: float = 1.5, rounds: int = 60
) -> Model:
    """Train on labelled documents outside fold 0."""
    spark = docs.sparkSession
    scratch.ship(spark)
    rows = scratch.stash(train_rows(docs, labels).filter("fold <> 0").select("doc_id", "text", "y"), "labelled")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    prior = (bad + 0.5) / (bad + good + 2)  # without any label a text counts as clean
    if not bad or not good:
        return Model(prior=prior)
    counts = scratch.stash(_feature_counts(rows, least_docs), "features")
    n_tested = max(1, counts.count())
    t, c = F.col("toxic"), F.col("clean")
    odds = F.log((t + 0.25) / (bad + 0.5)) - F.log((c + 0.25) / (good + 0.5))
    # likelihood ratio against the base rate, beyond what the best of so many features reaches by chance
    share_bad = bad / (bad + good)
    ratio = 2 * (t * F.log(t / ((t + c) * share_bad)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share_bad)))).otherwise(0.0))
    sure = (t / (t + c) > max(0.6, min(0.95, 3 * share_bad))) & (ratio > 2 * math.log(n_tested) + 4)
    marked = counts.withColumn("odds", odds).filter(sure & (F.col("odds") > least_odds))
    marked = scratch.stash(marked.select("feature"), "marked")
    passes = max(1, -(-marked.count() // at_once))
    # copies of one text are no further evidence: what counts in the end are distinct pairs of neighbours
    ranked = []
    for i in range(passes):  # every marked feature is told apart from copies; one pass over the rows for each part of them
        part = marked.filter(F.pmod(F.xxhash64("feature"), F.lit(passes)) == i).collect()
        told = _context_counts(rows, frozenset(r["feature"] for r in part))
        ranked += told.withColumn("odds", odds).filter(sure & (F.col("odds") > least_odds) & (t >= least_docs)).collect()
    model = Model({r["feature"]: float(r["odds"]) for r in ranked}, prior=prior)
    return _fit_field(model, *_sample(rows, model, bad + good, most_docs, most_marks), rounds) if model.odds else model


def _sample(rows: DataFrame, model: Model, n_rows: int, most_docs: int, most_marks: int) -> tuple[Marks, np.ndarray]:
    """(marked tokens, label of each text) of a sample of the training rows, chosen by doc_id and text; never more than most_docs rows and most_marks tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(model.odds)
        for batch in batches:
            for lo, hi, raw in arrays.text_chunks(batch.column(0)):
                m = marker.marks([x.decode() for x in raw])
                ends = pa.array(np.append(0, np.cumsum(m.count)), pa.int32())
                wide = pa.array(np.append(0, np.cumsum(m.count) * OBSERVED), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(m.at)), pa.ListArray.from_arrays(wide, pa.array(m.seen.ravel()))]
                yield pa.RecordBatch.from_arrays([pa.array(m.size), *lists, batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)], ["size", "at", "seen", "y", "draw"])

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31))
    some = rows.withColumn("draw", draw).filter(F.col("draw") < int(min(1.0, most_docs / n_rows) * (1 << 31)))
    drawn = scratch.stash(some.select("text", "y", "draw").mapInArrow(arrays.tidy(work), "size long, at array<long>, seen array<double>, y int, draw long"), "drawn")
    # repeated rows share their draw, so the bounds are held here: rows by draw, then as many as have at most most_marks tokens
    kept = drawn.orderBy("draw", "y", "size").limit(most_docs)
    so_far = F.sum(F.size("at")).over(Window.orderBy("draw", "y", "size").rowsBetween(Window.unboundedPreceding, 0))  # of most_docs rows at most
    got = kept.withColumn("so_far", so_far).filter(F.col("so_far") <= most_marks).select("size", "at", "seen", "y").toArrow()
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy()
    count = got["at"].combine_chunks().value_lengths().to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    at, none = flat("at"), np.zeros(0, np.int64)
    return Marks(got["size"].to_numpy(), count, at, flat("seen").reshape(-1, OBSERVED), none, none), got["y"].to_numpy()


def _fit_field(model: Model, marks: Marks, y: np.ndarray, rounds: int, ridge: float = 1.0) -> Model:
    """Weights of the field from the tags of the marked tokens, then the layer from the documents' labels."""
    chains = Chains(marks.size, marks.count, marks.at)
    tag = np.repeat(y, marks.count).astype(float)
    start = np.concatenate((np.zeros(4), [-2.0], np.zeros(OBSERVED)))
    theta = ascend(lambda v: likelihood(chains, marks.seen, tag, v, ridge), start, rounds)
    model.moves, model.bias, model.weights = theta[:4].reshape(2, 2), float(theta[4]), theta[5:]
    z = np.column_stack((np.ones(len(y)), summaries(marks, marginals(model, marks))))
    w = np.array([np.log(model.prior / (1 - model.prior)), 0.0, 0.0])
    hold = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):  # Newton steps of a slightly ridged logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (y - p) - hold @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.layer = (float(w[0]), float(w[1]), float(w[2]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, offsets): offsets are [start, end) characters of toxic tokens in the text as it is."""
    spark = docs.sparkSession
    scratch.ship(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker, kind = Marker(model.odds), pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for lo, hi, raw in arrays.text_chunks(batch.column(1)):
                values, marks, p = score_texts(model, marker, [x.decode() for x in raw])
                toxic = p >= 0.5
                owner = np.repeat(np.arange(hi - lo), marks.count)[toxic]
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=hi - lo)))
                spans = pa.StructArray.from_arrays([pa.array(x[toxic], pa.int32()) for x in (marks.start, marks.end)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(values), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], ["doc_id", "score", "offsets"]
                )

    return docs.select("doc_id", "text").mapInArrow(arrays.tidy(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, offsets array<struct<start:int,end:int>>")


def keep(docs: DataFrame, model: Model, *, below: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below a threshold; scored in place, without a join."""
    scratch.ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(model.odds)
        for batch in batches:
            stay = [score_texts(model, marker, [x.decode() for x in raw])[0] < below for _, _, raw in arrays.text_chunks(batch.column(at))]
            kept = batch.filter(pa.array(np.concatenate([*stay, np.zeros(0, bool)])))
            yield pa.RecordBatch.from_arrays(kept.columns, names)

    return scratch.positional(docs).mapInArrow(arrays.tidy(work), docs.schema)
