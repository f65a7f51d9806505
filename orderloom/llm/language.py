"""Language of whole texts: averaged hashed subword embeddings under a linear softmax.

A text is its runs of letters, in lower case; each stands for itself and for the runs of two to
four characters in it, begin and end marked. All are hashed to ``buckets`` rows of an embedding
table, a text is the mean of its rows, and a linear layer maps the mean to languages. Table and
layer are trained by stochastic gradient descent in numpy on the driver (a step sees some texts and
some of each one's features), on a sample whose bounds are parameters: at most ``most_texts``
training texts, and about ``most_features`` distinct buckets of them (a text has at most ``buckets``). The sample takes as many distinct texts of each language (rare ones whole), drawn by a hash
of language and text; everything that is predicted is predicted on all rows and whole texts.

A fifth of the sample stays out of the descent and calibrates: one temperature for the softmax,
by the likelihood of that fifth, and the score below which a prediction is rejected, such that at
most ``refuse`` of the fifth is refused though right.

The trained rows are folded into the layer (or kept, if there are more languages than dimensions),
so that a word adds one short vector; workers hold those of distinct words. Languages, sources and
doc_ids are never inputs of a prediction.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and are not
rejected; without any labelled training row all are; with one language all other texts get it,
with score 1; rows with a null lang or doc_id do not train; repeated rows count alike; no rows
give no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm import arrays, scratch

FOLDS = 4
HELD_OUT = 2
UNKNOWN = "und"
GRAMS = (2, 3, 4)
_BEGIN, _END = 0x3C, 0x3E  # marks around a word


@dataclass
class Model:
    """Languages, embedding table, layer, temperature and the score below which predictions are rejected."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))  # a row for each bucket
    layer: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # (languages, dimensions)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    threshold: float = 0.0

    def folded(self) -> tuple[np.ndarray, np.ndarray | None]:
        """(vector of each bucket, layer that their mean still has to pass)."""
        if len(self.langs) <= self.table.shape[1]:
            return (self.table @ self.layer.T).astype(np.float32), None
        return self.table, self.layer


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


# -- features ------------------------------------------------------------------------------


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features in a row, number of features of each word)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    start = end - size
    r = arrays.Rolling(arrays.mix(cp.astype(arrays.U) + arrays.U(1)))
    key, owner = [r.of(start, end)], [np.arange(len(words))]
    word = np.repeat(np.arange(len(words)), size)
    for n in GRAMS:
        at = np.flatnonzero(word[: len(cp) - n + 1] == word[n - 1 :]) if len(cp) >= n else np.zeros(0, np.int64)
        key.append(r.of(at, at + n) + arrays.U(n))
        owner.append(word[at])
    keys, owners = np.concatenate(key), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return (arrays.mix(keys[order]) % arrays.U(buckets)).astype(np.int64), np.bincount(owners, minlength=len(words)).astype(np.int64)


def text_features(texts: list[str], cache: arrays.SpanCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, times) of the distinct buckets of some texts. cache: of word_features."""
    r = arrays.letter_runs(texts)
    at, n, ids = cache.spans(r.start, r.end, r.key, r.low)
    pairs, times = np.unique(np.repeat(r.text, n) << 32 | ids[arrays.ragged(at, n)], return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, times


def _feature_cache(buckets: int) -> arrays.SpanCache:
    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = word_features(words, buckets)
        return ids.astype(np.int32), n

    return arrays.SpanCache(encode, most=1 << 17)


# -- training ------------------------------------------------------------------------------


def training_rows(docs: DataFrame) -> DataFrame:
    """(text, lang) of labelled documents outside the held-out fold."""
    return docs.filter((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))


def _sample(docs: DataFrame, most_texts: int, most_features: int, buckets: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(languages, language of each text, first of each text's features, bucket and times of each feature, draw of each text)."""
    rows = training_rows(docs)
    n = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not n:
        return [], *(np.zeros(0, np.int64) for _ in range(5))
    langs = [lang for lang, _ in n]
    each = max(1, most_texts // len(n))
    spread = 1 << 31
    rate = F.element_at(F.create_map(*(x for lang, m in n for x in (F.lit(lang), F.lit(int(min(1.0, 1.2 * each / m) * spread))))), F.col("lang"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _feature_cache(buckets)
        for batch in batches:
            for lo, hi, raw in arrays.text_chunks(batch.column(0)):
                text, bucket, times = text_features([x.decode() for x in raw], cache)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(text, minlength=hi - lo))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (bucket, np.minimum(times, 1 << 30))]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), *lists], ["lang", "draw", "bucket", "times"])

    scratch.ship(docs.sparkSession)
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64("lang", "text"), F.lit(spread))).filter(F.col("draw") < rate)
    made = drawn.select("text", "lang", "draw").mapInArrow(arrays.tidy(work), "lang string, draw long, bucket array<int>, times array<int>")
    made = scratch.stash(made.filter(F.size("bucket") > 0).dropDuplicates(["lang", "draw"]), "drawn")  # copies of a text are one
    sizes = made.agg(F.count("*").alias("n"), F.sum(F.size("bucket")).alias("features")).first()
    share = min(1.0, most_texts / max(1, sizes["n"]), most_features / max(1, sizes["features"] or 0))
    # few of many: a share of each language, and of what is left by the draw no more than the bound
    got = made.filter(F.pmod(F.xxhash64("draw"), F.lit(spread)) < int(share * spread) if share < 1 else F.lit(True)).orderBy("draw", "lang").limit(most_texts).toArrow()
    bucket, times = (got[c].combine_chunks() for c in ("bucket", "times"))
    first = np.append(0, np.cumsum(bucket.value_lengths().to_numpy())) if got.num_rows else np.zeros(1, np.int64)
    y = np.array([langs.index(x) for x in got["lang"].to_pylist()], np.int64)
    return langs, y, first, bucket.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(float), got["draw"].to_numpy()


def _means(table: np.ndarray, size: np.ndarray, bucket: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted mean row of each text, weight of each feature). size: number of features of each text."""
    begin = np.cumsum(size) - size
    weight = times / np.repeat(np.add.reduceat(times, begin), size)
    return np.add.reduceat(table[bucket] * weight[:, None], begin, axis=0), weight


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(y: np.ndarray, first: np.ndarray, bucket: np.ndarray, times: np.ndarray, langs: int, buckets: int, *, dimensions: int, steps: int, step: float, at_once: int, seen: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, layer, bias) after so many steps, whose size falls to nothing. A step sees at_once texts, and of each up to seen features in a row from a random one (they are in the order of hashes)."""
    rnd = np.random.default_rng(seed)
    table = rnd.uniform(-1, 1, (buckets, dimensions)) / dimensions
    layer, bias = np.zeros((langs, dimensions)), np.zeros(langs)
    whole = np.diff(first)
    order = np.zeros(0, np.int64)
    for k in range(steps):
        if not len(order):
            order = rnd.permutation(len(y))
        texts, order = order[:at_once], order[at_once:]
        rate = step * (1 - k / steps)
        size = np.minimum(whole[texts], seen)
        place = arrays.ragged(rnd.integers(0, whole[texts]), size)
        at = np.repeat(first[texts], size) + place % np.repeat(whole[texts], size)  # round from the last feature to the first
        mean, weight = _means(table, size, bucket[at], times[at])
        slope = softmax(mean @ layer.T + bias)
        slope[np.arange(len(texts)), y[texts]] -= 1
        back = slope @ layer
        layer -= rate * slope.T @ mean / len(texts) ** 0.5
        bias -= rate * slope.sum(axis=0) / len(texts) ** 0.5
        np.add.at(table, bucket[at], -rate * np.repeat(back, size, axis=0) * weight[:, None])
    return table, layer, bias


def temperature_of(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits, of a grid, under which the languages y are likeliest; one text more is taken to be wrong, so that it is never nothing."""
    grid = np.exp(np.linspace(-3, 3, 61))
    wrong = 1 / (len(y) + 2)
    loss = []
    for t in grid:
        p = softmax(z / t)[np.arange(len(y)), y]
        loss.append(-((1 - wrong) * np.log(np.maximum(p, 1e-300)) + wrong * np.log(np.maximum(1 - p, 1e-12))).sum())
    return float(grid[int(np.argmin(loss))])


def fit(
    docs: DataFrame, *, most_texts: int = 2_000, most_features: int = 4_000_000, buckets: int = 1 << 16, dimensions: int = 16, steps: int = 2_000, step: float = 1.0, at_once: int = 16, seen: int = 256, refuse: float = 0.01, seed: int = 7
) -> Model:
    """Train on documents with a language outside the held-out fold."""
    langs, y, first, bucket, times, draw = _sample(docs, most_texts, most_features, buckets)
    if len(langs) < 2 or not len(y):
        return Model(langs, np.zeros((1, 1), np.float32), np.zeros((len(langs), 1)), np.zeros(len(langs)))
    aside = draw % 5 == 0
    if not aside.any() or aside.all():
        aside = np.zeros(len(y), bool)
    keep = np.flatnonzero(~aside)
    size = np.diff(first)
    at = arrays.ragged(first[keep], size[keep])
    table, layer, bias = descend(
        y[keep], np.append(0, np.cumsum(size[keep])), bucket[at], times[at], len(langs), buckets, dimensions=dimensions, steps=steps, step=step, at_once=at_once, seen=seen, seed=seed
    )
    model = Model(langs, table.astype(np.float32), layer, bias)
    texts = np.flatnonzero(aside)
    if len(texts):
        at = arrays.ragged(first[texts], size[texts])
        z = _means(table, size[texts], bucket[at], times[at])[0] @ layer.T + bias
        model.temperature = temperature_of(z, y[texts])
        p = softmax(z / model.temperature)
        right = p.argmax(axis=1) == y[texts]
        model.threshold = float(np.sort(p.max(axis=1)[right])[int(refuse * right.sum())]) if right.any() else 1.0
    return model


# -- predictions ---------------------------------------------------------------------------


class Reader:
    """Predicts texts; a worker looks each distinct word up once."""

    def __init__(self, model: Model):
        self.model = model
        self.vectors, self.layer = model.folded()
        self.width = self.vectors.shape[1] + 1
        self.cache = arrays.SpanCache(self._look_up, most=1 << 17)

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word's sum of vectors and of its number of features."""
        ids, n = word_features(words, len(self.vectors))
        out = np.empty((len(words), self.width), np.float32)
        out[:, :-1] = np.add.reduceat(self.vectors[ids], np.cumsum(n) - n, axis=0) if len(words) else 0
        out[:, -1] = n
        return out.view(np.int32).ravel(), np.full(len(words), self.width, np.int64)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the likeliest language, or -1 where there is no letter; its probability)."""
        best, p = np.full(len(texts), -1), np.zeros(len(texts))
        r = arrays.letter_runs(texts)
        at, _, ids = self.cache.spans(r.start, r.end, r.key, r.low)
        some, begin = np.unique(r.text, return_index=True)
        if not len(some) or not self.model.langs:
            return best, p
        words = ids.view(np.float32)
        sums = np.stack([np.add.reduceat(words[at + k].astype(float), begin) for k in range(self.width)], axis=1)
        mean = sums[:, :-1] / sums[:, -1:]
        z = (mean if self.layer is None else mean @ self.layer.T) + self.model.bias
        told = softmax(z / self.model.temperature)
        best[some], p[some] = told.argmax(axis=1), told.max(axis=1)
        return best, p


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text."""
    scratch.ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = Reader(model), pa.array([*model.langs, UNKNOWN])
        for batch in batches:
            for lo, hi, raw in arrays.text_chunks(batch.column(1)):
                best, p = reader.predict([x.decode() for x in raw])
                told = names.take(pa.array(np.where(best < 0, len(model.langs), best)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), told, pa.array(p), pa.array((best >= 0) & (p < model.threshold))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(arrays.tidy(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
