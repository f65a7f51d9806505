"""Language identification: features and predictions against plain versions, accuracy on rows that did not train, defined cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import arrays, language

SCHEMA = "doc_id long, text string, lang string, source string, score int, rejected string, draw long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2) for i, t, lang in rows], SCHEMA)


def slow_buckets(word, buckets):
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in language.GRAMS for i in range(len(marked) - n + 1)]
    out = []
    for k, g in enumerate(grams):
        values = arrays.mix(np.array([ord(c) + 1 for c in g], np.uint64))
        total = sum(int(v) * pow(int(arrays.BASE), i, 1 << 64) for i, v in enumerate(values)) % (1 << 64)
        key = int(arrays.mix(np.array([total], np.uint64))[0]) + (0 if k == 0 else len(g))
        out.append(int(arrays.mix(np.array([key % (1 << 64)], np.uint64))[0]) % buckets)
    return out


def test_features_are_those_of_the_definition():
    words = ["a", "él", "strasse", "q" * 50, "𐐀x"]
    got, n = language.word_features(words, 1000)
    at = 0
    for w, k in zip(words, n.tolist(), strict=True):
        assert sorted(got[at : at + k].tolist()) == sorted(slow_buckets(w, 1000))
        at += k
    assert at == len(got)


@pytest.mark.parametrize("dimensions", [2, 8])  # fewer and more than languages
def test_predictions_are_softmax_of_mean_rows(dimensions):
    rnd = np.random.default_rng(2)
    model = language.Model(["a", "b", "c"], rnd.normal(size=(97, dimensions)).astype(np.float32), rnd.normal(size=(3, dimensions)), rnd.normal(size=3), 0.7, 0.5)
    texts = ["Él dit OUI", "123 %%", "", "x", "mot " * 3000 + "fin", "x x y"]
    best, p = language.Reader(model).predict(texts)
    for t, k, score in zip(texts, best.tolist(), p.tolist(), strict=True):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        if not words:
            assert (k, score) == (-1, 0.0)
            continue
        rows = model.table[[b for w in words for b in slow_buckets(w, 97)]].astype(float)
        z = (model.layer @ rows.mean(axis=0) + model.bias) / 0.7
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert k == int(want.argmax()) and score == pytest.approx(want.max(), abs=1e-5)


def test_a_step_goes_down_the_slope():
    rnd = np.random.default_rng(0)
    n = rnd.integers(3, 9, 40)
    first, y = np.append(0, np.cumsum(n)), rnd.integers(0, 3, 40)
    bucket, times = np.where(rnd.random(n.sum()) < 0.5, np.repeat(y, n), rnd.integers(3, 50, n.sum())), rnd.integers(1, 4, n.sum()).astype(float)
    loss = []
    for steps in (1, 40, 400):
        table, layer, bias = language.descend(y, first, bucket, times, 3, 50, dimensions=4, steps=steps, step=1.0, at_once=8, seen=5, seed=1)
        z = language._means(table, n, bucket, times)[0] @ layer.T + bias
        loss.append(-np.log(language.softmax(z)[np.arange(40), y]).mean())
    assert loss[0] > loss[1] > loss[2] < 0.1


def test_temperature_calibrates():
    rnd = np.random.default_rng(1)
    z = rnd.normal(size=(4000, 3)) * 2
    y = np.array([rnd.choice(3, p=p) for p in language.softmax(z)])
    assert 2.6 < language.temperature_of(z * 3, y) < 3.4
    assert language.temperature_of(np.eye(3)[y] * 30, y) > 0.5  # never sure beyond what so many texts can show


def words_of(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_held_out_rows_and_defined_cases(spark):
    rnd = random.Random(5)
    kinds = {"xx": ["ba", "to", "mi", "ru"], "yy": ["sch", "ung", "ei", "to"], "zz": ["ção", "lh", "mi", "ão"]}
    rows = [(i, words_of(rnd, kinds[lang], rnd.randint(1, 40)), lang) for i, lang in enumerate(rnd.choices(list(kinds), [8, 3, 1], k=600))]
    odd = [(900, None, "xx"), (901, "", "yy"), (902, "12 %% 3", "zz"), (903, words_of(rnd, kinds["zz"], 3000), None), (None, words_of(rnd, kinds["yy"], 9), "yy"), (None, None, None), (904, "s" * 9000, "xx")]
    copies = [(5, rows[5][1], rows[5][2])] * 300  # one row again and again
    docs = docs_of(spark, rows + odd + copies).repartition(5)
    model = language.fit(docs, steps=600)
    assert model.langs == ["xx", "yy", "zz"] and 0 < model.threshold <= 1
    told = language.predict(docs, model)
    assert told.columns == ["doc_id", "lang_pred", "score", "rejected"] and told.count() == len(rows) + len(odd) + len(copies)
    got = {r["doc_id"]: r for r in told.filter("doc_id is not null").collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) for i in (900, 901, 902)] == [("und", 0.0, False)] * 3
    assert got[903]["lang_pred"] == "zz"
    out = {r["doc_id"] for r in docs.filter(language.fold(F.col("doc_id")) == language.HELD_OUT).collect()}
    held = [(got[i]["lang_pred"], lang, got[i]["rejected"]) for i, t, lang in rows if i in out and len(t) > 12]
    assert len(held) > 90 and sum(a == b for a, b, _ in held) >= 0.98 * len(held)
    assert sum(no for _, _, no in held) < 0.1 * len(held)


def test_held_out_labels_and_names_do_not_matter(spark):
    rnd = random.Random(6)
    rows = [(i, words_of(rnd, ["ba", "to"] if i % 2 else ["sch", "ung"], 20), "x" if i % 2 else "y") for i in range(80)]
    docs = docs_of(spark, rows)
    held = language.fold(F.col("doc_id")) == language.HELD_OUT
    other = docs.withColumn("lang", F.when(held, F.lit("q")).otherwise(F.col("lang"))).withColumn("source", F.col("lang"))
    a, b = (language.fit(d, steps=50) for d in (docs, other))
    assert a.langs == b.langs == ["x", "y"] and np.array_equal(a.table, b.table) and a.threshold == b.threshold


def test_without_labels_with_one_language_and_without_rows(spark):
    none = docs_of(spark, [(1, "abc", None), (2, None, None)])
    assert {tuple(r) for r in language.predict(none, language.fit(none)).collect()} == {(1, "und", 0.0, False), (2, "und", 0.0, False)}
    one = docs_of(spark, [(i, "abc", "en") for i in range(9)] + [(20, "..", "en")])
    assert {(r["lang_pred"], r["score"]) for r in language.predict(one, language.fit(one)).collect()} == {("en", 1.0), ("und", 0.0)}
    empty = docs_of(spark, [])
    assert language.predict(empty, language.fit(empty)).count() == 0


def test_the_sample_keeps_its_bounds(spark):
    rnd = random.Random(8)
    rows = [(i, words_of(rnd, ["ba", "to", "x"], 9) + f" w{'a' * (i % 50)}", "x") for i in range(500)] + [(1000 + i, words_of(rnd, ["u", "o"], 9), "y") for i in range(40)] + [(7, "same text", "x")] * 400
    docs = docs_of(spark, rows)
    langs, y, first, bucket, times, draw = language._sample(docs, 60, 4_000_000, 1 << 12)
    assert langs == ["x", "y"] and len(y) <= 60 and (y == 1).sum() >= 15 and first[-1] == len(bucket) == len(times)
    small = language._sample(docs, 500, 2_000, 1 << 12)
    assert 0 < len(small[3]) <= 2_600
