"""The conditional random field by enumeration, and what its scores may and may not depend on."""

from __future__ import annotations

import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import queries, toxicity

SHAPES = [(1, [0]), (6, [1, 2, 5]), (7, [0, 4]), (5, [4]), (4, []), (1, []), (0, []), (8, [0, 1, 2, 7]), (3, [2])]


@pytest.fixture(scope="module")
def chains():
    rng = np.random.default_rng(4)
    size = np.array([n for n, _ in SHAPES])
    count = np.array([len(a) for _, a in SHAPES])
    at = np.array([i for _, a in SHAPES for i in a], np.int64)
    seen = rng.standard_normal((len(at), toxicity.OBSERVED))
    tag = rng.integers(0, 2, len(at)).astype(float)
    return toxicity.Chains(size, count, at), seen, tag


def by_enumeration(seen, tag, theta):
    moves, bias, weights = theta[:4].reshape(2, 2), theta[4], theta[5:]
    value, marginals, k = 0.0, [], 0
    for n, at in SHAPES:
        obs = dict(zip(at, seen[k : k + len(at)] @ weights, strict=True))
        have = dict(zip(at, tag[k : k + len(at)], strict=True))
        k += len(at)
        score = lambda tags: sum(moves[a, b] for a, b in zip(tags, tags[1:], strict=False)) + sum(t * (bias + obs.get(i, 0)) for i, t in enumerate(tags))  # noqa: E731, B023
        every = [(t, np.exp(score(t))) for t in product((0, 1), repeat=n)]
        total = sum(w for _, w in every)
        marginals += [sum(w for t, w in every if t[i]) / total for i in at]
        value += score(tuple(int(have.get(i, 0)) for i in range(n))) - np.log(total)
    return value, np.array(marginals)


def test_likelihood_gradient_and_marginals_by_enumeration(chains):
    own, seen, tag = chains
    rng = np.random.default_rng(7)
    for _ in range(4):
        theta = rng.standard_normal(5 + toxicity.OBSERVED)
        value, slope = toxicity.likelihood(own, seen, tag, theta, ridge=0.0)
        want, marginals = by_enumeration(seen, tag, theta)
        assert value == pytest.approx(want, abs=1e-9)
        assert own.run(theta[:4].reshape(2, 2), theta[4], seen @ theta[5:])[1] == pytest.approx(marginals, abs=1e-9)
        for i in range(len(theta)):
            d = np.zeros(len(theta))
            d[i] = 1e-5
            numeric = (by_enumeration(seen, tag, theta + d)[0] - by_enumeration(seen, tag, theta - d)[0]) / 2e-5
            assert slope[i] == pytest.approx(numeric, abs=1e-5), i


def test_long_stretches_do_not_overflow():
    own = toxicity.Chains(np.array([2_000_000, 5]), np.array([2, 0]), np.array([10, 1_999_000]))
    total, marginal, uses = own.run(np.array([[1.0, -3.0], [-2.0, 2.0]]), -1.0, np.array([4.0, 30.0]))
    assert np.isfinite(total).all() and np.isfinite(uses).all() and ((marginal >= 0) & (marginal <= 1)).all()
    assert uses[:4].sum() == pytest.approx(1_999_999 + 4)


def test_ascent_reaches_a_flat_point(chains):
    own, seen, tag = chains
    f = lambda v: toxicity.likelihood(own, seen, tag, v, 0.5)
    theta = toxicity.ascend(f, np.zeros(5 + toxicity.OBSERVED), 200)
    assert np.abs(f(theta)[1]).max() < 1e-3


def corpus(seed=2, n=400):
    rnd = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 50))]
        if i % 5 == 0:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "NASTY!", "Vilest"]))
        rows.append((i, " ".join(words), i % 5 == 0))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    def write(name, labels):
        d = str(tmp_path_factory.mktemp(name))
        rows = [(i, t, "en", "s", len(t)) for i, t, _ in corpus()] + [(900, None, "en", "s", 0), (901, "", None, None, 0), (None, "vile vile", "en", "s", 9)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        return d

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    true = [(i, 1, int(bad)) for i, _, bad in corpus()]
    turned = [(i, 0, 1 - y if held(i) else y) for i, _, y in true]
    return write("true", true), write("turned", turned)


def test_query_columns_and_held_out_rows(spark, tables):
    got = queries.op6_toxicity(spark, tables[0]).collect()
    assert len(got) == 403
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    right = [r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(right) >= 0.97 * len(right)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[900]["score"] == by_id[901]["score"] < 0.5


def test_labels_of_fold_zero_change_no_score(spark, tables):
    one, other = ({r["doc_id"]: r["score"] for r in queries.op6_toxicity(spark, d).collect()} for d in tables)
    assert one == other


def test_conflicting_labels_all_count(spark, tables):
    docs, labels = spark.read.parquet(f"{tables[0]}/documents.parquet"), spark.read.parquet(f"{tables[0]}/labels.parquet")
    both = labels.union(labels.withColumn("toxic", 1 - F.col("toxic")))
    assert {r["y"]: r["count"] for r in toxicity.train_rows(docs, both).groupBy("y").count().collect()} == {0: 400, 1: 400}
    assert toxicity.fit(docs, both).prior == pytest.approx(0.5, abs=0.01)


def test_offsets_are_those_of_the_text(spark):
    model = toxicity.Model({"vile": 5.0, "vile*": 3.0}, bias=-4.0, weights=np.array([4.0, 1.0, 1.0, 0.0, 0.0, 0.0]), layer=(-3.0, 6.0, 0.0))
    texts = {1: "İİİ vile", 2: "x VILE! ǅ vilest 😀 vile", 3: "é" * 50_000 + " vile " + "word " * 100_000 + "vile", 4: "vil e", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["offsets"]] for r in toxicity.score(docs, model).collect()}
    assert got[1] == [(4, 8)] and got[4] == [] and got[5] == []
    assert [texts[2][a:b] for a, b in got[2]] == ["VILE", "vilest", "vile"]
    assert [texts[3][a:b] for a, b in got[3]] == ["vile", "vile"]


def test_keep_with_clashing_names(spark):
    model = toxicity.Model({"vile": 5.0}, bias=-4.0, weights=np.array([4.0, 1.0, 0, 0, 0, 0]), layer=(-3.0, 6.0, 0.0))
    docs = spark.createDataFrame([(1, "a vile one", 2, "y"), (None, "fine", 3, "z"), (None, "fine", 3, "z")], "doc_id long, text string, c1 int, score string").withColumn("a.b", F.lit(1))
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(None, "fine", 3, "z", 1)] * 2


def test_sample_bounds(spark):
    rows = corpus(n=300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most_docs=120, most_marks=20)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert sum((scores[i] >= 0.5) == bool(b) for i, _, b in rows) >= 0.95 * len(rows)
