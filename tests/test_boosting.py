"""Boosted trees against a plain recursive version, and what monotone, weighted and quantile fits promise."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators import boosting, models

EDGES = [[-1.0, -0.5, 0.0, 0.5, 1.0], [0.0, 1.0, 2.0], [0.3, 0.6]]
NAMES = ["a", "b", "c"]


def data(n=500, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.random(n)])
    x[rng.random((n, 3)) < 0.15] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 + (np.nan_to_num(x[:, 1]) == 2) - np.nan_to_num(x[:, 2]) + np.isnan(x[:, 2]) + rng.normal(size=n) * 0.5
    return x, y, rng.integers(1, 4, n).astype(float)


def frame(spark, x, y, w):
    return spark.createDataFrame([(*(None if math.isnan(v) else float(v) for v in r), float(t), float(u)) for r, t, u in zip(x, y, w, strict=True)], "a double, b double, c double, y double, w double").repartition(5)


def plain_fit(x, y, w, *, objective, signs, rounds, depth, rate, least, penalty=1.0, alpha=0.5):
    """Scores of the training rows, by trees grown node by node."""
    if objective == "quantile":
        base = np.sort(y)[math.ceil(alpha * len(y)) - 1]
    else:
        base = (w * y).sum() / w.sum()
        base = math.log(base / (1 - base)) if objective == "logistic" else base
    f = np.full(len(y), base)
    goes_left = lambda j, e, missing: np.where(np.isnan(x[:, j]), missing, x[:, j] <= e)
    worth = lambda g, h, v: -(2 * g * v + (h + penalty) * v * v)
    free = objective == "quantile"

    def grow(rows, level, low, high):
        g, h, wt = grad[rows].sum(), curve[rows].sum(), w[rows].sum()
        clip = lambda v: min(max(v, low), high)
        own = clip(-g / (h + penalty))
        found = []
        if level < depth:
            for j in range(3):
                for k, e in enumerate([*EDGES[j], math.inf]):
                    for missing in (True, False):
                        left = rows & goes_left(j, e, missing)
                        right = rows & ~left
                        if w[left].sum() < least or w[right].sum() < least:
                            continue
                        (ga, ha), (gb, hb) = ((grad[s].sum(), curve[s].sum()) for s in (left, right))
                        a, b = clip(-ga / (ha + penalty)), clip(-gb / (hb + penalty))
                        if signs[j] * (b - a) >= 0:
                            found.append((worth(ga, ha, a) + worth(gb, hb, b) - worth(g, h, own), j, k, not missing, a, b, left, right))
        top = max((s[0] for s in found), default=0.0)
        if not found or top <= 1e-9 * max(1.0, abs(worth(g, h, own))):
            v = own
            if free:
                left_over = np.sort((y - f)[rows])
                v = left_over[math.ceil(alpha * len(left_over)) - 1]
            return [(rows, v)]
        _, j, _, _, a, b, left, right = min((s for s in found if s[0] >= top * (1 - 1e-9)), key=lambda s: s[1:4])
        mid = (a + b) / 2
        bounds = {0: [(low, high)] * 2, 1: [(low, mid), (mid, high)], -1: [(mid, high), (low, mid)]}[0 if free else signs[j]]
        both = [grow(left, level + 1, *bounds[0]), grow(right, level + 1, *bounds[1])]
        if free and signs[j]:
            below, above = both if signs[j] > 0 else both[::-1]
            if max(v for _, v in below) > min(v for _, v in above):
                m = (max(v for _, v in below) + min(v for _, v in above)) / 2
                below[:] = [(r, min(v, m)) for r, v in below]
                above[:] = [(r, max(v, m)) for r, v in above]
        return both[0] + both[1]

    for _ in range(rounds):
        if objective == "squared":
            grad, curve = w * (f - y), w
        elif objective == "logistic":
            p = 1 / (1 + np.exp(-f))
            grad, curve = w * (p - y), w * p * (1 - p)
        else:
            grad, curve = w * np.where(f >= y, 1 - alpha, -alpha), w
        leaves = grow(np.ones(len(y), bool), 0, -math.inf, math.inf)
        if len(leaves) == 1:
            break
        f = f + rate * sum(r * v for r, v in leaves)
    return 1 / (1 + np.exp(-f)) if objective == "logistic" else f


@pytest.mark.parametrize(("objective", "signs", "depth"), [("squared", (1, 0, -1), 3), ("logistic", (1, 0, 0), 2), ("quantile", (1, 0, -1), 2)])
def test_trees_are_those_of_a_plain_version(spark, objective, signs, depth):
    x, y, w = data()
    y = (y > 0.5).astype(float) if objective == "logistic" else y
    how = {"rounds": 4, "depth": depth, "rate": 0.4, "least": 12.0, "alpha": 0.7}
    made = boosting.fit(frame(spark, x, y, w), NAMES, "y", weight=F.col("w"), objective=objective, edges=EDGES, monotone=dict(zip(NAMES, signs, strict=True)), cut_every=2, **how)
    assert len(made.trees) == 4
    assert made.predict(x) == pytest.approx(plain_fit(x, y, w, objective=objective, signs=signs, **how), abs=1e-9)


def test_scores_of_a_column_and_importance(spark):
    x, y, w = data(300, 3)
    df = frame(spark, x, y, w)
    made = boosting.fit(df, NAMES, "y", bins=8, rounds=5, depth=3, rate=0.5)
    got = {(r["a"], r["b"], r["c"]): r["s"] for r in df.withColumn("s", made.column()).collect()}
    want = made.predict(x)
    for r, s in zip(x, want, strict=True):
        assert got[tuple(None if math.isnan(v) else float(v) for v in r)] == pytest.approx(s)
    assert ((want - y) ** 2).mean() < 0.6 * y.var()
    told = boosting.importance(made)
    assert max(told, key=told.get) == "a"


def test_monotone_features_never_turn(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=600), rng.normal(size=600), rng.random(600)])
    y = np.sin(3 * x[:, 0]) + x[:, 0] + x[:, 1] * x[:, 0] + rng.normal(size=600)
    for objective in ("squared", "quantile"):
        made = boosting.fit(frame(spark, x, y, np.ones(600)), NAMES, "y", objective=objective, alpha=0.5, bins=16, monotone={"a": 1}, rounds=8, depth=3, rate=0.5)
        grid = np.linspace(-3, 3, 80)
        for b in (-1.5, 0.0, 1.5):
            p = made.predict(np.column_stack([grid, np.full(80, b), np.full(80, 0.5)]))
            assert (np.diff(p) >= -1e-12).all()


def test_a_quantile_fit_covers_its_share(spark):
    x, y, w = data(900, 5)
    made = boosting.fit(frame(spark, x, y, w), NAMES, "y", objective="quantile", alpha=0.9, rounds=10, depth=2, rate=0.5, bins=8)
    assert 0.86 < (y <= made.predict(x)).mean() < 0.94


def test_models_side_by_side_are_those_of_one_by_one(spark):
    x, y, w = data(400, 6)
    df = frame(spark, x, y, w).withColumn("year", (F.col("w") + 2000).cast("int"))
    how = {"edges": EDGES, "rounds": 3, "depth": 2, "rate": 0.5}
    both = boosting.causal_fits(df, NAMES, "y", "year", [2001, 2002, 2003], half_life=1.0, **how)
    assert both[2001].trees == [] and both[2001].base == 0.0
    alone = boosting.fit(df.filter("year <= 2002"), NAMES, "y", weight=F.pow(F.lit(0.5), F.lit(2002) - F.col("year")), **how)
    assert both[2003].predict(x) == pytest.approx(alone.predict(x), abs=1e-9)
    got = boosting.scored(df, both, "year").filter("score is null").select("year").distinct().collect()
    assert [r["year"] for r in got] == [2001]


def test_later_rows_change_no_earlier_model(spark):
    s = [(k, p, float((k * 7 + p * 3) % 11), float(k % 5)) for k in range(60) for p in range(2000, 2005)]
    df = spark.createDataFrame(s, "k long, p long, m double, g double")
    how = {"edges": [[float(i) for i in range(11)], [1.0, 2.0, 3.0]], "rounds": 2, "depth": 1, "least": 2.0}
    made = lambda d: {(r["k"], r["p"]): (r["dv"], r["dv2"], r["surprise"]) for r in models.expected_changes(d, "k", "p", ["m", "g"], {"dv": "m"}, {"dv2": "m"}, "m", [2001, 2002, 2003], **how).collect()}
    a, b = made(df), made(df.withColumn("m", F.when(F.col("p") > 2002, F.col("m") * 100).otherwise(F.col("m"))))
    assert all(a[k] == b[k] for k in a if k[1] <= 2002) and any(a[k] != b[k] for k in a if k[1] == 2003)
    assert all(v[1] is None for k, v in a.items() if k[1] == 2001)


def test_odd_training_tables(spark):
    empty = spark.createDataFrame([], "a double, b double, c double, y double, w double")
    assert boosting.fit(empty, NAMES, "y", edges=EDGES).predict(np.zeros((2, 3))).tolist() == [0.0, 0.0]
    x, y, w = data(50, 7)
    same = boosting.fit(frame(spark, x, np.full(50, 3.0), w), NAMES, "y", edges=EDGES)
    assert same.trees == [] and same.base == 3.0
    with pytest.raises(ValueError, match="objective"):
        boosting.fit(empty, NAMES, "y", objective="other")


def test_quantiles_of_large_leaves_are_exact(spark):
    """Beyond 10,000 rows, where an approximate percentile of that accuracy is off."""
    df = spark.range(60_000, numPartitions=8).select((F.hash("id") % 1_000_003).cast("double").alias("y"), F.lit(1.0).alias("x"))
    fit = boosting.fit(df, ["x"], "y", objective="quantile", alpha=0.8, edges=[[]], rounds=1, depth=1)
    assert fit.base == sorted(r["y"] for r in df.collect())[48_000 - 1]
