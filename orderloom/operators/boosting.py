"""Boosted trees from histograms that Spark aggregates: several objectives, monotone features, many models at once.

Features become bins once. Each level of each tree is one aggregate: gradients and curvatures by
model, node, feature and bin, combined in the tasks, of which the driver sees at most
``models * 2 ** level * features * (bins + 1)`` rows, whatever the number of training rows. It
picks the splits, and rows find their node by a look-up in literals, so no join and no shuffle of
rows is needed. Models that differ in their rows and weights only (one for each year, say, on what
was known by then) grow side by side in the same jobs: a training row stands once for each model
that gives it a weight.

Objectives: ``squared``; ``logistic`` for outcomes 0 and 1; ``quantile`` for the alpha-th quantile
(pinball loss: splits by its gradients with unit curvature, leaves at the quantile of what is left
in them, rows of any positive weight counting alike there). Recency enters as a weight.

A monotone feature may only be split so that the side of larger values is not lower (1) or not
higher (-1), and bounds are handed down, so that no later split undoes it. Missing values go to
whichever side gains more. Gains within a billionth of the best are ties: the first feature, then
the lowest cut, then missing values to the left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.operators.guards import ban_columns
from orderloom.operators import selection
from orderloom.operators.lineage import cut, ship

OBJECTIVES = ("squared", "logistic", "quantile")


@dataclass
class Tree:
    """A full binary tree, level by level: split of each inner node (feature -1: all rows go left) and value of each leaf."""

    feature: list[list[int]] = field(default_factory=list)
    cut: list[list[int]] = field(default_factory=list)
    missing_left: list[list[bool]] = field(default_factory=list)
    gain: list[list[float]] = field(default_factory=list)
    value: list[float] = field(default_factory=list)


@dataclass
class Booster:
    features: list[str]
    edges: list[list[float]]  # of each feature: a value's bin is one more than the number of edges below it, 0 if it is missing
    objective: str
    base: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of a matrix of raw values, NaN for missing ones."""
        out = np.zeros(x.shape, np.int64)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(np.array(e), x[:, j], side="left"))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Scores of a matrix of raw values; of ``logistic`` the chance of a 1."""
        b, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for t in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, c, m in zip(t.feature, t.cut, t.missing_left, strict=True):
                own = b[rows, np.maximum(np.array(f), 0)[node]]
                right = np.where(own == 0, ~np.array(m)[node], own > np.array(c)[node]) & (np.array(f)[node] >= 0)
                node = 2 * node + right
            total += np.array(t.value)[node]
        return 1 / (1 + np.exp(-total)) if self.objective == "logistic" else total

    def column(self) -> Column:
        """The score as an expression in Arrow batches, for a table that has the features."""
        arrays = [F.col(c).cast("double") for c in self.features]

        @F.pandas_udf("double")
        def score(*x: pd.Series) -> pd.Series:
            return pd.Series(self.predict(np.column_stack([c.to_numpy(float) for c in x])))

        return score(*arrays)


def quantile_edges(df: DataFrame, features: list[str], bins: int = 32) -> list[list[float]]:
    """Up to bins - 1 inner edges of each feature, at approximate quantiles."""
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), [i / bins for i in range(1, bins)], 100 * bins).alias(f"q{i}") for i, c in enumerate(features))).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(len(features))]


def binned(df: DataFrame, features: list[str], edges: list[list[float]]) -> Column:
    """The bins of a row's features as an array."""
    one = lambda c, e: F.when(c.isNull() | F.isnan(c), 0).otherwise(F.size(F.filter(F.lit([float(v) for v in e]) if e else F.array().cast("array<double>"), lambda v: v < c)) + 1)
    return F.array(*(one(F.col(c).cast("double"), e).cast("int") for c, e in zip(features, edges, strict=True)))


# -- splits ----------------------------------------------------------------------------------


def leaf_value(g, h, penalty: float, low, high):
    return np.clip(-g / (h + penalty), low, high)


def _worth(g, h, w, penalty: float):
    """Twice by how much a leaf of value w lowers the loss."""
    return -(2 * g * w + (h + penalty) * w * w)


def best_split(hist: np.ndarray, monotone: list[int], penalty: float, least: float, low: float, high: float) -> tuple[float, int, int, bool, float, float] | None:
    """(gain, feature, cut, missing left, left value, right value) of a node, or None.

    hist: (feature, bin, 3) sums of gradient, curvature and weight; bin 0 is of missing values.
    """
    found = []
    total = hist[0].sum(axis=0)
    parent = _worth(total[0], total[1], leaf_value(total[0], total[1], penalty, low, high), penalty)
    for f in range(len(hist)):
        below = np.cumsum(hist[f, 1:], axis=0)  # the last cut parts missing values from all others
        for missing_left in (True, False):
            left = below + hist[f, 0] * missing_left
            right = total - left
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = (leaf_value(s[:, 0], s[:, 1], penalty, low, high) for s in (left, right))
                gain = _worth(left[:, 0], left[:, 1], a, penalty) + _worth(right[:, 0], right[:, 1], b, penalty) - parent
            fits = (left[:, 2] >= least) & (right[:, 2] >= least) & (monotone[f] * (b - a) >= 0)
            found += [(float(gain[c]), f, c + 1, missing_left, float(a[c]), float(b[c])) for c in np.flatnonzero(fits).tolist()]
    top = max((x[0] for x in found), default=0.0)
    if not found or top <= 1e-9 * max(1.0, abs(parent)):
        return None
    return min((x for x in found if x[0] >= top * (1 - 1e-9)), key=lambda x: (x[1], x[2], not x[3]))


def _grow_level(tree: Tree, hists: np.ndarray, bounds: list[tuple[float, float]], monotone: list[int], penalty: float, least: float) -> list[tuple[float, float]]:
    """One more level of a tree; the bounds of its children."""
    out, rows = [], []
    for hist, (low, high) in zip(hists, bounds, strict=True):
        s = best_split(hist, monotone, penalty, least, low, high)
        if s is None:
            rows.append((-1, 0, True, 0.0))
            out += [(low, high)] * 2
            continue
        gain, f, c, missing_left, a, b = s
        rows.append((f, c, missing_left, gain))
        mid = (a + b) / 2
        out += {0: [(low, high)] * 2, 1: [(low, mid), (mid, high)], -1: [(mid, high), (low, mid)]}[monotone[f]]
    for name, values in zip(("feature", "cut", "missing_left", "gain"), zip(*rows, strict=True), strict=True):
        getattr(tree, name).append(list(values))
    return out


def _in_order(tree: Tree, values: list[float], signs: list[int]) -> list[float]:
    """Leaf values held to the order of monotone splits: from the lowest level up, both sides meet halfway where they cross."""
    v, depth = np.array(values), len(tree.feature)
    for level in range(depth - 1, -1, -1):
        size = 1 << (depth - level)
        for n, f in enumerate(tree.feature[level]):
            if f >= 0 and signs[f]:
                a, b = v[n * size : n * size + size // 2], v[n * size + size // 2 : (n + 1) * size]
                low, high = (a, b) if signs[f] > 0 else (b, a)
                if low.max() > high.min():
                    mid = (low.max() + high.min()) / 2
                    np.minimum(low, mid, out=low)
                    np.maximum(high, mid, out=high)
    return v.tolist()


# -- training --------------------------------------------------------------------------------


def _slots(values: list[list], width: int) -> Column:
    """What the literal table values[model][node] holds at a row's model and node."""
    flat = [v for row in values for v in row]
    return F.get(F.lit(flat), F.col("model") * width + F.col("node"))


def _step(rows: DataFrame, trees: list[Tree], level: int) -> DataFrame:
    """rows with their nodes one level down."""
    width = 1 << level
    f, c, m = (_slots([getattr(t, name)[level] for t in trees], width) for name in ("feature", "cut", "missing_left"))
    own = F.get("bins", f)
    right = F.when(f < 0, False).when(own == 0, ~m).otherwise(own > c)
    return rows.withColumn("node", 2 * F.col("node") + right.cast("int"))


def _gradients(rows: DataFrame, objective: str, alpha: float) -> DataFrame:
    y, f, w = F.col("y"), F.col("f"), F.col("w")
    if objective == "squared":
        g, h = w * (f - y), w
    elif objective == "logistic":
        p = 1 / (1 + F.exp(-f))
        g, h = w * (p - y), w * p * (1 - p)
    else:
        g, h = w * F.when(f >= y, 1 - alpha).otherwise(-alpha), w
    return rows.withColumns({"g": g, "h": h})


def histograms(rows: DataFrame, models: int, nodes: int, shape: tuple[int, int]) -> np.ndarray:
    """(model, node, feature, bin, 3) sums of gradient, curvature and weight. rows: model, node, bins, g, h, w."""
    each = rows.select("model", "node", "g", "h", "w", F.posexplode("bins").alias("feature", "bin"))
    got = each.groupBy("model", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghw")).toPandas()
    out = np.zeros((models, nodes, *shape, 3))
    out[got["model"], got["node"], got["feature"], got["bin"]] = got[["g", "h", "w"]].to_numpy()
    return out


def _quantiles(rows: DataFrame, by: list[str], x: Column, alpha: float) -> DataFrame:
    """(by, b): the exact discrete quantile of each group of any size."""
    return selection.quantiles(rows, by, x, [alpha], discrete=True).select(*by, F.col("q0").alias("b"))


def fit_many(
    df: DataFrame, features: list[str], label: str, models: dict, *, objective: str = "squared", alpha: float = 0.5, monotone: dict[str, int] | None = None, edges: list[list[float]] | None = None, bins: int = 32,
    rounds: int = 50, depth: int = 3, rate: float = 0.1, least: float = 8.0, penalty: float = 1.0, cut_every: int = 4,
) -> dict:
    """A Booster for each model. models: name to the weight Column of training rows; null, zero or less: the row is not the model's.

    least: weight that either side of a split keeps; penalty: added to every leaf's curvature. Rows
    without a label do not train; a model without rows has base 0 and no trees.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"objective is one of {OBJECTIVES}")
    ban_columns(features, names=(label,))
    ship(df.sparkSession)
    names = list(models)
    edges = quantile_edges(df, features, bins) if edges is None else edges
    shape = len(features), max(map(len, edges), default=0) + 2
    signs = [(monotone or {}).get(c, 0) for c in features]
    weights = F.array(*(F.coalesce(models[n].cast("double"), F.lit(0.0)) for n in names))
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), binned(df, features, edges).alias("bins"), F.posexplode(weights).alias("model", "w")).filter("w > 0")
    if objective == "quantile":
        first = _quantiles(rows, ["model"], F.col("y"), alpha)
    else:
        first = rows.groupBy("model").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("b"))
    base = [0.0] * len(names)
    for r in first.collect():
        base[r["model"]] = r["b"]
    if objective == "logistic":
        base = [math.log(max(p, 1e-6) / max(1 - p, 1e-6)) if p else 0.0 for p in base]
    out = {n: Booster(list(features), edges, objective, float(b)) for n, b in zip(names, base, strict=True)}
    state = cut(rows.withColumn("f", F.get(F.lit([float(b) for b in base]), F.col("model"))))
    for k in range(rounds):
        trees, bounds = [Tree() for _ in names], [[(-math.inf, math.inf)] for _ in names]
        moved = _gradients(state, objective, alpha).withColumn("node", F.lit(0))
        for level in range(depth):
            hists = histograms(moved, len(names), 1 << level, shape)
            bounds = [_grow_level(t, h, b, signs, penalty, least) for t, h, b in zip(trees, hists, bounds, strict=True)]
            if objective == "quantile":  # leaves are not in the units of gradients: see _in_order
                bounds = [[(-math.inf, math.inf)] * len(b) for b in bounds]
            moved = _step(moved, trees, level)
        if not any(f >= 0 for t in trees for level in t.feature for f in level):
            break
        width = 1 << depth
        if objective == "quantile":
            left = _quantiles(moved, ["model", "node"], F.col("y") - F.col("f"), alpha).collect()
            found = {(r["model"], r["node"]): r["b"] for r in left}
        else:
            left = moved.groupBy("model", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            found = {(r["model"], r["node"]): -r["g"] / (r["h"] + penalty) for r in left}
        for m, (t, b) in enumerate(zip(trees, bounds, strict=True)):
            grown = any(f >= 0 for level in t.feature for f in level)
            values = [float(np.clip(found.get((m, n), 0.0), *b[n])) if grown else 0.0 for n in range(width)]
            t.value = [rate * v for v in (_in_order(t, values, signs) if objective == "quantile" else values)]
            if grown:
                out[names[m]].trees.append(t)
        state = moved.withColumn("f", F.col("f") + _slots([t.value for t in trees], width)).drop("g", "h", "node")
        if (k + 1) % cut_every == 0:
            state = cut(state)
    return out


def fit(df: DataFrame, features: list[str], label: str, *, weight: Column | None = None, **how) -> Booster:
    """One Booster; see ``fit_many``. weight: of each training row."""
    return fit_many(df, features, label, {"all": F.lit(1.0) if weight is None else weight}, **how)["all"]


def causal_fits(df: DataFrame, features: list[str], label: str, cohort: str, cohorts: list[int], *, lag: int = 1, half_life: float | None = None, **how) -> dict[int, Booster]:
    """A Booster for each listed cohort from the rows of cohorts at least lag before it, all in the same jobs; older rows weigh half each half_life."""
    age = lambda now: F.lit(now - lag) - F.col(cohort)
    weight = lambda now: F.when(age(now) >= 0, F.lit(1.0) if half_life is None else F.pow(F.lit(0.5), age(now) / half_life))
    return fit_many(df, features, label, {now: weight(now) for now in cohorts}, **how)


def scored(df: DataFrame, boosters: dict[int, Booster], cohort: str, name: str = "score") -> DataFrame:
    """df with the score of each row's own cohort's Booster, in one pass; NULL where there is none or it never saw a row."""
    ship(df.sparkSession)
    features = next(iter(boosters.values())).features
    known = {int(k): b for k, b in boosters.items() if b.trees or b.base}

    @F.pandas_udf("double")
    def score(c: pd.Series, *x: pd.Series) -> pd.Series:
        own, out, values = c.to_numpy(float), np.full(len(c), np.nan), np.column_stack([v.to_numpy(float) for v in x])
        for k, b in known.items():
            at = np.flatnonzero(own == k)
            out[at] = b.predict(values[at])
        return pd.Series(out).where(~np.isnan(out), None)

    return df.withColumn(name, F.nanvl(score(F.col(cohort).cast("double"), *(F.col(f).cast("double") for f in features)), F.lit(None).cast("double")))


def importance(booster: Booster) -> dict[str, float]:
    """Total gain of each feature's splits."""
    out = dict.fromkeys(booster.features, 0.0)
    for t in booster.trees:
        for fs, gains in zip(t.feature, t.gain, strict=True):
            for f, g in zip(fs, gains, strict=True):
                if f >= 0:
                    out[booster.features[f]] += g
    return out
