"""Price, probability and rate formulas."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.nulls import col, sdiv
from orderloom.operators.lineage import ship

#: Coefficients of the rational approximation of the inverse normal distribution.
CENTRE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
CENTRE_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL_FROM = 0.02425


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def norm_ppf(p: Column | str) -> Column:
    """Inverse of the normal distribution, to nine digits; NULL outside (0, 1). Each use of p repeats it: give a plain column."""
    p = col(p)
    inner = p - 0.5
    square = inner * inner
    centre = inner * _poly(square, CENTRE) / _poly(square, CENTRE_BELOW)
    far = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _poly(far, TAIL) / _poly(far, TAIL_BELOW)
    return F.when((p <= 0) | (p >= 1), None).when(p < TAIL_FROM, tail).when(p > 1 - TAIL_FROM, -tail).otherwise(centre)


def with_ppf(df: DataFrame, p: str, name: str) -> DataFrame:
    """df with the inverse normal of a column, in steps, so that no expression holds another many times over."""
    inner = F.col(p) - 0.5
    df = df.withColumns({"_inner": inner, "_square": inner * inner, "_far": F.sqrt(-2 * F.ln(F.least(F.col(p), 1 - F.col(p))))})
    centre = F.col("_inner") * _poly(F.col("_square"), CENTRE) / _poly(F.col("_square"), CENTRE_BELOW)
    tail = _poly(F.col("_far"), TAIL) / _poly(F.col("_far"), TAIL_BELOW)
    c = F.col(p)
    out = F.when((c <= 0) | (c >= 1), None).when(c < TAIL_FROM, tail).when(c > 1 - TAIL_FROM, -tail).otherwise(centre)
    return df.withColumn(name, out).drop("_inner", "_square", "_far")


def price_probability(price: Column | str) -> Column:
    """Win probability that an American price implies."""
    c = col(price)
    return F.when(c < 0, -c / (-c + 100.0)).when(c > 0, 100.0 / (c + 100.0))


def probability_price(p: Column | str) -> Column:
    c = col(p)
    return F.when(c > 0.5, -100.0 * c / (1 - c)).when((c > 0) & (c <= 0.5), 100.0 * (1 - c) / c)


def fair(a: Column, b: Column) -> Column:
    """Probability of the first side without the margin; the raw one if the other side has no price."""
    return F.when(b.isNull(), a).otherwise(sdiv(a, a + b))


SLOTS = 60
STEPS = 60  # of the bisection


def slot_weights(centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Normal weights of the slots 1..SLOTS, one row each, scaled to sum 1; a centre far outside does not underflow."""
    slots = np.arange(1, SLOTS + 1, dtype=float)
    power = np.square((slots - centre[:, None]) / spread[:, None])
    w = np.exp(-0.5 * (power - power.min(axis=1, keepdims=True)))
    return w / w.sum(axis=1, keepdims=True)


def slot_means(line: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Mean slot of a discretised normal of spread 1 + line / 5 that has a share ``under`` of its mass below the line.

    The share is held to 0.02 .. 0.98 and is a half where it is missing; the centre is found by bisection.
    """
    share = np.clip(np.where(np.isnan(under), 0.5, under), 0.02, 0.98)
    spread, below = 1 + 0.2 * line, np.arange(1, SLOTS + 1) < line[:, None]
    low, high = np.full(len(line), -80.0), np.full(len(line), 140.0)
    for _ in range(STEPS):
        middle = (low + high) / 2
        more = (slot_weights(middle, spread) * below).sum(axis=1) > share  # too much below: the centre moves up
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return slot_weights((low + high) / 2, spread) @ np.arange(1, SLOTS + 1, dtype=float)


def expected_slot(df: DataFrame, line: str, under: str, name: str) -> DataFrame:
    """df with the mean slot for its lines and shares, solved once for each distinct pair; NULL where the line is."""

    @F.pandas_udf("double")
    def solve(lines: pd.Series, shares: pd.Series) -> pd.Series:
        a, b = lines.to_numpy(float), shares.to_numpy(float)
        parts = [slot_means(a[i : i + 4096], b[i : i + 4096]) for i in range(0, len(a), 4096)]
        return pd.Series(np.concatenate(parts or [np.zeros(0)]))

    ship(df.sparkSession)
    pairs = df.select(F.col(line).cast("double").alias("_line"), F.col(under).cast("double").alias("_under")).filter("_line is not null").distinct()
    solved = pairs.withColumn(name, solve("_line", "_under"))
    same = (F.col(line).cast("double") == F.col("_line")) & F.col(under).cast("double").eqNullSafe(F.col("_under"))
    return df.join(solved, same, "left").drop("_line", "_under")


def shrink(x: Column, n: Column, prior: Column | float, k: float) -> Column:
    """Empirical-Bayes mean of an own value seen n times and a prior worth k."""
    prior = F.lit(prior) if isinstance(prior, (int, float)) else prior
    return F.coalesce(n / (n + k) * x + k / (n + k) * prior, prior)


def per(x: Column, minutes: Column, unit: float) -> Column:
    """Rate per unit of minutes."""
    return sdiv(x * unit, minutes)


def shooting(points: Column, attempts: Column, free: Column) -> Column:
    """Points per two true attempts."""
    return sdiv(points, 2 * (attempts + 0.44 * free))


def value_above(rating: Column, minutes: Column, pace: Column | float = 1.0, floor: float = -2.0, scale: float = 1.0) -> Column:
    return scale * (rating - floor) * minutes * pace


def sign_log(x: Column | str) -> Column:
    return F.signum(col(x)) * F.log1p(F.abs(col(x)))
