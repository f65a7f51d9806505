"""Exact quantiles by brackets against sorted values, with hot groups, ties and forced refinement."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators import selection

SHARES = [0.0, 0.1, 0.5, 0.77, 1.0]


def rows_of(n=9000):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        g = rnd.choice(["hot", "hot", "ties", "a", "b", None])
        x = {"ties": float(rnd.randint(0, 3)), "a": rnd.choice([None, rnd.gauss(0, 1)]), "b": -0.0 if i % 2 else 10.0 ** rnd.randint(-300, 300)}.get(g, rnd.expovariate(1) ** 4)
        out.append((g, x))
    return [*out, ("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)]


@pytest.mark.parametrize(("accuracy", "most"), [(20_000, 1 << 20), (50, 1 << 20), (50, 150), (200, 1)])
def test_quantiles_are_those_of_sorted_values(spark, accuracy, most):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r["g"]: r for r in selection.quantiles(df, ["g"], "x", SHARES, accuracy=accuracy, most=most).collect()}
    by = {}
    for g, x in rows:
        by.setdefault(g, []).extend([] if x is None else [x])
    assert got.keys() == by.keys()
    for g, own in by.items():
        assert got[g]["n"] == len(own)
        for k, p in enumerate(SHARES):
            assert got[g][f"q{k}"] == (pytest.approx(float(np.quantile(own, p)), rel=1e-12) if own else None)


def test_a_hot_group_is_many_tasks(spark):
    df = spark.range(40_000, numPartitions=8).select(F.lit("hot").alias("g"), F.hash("id").cast("double").alias("x"))
    got = selection.quantiles(df, ["g"], "x", [0.5], accuracy=500)
    plan = got._jdf.queryExecution().toString()
    assert "percentile(" not in plan and got.first()["q0"] == df.agg(F.percentile("x", F.lit(0.5))).first()[0]


def test_no_rows(spark):
    assert selection.quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", [0.5]).count() == 0


@pytest.mark.parametrize("accuracy", [20_000, 50])
def test_discrete_quantiles_are_values(spark, accuracy):
    rows = rows_of()
    got = {r["g"]: r for r in selection.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", SHARES, accuracy=accuracy, discrete=True).collect()}
    for g, r in got.items():
        own = sorted(x for k, x in rows if k == g and x is not None)
        for k, p in enumerate(SHARES):
            assert r[f"q{k}"] == (own[max(len(own) - math.floor(len(own) - len(own) * p) - 1, 0)] if own else None)
