"""The similarity join against difflib over all pairs of a block."""

from __future__ import annotations

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from orderloom.operators import similar


def names(rnd, n, letters="abcde"):
    out = []
    for _ in range(n):
        base = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 3, 3, 4, 5, 6, 8, 12, 20])))
        for _ in range(rnd.randint(1, 3)):
            x = list(base)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randint(0, len(x))
                kind = rnd.randint(0, 2)
                if kind == 0:
                    x.insert(at, rnd.choice(letters))
                elif at < len(x):
                    x[at : at + 1] = [] if kind == 1 else [rnd.choice(letters)]
            out.append("".join(x))
    return out


def sides(spark, seed, n=90):
    rnd = random.Random(seed)
    rows = [[(i, rnd.choice(["t", "t", "u", None]), None if rnd.random() < 0.03 else x) for i, x in enumerate(names(rnd, n))] for _ in range(2)]
    rows[1] += [(1000 + i, b, x) for i, b, x in rows[0] if i % 3 == 0]
    return rows, [spark.createDataFrame(r, f"{c} long, team string, name string").repartition(3) for r, c in zip(rows, ("l", "r"), strict=True)]


def on():
    return (F.col("team"), F.col("team")), (F.col("name"), F.col("name"))


@pytest.mark.parametrize("least", [0.5, 0.68, 0.77, 0.9])
def test_every_pair_that_reaches_the_ratio(spark, least):
    (a, b), (left, right) = sides(spark, int(least * 100))
    want = {}
    for i, t, x in a:
        for j, u, y in b:
            if t is not None and t == u and x is not None and y is not None and (s := difflib.SequenceMatcher(None, x, y).ratio()) >= least - 1e-9:
                want[i, j] = s
    got = similar.similarity_join(left, right, "l", "r", *on(), least).collect()
    assert len(got) == len(want) and {(r["l"], r["r"]): r["score"] for r in got} == want
    assert len(want) > 60


def test_the_clear_best_of_each_row(spark):
    (a, b), (left, right) = sides(spark, 5)
    want = {}
    for i, t, x in a:
        own = sorted(((difflib.SequenceMatcher(None, x, y).ratio(), j) for j, u, y in b if u == t and y is not None), reverse=True) if t is not None and x is not None else []
        if own and own[0][0] >= 0.85 and (len(own) == 1 or own[0][0] - own[1][0] >= 0.08):
            want[i] = own[0][1]
    got = {r["l"]: r["r"] for r in similar.clear_best(left, right, "l", "r", *on(), 0.85, 0.08).collect()}
    assert got == want and len(want) > 5


def test_rows_meet_by_grams_only_and_few_reach_python(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    rows = [(i, "one", word()) for i in range(2000)]
    left = spark.createDataFrame(rows, "l long, team string, name string")
    right = left.select(F.col("l").alias("r"), "team", F.concat("name", F.lit("x")).alias("name"))
    joined = similar.similarity_join(left, right, "l", "r", *on(), 0.8)
    plan = joined._jdf.queryExecution().toString()
    keys = re.findall(r"Join \w+, \((.*)\)\n", plan.split("== Optimized")[1].split("== Physical")[0])
    assert "Cartesian" not in plan and "NestedLoop" not in plan and any("gram" in k and "block" in k for k in keys)
    assert joined.count() == 2000


def test_copies_meet_as_classes(spark):
    """Rows of one name are compared once, and who is in which class is given out beside the links."""
    people = lambda i, n: spark.range(n).selectExpr(f"id AS {i}", "'t' AS team", "concat('anna', id % 2) AS name")
    got = similar.linked_classes(people("l", 40), people("r", 60), "l", "r", *on(), 0.8).collect()
    assert sorted((r["l"], r["r"], r["score"]) for r in got if r["part"] == "pair") == [(0, 0, 1.0), (0, 1, 0.8), (1, 0, 0.8), (1, 1, 1.0)]
    assert sorted((r["r"], r["class"]) for r in got if r["part"] == "right") == [(i, i % 2) for i in range(60)]
    assert similar.clear_best(people("l", 4), people("r", 2), "l", "r", *on(), 0.85, 0.08).count() == 4
    assert similar.clear_best(people("l", 4), people("r", 3), "l", "r", *on(), 0.85, 0.08).count() == 2


def test_a_ladder_forms_no_pairs_of_hot_keys(spark):
    from pyspark.sql import functions as F

    from orderloom.operators import resolve

    l, r = spark.range(3000).selectExpr("id AS l", "0 AS k"), spark.range(2000).selectExpr("id AS r", "0 AS k")
    pairs = resolve._two_partners(l.withColumnRenamed("k", "_k"), r.withColumnRenamed("k", "_k"), "l", "r")
    assert pairs.count() <= 2 * (3000 + 2000)
    one = resolve.ladder(l.unionByName(spark.sql("SELECT 5000L AS l, 1 AS k")), r.unionByName(spark.sql("SELECT 6000L AS r, 1 AS k")), "l", "r", [("k", 1.0, F.col("k"), F.col("k"))])
    assert [(x["l"], x["r"]) for x in one.collect()] == [(5000, 6000)]


def test_a_surname_of_many_forms_no_pairs(spark):
    from orderloom.operators import resolve

    right = spark.range(500).selectExpr("id AS r", "concat('k', id) AS e", "'s' AS s", "concat(char(97 + id % 20), id) AS f").unionByName(spark.sql("SELECT 900L AS r, 'z' AS e, 's' AS s, 'zed' AS f UNION ALL SELECT 901L, 'y', 'only', 'al'"))
    left = spark.sql("SELECT * FROM VALUES (1L, 's', 'zed'), (2L, 's', 'zoe'), (3L, 's', 'ann'), (4L, 'only', 'bo'), (5L, 's', CAST(NULL AS STRING)), (6L, 's', 'b1'), (7L, NULL, 'al') AS t(l, s, f)")
    none = F.lit(None).cast("string")
    got = resolve.name_ladder(left, right, "l", "r", (none, F.col("e")), (none, F.col("e")), none, (F.col("s"), F.col("s")), (F.col("f"), F.col("f")))
    assert {r["l"]: r["r"] for r in got.collect()} == {1: 900, 2: 900, 4: 901, 6: 1}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_a_block_are_compared_once(spark):
    from orderloom.operators import resolve

    people = lambda i, n: spark.range(n).selectExpr(f"id AS {i}", "'t' AS team", "concat('anna', id) AS name").unionByName(spark.range(100, 120).selectExpr(f"id AS {i}", "'t' AS team", "'bert' AS name"))
    got = resolve.fuzzy_in_block(people("l", 3), people("r", 2), "l", "r", *on(), 0.5, 0.1)
    assert {(r["l"], r["r"]) for r in got.collect()} == {(0, 0), (1, 1)}
    assert {(r["l"], r["r"]) for r in resolve.fuzzy_in_block(people("l", 0), people("r", 2), "l", "r", *on(), 0.5, 0.0).collect()} == {(i, 100) for i in range(100, 120)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")


def test_best_names_of_tiles_are_those_of_all_pairs(spark, monkeypatch):
    """Many tiles, long names, copies and names beyond ASCII; pairs of a block are never rows."""
    from orderloom.operators import resolve

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abé😀0") for _ in range(rnd.choice([0, 1, 3, 6, 9])))
    names = [word() for _ in range(60)] + ["x" * 70 + word() for _ in range(12)] + [None]
    rows = lambda n, k: [(i, k(i), rnd.choice(names)) for i in range(n)]
    left, right = rows(90, lambda i: ["t", "u", None][i % 3]), rows(80, lambda i: ["t", "u", "v", None][i % 4])
    monkeypatch.setattr(resolve, "LEFT_NAMES", 7)
    monkeypatch.setattr(resolve, "RIGHT_NAMES", 5)
    frames = spark.createDataFrame(left, "l long, team string, name string"), spark.createDataFrame(right, "r long, team string, name string")
    for least, margin in ((0.3, 0.05), (0.0, 0.0)):
        want = set()
        for i, team, x in left:
            scored = sorted((-(1 - distance(x, y) / max(len(x), len(y), 1)), j) for j, t, y in right if t == team and None not in (t, x, y))
            if scored and -scored[0][0] >= least and -scored[0][0] - (-scored[1][0] if len(scored) > 1 else 0.0) >= margin:
                want.add((i, scored[0][1], -scored[0][0]))
        got = resolve.fuzzy_in_block(*frames, "l", "r", *on(), least, margin)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 10
        assert "levenshtein" not in got._jdf.queryExecution().optimizedPlan().toString()
