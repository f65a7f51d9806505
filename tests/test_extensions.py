"""Operators that no SQL checks: against plain versions, pinned numbers, failures that must show, and plans."""

from __future__ import annotations

import difflib
import itertools
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderloom.functions import keys, lists, numbers
from orderloom.operators import dedup, guards, labels, models, resolve, rules, sampling, specs, stats, windows
from orderloom.operators.lineage import landing
from orderloom.sources import html, sinks


def ranks(x):
    return pd.Series(x).rank()


# -- ranks and rules -----------------------------------------------------------------------


def hot(spark, n=6000):
    rng = random.Random(5)
    rows = [("hot" if i % 20 else f"c{i % 3}", rng.choice([None, float(rng.randint(0, 900))]) if i % 3 else float(i), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v double, i long").repartition(8)


def test_ranks_in_ranges_are_those_of_windows(spark):
    df = hot(spark)
    a = windows.ranked(df, ["g"], {"r": "v", "q": -F.col("v")}, counts=True, most_bytes=0, parts=16)
    b = windows.ranked(df, ["g"], {"r": "v", "q": -F.col("v")}, counts=True, most_bytes=1 << 62)
    key = lambda d: sorted((r["i"], r["r"], r["q"], r["r"] and r["r_n"]) for r in d.collect())
    assert key(a) == key(b)


@pytest.mark.parametrize("kind", ["long", "decimal(38,2)", "string", "timestamp", "binary", "boolean"])
def test_ranks_in_ranges_keep_the_type(spark, kind):
    rng = random.Random(6)
    big = 1 << 53
    rows = [("hot" if i % 4 else None, rng.choice([None, big, big + 1, big + 2, big + 3, rng.randint(0, 10**6), -5]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, n long, i long").repartition(6)
    text = F.concat(F.when(F.col("n") % 2 == 0, "é").otherwise("z"), F.col("n").cast("string"))
    made = {"string": text, "binary": text.cast("binary"), "timestamp": F.timestamp_micros(F.col("n")), "boolean": F.col("n") % 2 == 0}.get(kind, F.col("n").cast(kind))
    df = df.withColumn("v", made)
    a, b = (windows.ranked(df, ["g"], {"r": "v"}, counts=True, most_bytes=m, parts=16) for m in (0, 1 << 62))
    key = lambda d: sorted((r["i"], r["r"], r["r_n"]) for r in d.collect())
    assert a.schema["v"].dataType == b.schema["v"].dataType and key(a) == key(b)


def test_zscores_and_bins_are_those_of_windows(spark):
    df = hot(spark).withColumn("g", F.nullif("g", F.lit("c1")))
    a = windows.with_bins(windows.with_zscores(df, ["g"], {"z": "v", "s": -F.col("v")}, guard=True), ["g"], "v", 5, "b", most_bytes=0)
    b = df.withColumns({"z": windows.zscore("v", ["g"], True), "s": windows.zscore(-F.col("v"), ["g"], True), "b": windows.bins("v", ["g"], 5)})
    got, want = ({r["i"]: (r["z"], r["s"], r["b"]) for r in x.collect()} for x in (a, b))
    assert got.keys() == want.keys()
    for i, (z, s, k) in want.items():
        assert got[i][2] == k and (z is None) == (got[i][0] is None) and (z is None or abs(got[i][0] - z) + abs(got[i][1] - s) < 1e-9)


def test_a_hot_cohort_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        df = windows.ranked(hot(spark), ["g"], {"r": "v"}, most_bytes=0, parts=64)
        sizes = [r["n"] for r in df.filter("g = 'hot' and v is not null").withColumn("at", F.spark_partition_id()).filter("r > 0").groupBy("at").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 12 and max(sizes) < 0.35 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exhaustive_sweep_by_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = []
    for year in range(2010, 2016):
        y = rng.standard_normal(40)
        for i in range(40):
            rows.append((year, i, float(y[i]), float(y[i] + rng.standard_normal()), float(y[i] + 2 * rng.standard_normal()), float(rng.standard_normal()), float(i % 7) if i % 4 else None, float(i % 50 + 1) if i % 3 else None))
    df = pd.DataFrame(rows, columns=["year", "i", "y", "a", "b", "c", "age", "board"])
    table = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in df.itertuples(index=False)], "year long, i long, y double, a double, b double, c double, age double, board double")
    got = {j.rule: j for j in rules.exhaustive(table, ["a", "b", "c"], "year", "y", rules.Covers(age="age", board="board", tilts=("age",)))}

    pct = lambda s: df.assign(_s=s.round(9)).groupby("year")["_s"].rank(pct=True)
    rho = lambda s: {year: ranks(g["_s"].round(9)).corr(ranks(g["y"])) for year, g in df.assign(_s=s).groupby("year")}
    score = {f"one {c}": pct(df[c]) for c in "abc"}
    order = sorted("abc", key=lambda c: -np.mean(list(rho(df[c]).values())))
    score |= {"blend all": sum(pct(df[c]) for c in "abc") / 3, "median all": pd.concat([pct(df[c]) for c in "abc"], axis=1).median(axis=1)}
    score |= {f"blend {p} {q}": (pct(df[p]) + pct(df[q])) / 2 for p, q in itertools.combinations("abc", 2)}
    score |= {"blend best 3": sum(pct(df[c]) for c in order) / 3}
    base = rho(df[order[0]])
    for name, s in score.items():
        assert got[name].mean_rho == pytest.approx(np.mean(list(rho(s).values())), abs=1e-9), name
    named = sorted((n for n in got if " on " not in n and n != "board alone"), key=lambda n: (-got[n].mean_rho, n))[:3]
    assert {n.split(" on ", 1)[1] for n in got if " on " in n} == set(named)
    for n in named:
        if n not in score:
            continue
        young = -df["age"].fillna(df["age"].median())
        filled = df["age"].fillna(df.groupby("year")["age"].transform("median"))
        board = -df["board"].fillna(61)
        own = pct(score[n])
        want = {f"youth 0.2 on {n}": 0.8 * own + 0.2 * pct(young), f"tilt age -0.15 on {n}": 0.85 * own - 0.15 * pct(filled), f"consensus 0.4 on {n}": 0.6 * own + 0.4 * pct(board)}
        for rule, s in want.items():
            each = rho(s)
            assert got[rule].mean_rho == pytest.approx(np.mean(list(each.values())), abs=1e-9), rule
            gains = [each[c] - base[c] for c in sorted(base)]
            assert got[rule].gain == pytest.approx(np.mean(gains), abs=1e-9) and got[rule].wins == sum(g > 0 for g in gains)
            assert got[rule].robust == (np.mean(gains) >= 0.01 and sum(g > 0 for g in gains) >= 5 and min(gains[-2:]) > 0)
    assert got[f"one {order[0]}"].robust


def test_a_parzen_search_beats_a_random_one():
    names, better = [f"c{i}" for i in range(6)], 0
    for seed in range(8):
        rng = random.Random(seed)
        aim = [rng.random() ** 3 for _ in names]
        aim = [a / sum(aim) for a in aim]
        value = lambda w: -sum((w[n] - a) ** 2 for n, a in zip(names, aim, strict=True))  # noqa: E731, B023
        asked = []
        fitness = lambda some: [asked.append(len(some)) or value(w) for w in some]  # noqa: E731, B023
        weights, got = specs.parzen_weights(fitness, names, 120, seed=seed)
        assert sum(weights.values()) == pytest.approx(1, abs=1e-5) and got == value(weights)
        assert len(asked) == 120 and set(asked) <= {16, 8}
        plain = max(value({n: x / sum(r) for n, x in zip(names, r, strict=True)}) for r in ([rng.random() for _ in names] for _ in range(120)))
        better += got > plain
    assert better >= 7
    assert specs.parzen_weights(fitness, names, 40, seed=3) == specs.parzen_weights(fitness, names, 40, seed=3)


def test_parzen_densities_are_densities():
    for points in ([], [0.5], [0.0, 1.0], [0.2, 0.21, 0.9]):
        bumps = specs._parzen(points)
        x = (np.arange(4000) + 0.5) / 4000
        assert np.mean([np.exp(specs._density(bumps, v)) for v in x]) == pytest.approx(1, abs=1e-3)


def test_a_tuned_blend_enters_the_sweep(spark):
    rng = np.random.default_rng(5)
    rows = [(year, i, float(y), float(y + 2 * rng.standard_normal()), float(y + 2 * rng.standard_normal()), float(rng.standard_normal())) for year in range(2010, 2015) for i in range(30) for y in [rng.standard_normal()]]
    df = spark.createDataFrame(rows, "year long, i long, y double, a double, b double, c double")
    got = {j.rule: j for j in rules.exhaustive(df, ["a", "b", "c"], "year", "y", trials=32)}
    weights = {p.split(":")[0]: float(p.split(":")[1]) for p in got["tuned"].text[6:-1].split(",")}
    assert weights.get("c", 0.0) < min(weights["a"], weights["b"]) and got["tuned"].mean_rho > max(got[f"one {x}"].mean_rho for x in "abc") - 0.02
    assert rules.tuned_blend(df.filter("year < 2013"), ["a", "b"], "year", "y", 8) is None


def test_prefixes_meet_only_where_they_match(spark):
    rng = random.Random(8)
    make = lambda n: [("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))),) for _ in range(n)]
    a, b = make(150) + [(None,)], make(150) + [(None,)]
    l, r = spark.createDataFrame(a, "x string"), spark.createDataFrame(b, "y string")  # noqa: E741
    want = {(x, y) for (x,) in a for (y,) in b if x is not None and y is not None and (len(y) >= 5 and x.startswith(y) or len(x) >= 5 and y.startswith(x) or len(x) >= 9 and len(y) >= 9 and x[:9] == y[:9])}
    got = resolve.by_prefix(l, r, "x", "y").collect()
    assert len(got) == len(want) > 50 and {tuple(p) for p in got} == want


def test_groups_in_parts_whatever_the_size_of_a_part(spark):
    import pyarrow as pa

    df = hot(spark, 3000).withColumn("g", F.nullif("g", F.lit("c1"))).filter("v is not null")
    sums = lambda t: pa.table({"g": t["g"].slice(0, 1), "n": pa.array([t.num_rows], pa.int64()), "s": [sum(t["v"].to_pylist())]})
    merge = lambda t: pa.table({"g": t["g"].slice(0, 1), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "s": [sum(t["s"].to_pylist())], "parts": pa.array([t.num_rows], pa.int64())})
    got = {m: {r["g"]: (r["n"], r["s"], r["parts"]) for r in stats.by_group_in_parts(df, ["g"], sums, "g string, n long, s double", merge, "g string, n long, s double, parts long", part_rows=m).collect()} for m in (100, 10**9)}
    want = {r["g"]: (r["n"], r["s"]) for r in df.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    assert all({k: v[:2] for k, v in x.items()} == want for x in got.values())
    assert got[100]["hot"][2] >= 15 and {v[2] for v in got[10**9].values()} == {1}


def test_rule_texts():
    assert rules.parse("tilt(blend(a:1,b:2),age,-0.1)").depth == 2 and rules.parse("a").depth == 0
    for bad in ("blend(a", "blend(a,)", "1", "a b", ""):
        with pytest.raises(ValueError):
            rules.parse(bad)


# -- numbers, names, texts -----------------------------------------------------------------


def test_slot_means_are_the_published_ones():
    assert numbers.slot_means(np.array([3.5, 10.5]), np.array([0.5, 0.3])) == pytest.approx([3.57, 12.12], abs=0.006)
    some = numbers.slot_means(np.array([1.5, 1.5, 59.5, 20.5]), np.array([0.999, np.nan, 0.001, 0.5]))
    assert np.isfinite(some).all() and (some >= 1).all() and (some <= 60).all() and some[0] < some[1]


def test_horizon_policies():
    want = {"full": [5] * 5, "match": [1, 2, 3, 4, 5], "match3": [3, 3, 3, 4, 5], "short3": [3, 3, 5, 5, 5], "4": [4] * 5, "multi": ["multi"] * 5, None: [5] * 5}
    for policy, out in want.items():
        assert [labels.horizon(policy, k) for k in range(1, 6)] == out
    assert labels.horizon("match", 0) == 1 and labels.horizon("match", 9) == 5
    with pytest.raises(ValueError):
        labels.horizon("other", 3)


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("a", None), ("martin", "marten"), ("abcd", "bcde"), ("xy", "yx")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", resolve.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r["r"] == (None if r["b"] is None else pytest.approx(difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()))


def test_text_positions_and_running_totals(spark):
    text = "the x the the " * 3000 + "the"
    at = spark.createDataFrame([(text,), ("",), ("nothe",), (None,)], "t string").select("t", keys.positions("t", "the ").alias("at")).collect()
    want = [i for i in range(len(text)) if text.startswith("the ", i)]
    assert at[0]["at"] == want and at[1]["at"] == [] and at[2]["at"] == [] and at[3]["at"] is None
    rng = random.Random(1)
    a = [rng.randint(0, 9) for _ in range(9000)]
    got = spark.createDataFrame([(a,), ([5],)], "a array<int>").select(lists.running_totals(F.col("a")).alias("s")).collect()
    assert got[0]["s"] == list(itertools.accumulate(a)) and got[1]["s"] == [5]


def test_page_layouts(spark):
    pages = [("table", '<tr><td> 3 </td><td>A &amp; B</td><td>PG</td></tr><tr class="y"><td>4.</td><td><a href="z">C D</a></td><td>C</td></tr>'), ("line", "1. A B, Duke\nno entry\n2) C D, Iowa\n"), ("unknown", "<li>1. A, B</li>"), ("list", None)]
    df = spark.createDataFrame(pages, "layout string, html string").select("layout", html.entries(F.col("html"), F.col("layout"), html.BOARDS, ("place", "name", "position")).alias("e"))
    got = {r["layout"]: [tuple(x) for x in r["e"]] if r["e"] is not None else None for r in df.collect()}
    assert got["table"] == [("3", "A & B", "PG"), ("4", "C D", "C")] and got["line"] == [("1", "A B", "Duke"), ("2", "C D", "Iowa")] and got["unknown"] == [] and not got["list"]


# -- joins, guards, specs ------------------------------------------------------------------


def test_checked_join_fails_on_repeats(spark):
    one, many = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), spark.createDataFrame([(1, 5), (1, 6)], "k long, y long")
    assert dedup.checked_join(many, one, ["k"], "left", "m:1").count() == 2
    for left, right, how in ((one, many, "m:1"), (many, one, "1:m"), (many, one, "1:1")):
        with pytest.raises(Exception, match="repeats a key"):
            dedup.checked_join(left, right, ["k"], "left", how).collect()


def test_blind_scoring_gives_no_rows_and_needs_matches(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i), i) for i in range(30)], "id long, a double, y_value double, place long")
    inputs, stripped = guards.blind(rows, "id", ["a", "gone"])
    assert inputs.columns == ["id", "a"] and stripped == ["y_value"]
    got = guards.blind_score(inputs.withColumn("s", F.col("a")), rows, "id", "s", "y_value", "place").collect()
    assert len(got) == 1 and got[0]["n"] == 30 and got[0]["baseline_ic"] == pytest.approx(-1)
    with pytest.raises(Exception, match="too few"):
        guards.blind_score(inputs.filter("id < 5").withColumn("s", F.col("a")), rows, "id", "s", "y_value", "place").collect()
    with pytest.raises(guards.GuardError):
        guards.blind(rows, "id", ["y_value"])


def test_no_source_names_what_it_must_not(tmp_path):
    (tmp_path / "a.py").write_text("read('data/answers')")
    (tmp_path / "vault.py").write_text("read('data/answers')")
    assert guards.tripwire(str(tmp_path), ("data/answers",), ("vault.py",)) == [("a.py", "data/answers")]
    assert guards.tripwire(str(Path(guards.__file__).parents[1] / "plans"), ("localCheckpoint", "sample(")) == []


def test_feature_descriptions():
    groups = {"all": ["a", "b", "c"], "box": ["a", "b"], "bio": ["d", "a"]}
    assert specs.resolve(None, groups, ["c", "a", "x"]) == ["a", "c"]
    assert specs.resolve(["bio", "box", "-box", "e", "bio"], groups, ["a", "b", "d", "e"]) == ["d", "e", "a"]
    with pytest.raises(KeyError):
        specs.resolve(["-none"], groups, ["a"])
    c = specs.Config.read({"name": "n", "ctx_start": 2010, "ctx_last": 3, "ctx_min_periods": 2, "label_horizon": "match", "stack": [{"model": "gbt", "weight": 2.0}]})
    assert c.context(range(2005, 2020), 2016) == [2013, 2014] and c.horizon(2020, 2022) == 2 and c.stack[0].weight == 2.0
    with pytest.raises(KeyError):
        specs.Config.read({"name": "n", "modle": "x"})
    assert specs.signature(c) == specs.signature(specs.Config.read({"stack": [{"weight": 2.0, "model": "gbt"}], "label_horizon": "match", "ctx_min_periods": 2, "ctx_last": 3, "ctx_start": 2010, "name": "n"}))
    masks = specs.balanced_masks(list("abcdefgh"), 24, seed=1)
    counts = [sum(g in m for m in masks) for g in "abcdefgh"]
    assert max(counts) - min(counts) <= 1 and masks == specs.balanced_masks(list("abcdefgh"), 24, seed=1)


def test_genomes_evolve_and_weights_are_found():
    assert len(specs.GENES) == 31
    with pytest.raises(ValueError):
        specs.Genome().changed(hw="none")
    judged = []
    fitness = lambda g: judged.append(g) or float(g["M"] + (g["hw"] == "top2") * 100)
    rng = random.Random(0)
    found = specs.evolve(fitness, [specs.Genome().mutated(rng, 0.5) for _ in range(12)], 6, 4, seed=2)
    assert len(judged) == len(set(judged)) and found[0][0] == 500.0 and found == sorted(found, key=lambda x: -x[0])
    weights, value = specs.search_weights(lambda ws: [-abs(w["a"] - 0.6) - w["c"] for w in ws], ["a", "b", "c"], 200, seed=1)
    assert weights["a"] == pytest.approx(0.6, abs=0.1) and weights["c"] < 0.1 and value > -0.15


def test_group_fits_by_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(g, *rng.standard_normal(3).tolist(), float(rng.uniform(0.5, 2))) for g in range(4) for _ in range([3, 4, 30, 200][g])]
    rows += [(9, 1.0, 2.0, 4.0, 1.0)] * 8  # nothing varies
    got = {r["g"]: r for r in stats.wls_fit(spark.createDataFrame(rows, "g long, y double, a double, b double, w double"), ["g"], "y", ["a", "b"], "w").collect()}
    for g in (1, 2, 3):
        own = np.array([r[1:] for r in rows if r[0] == g])
        y, x, w = own[:, 0], np.column_stack((np.ones(len(own)), own[:, 1:3])), own[:, 3] / own[:, 3].mean()
        inverse = np.linalg.inv(x.T @ (x * w[:, None]))
        beta = inverse @ (x.T @ (w * y))
        s2 = (w * (y - x @ beta) ** 2).sum() / (len(y) - 3)
        assert got[g]["coefficients"] == pytest.approx(beta, abs=1e-8) and got[g]["errors"] == pytest.approx(np.sqrt(np.diag(inverse) * s2), abs=1e-8)
    assert got[0]["coefficients"] is None and got[9]["coefficients"] is None


def test_ridge_ratings_by_numpy(spark):
    rng = random.Random(2)
    games = [(rng.randrange(12), rng.randrange(12), float(rng.randint(-20, 25)), rng.random() < 0.2) for _ in range(300)]
    games = [g for g in games if g[0] != g[1]] + [(0, 50, 3.0, None)] * 3
    got = {r["team"]: r["r"] for r in stats.ridge_ratings(spark.createDataFrame(games, "h long, a long, m double, n boolean"), "h", "a", "m", "n").collect()}
    teams = sorted({g[0] for g in games} | {g[1] for g in games})
    x = np.zeros((len(games), len(teams) + 1))
    for i, (h, a, _, n) in enumerate(games):
        x[i, teams.index(h)], x[i, teams.index(a)], x[i, -1] = 1, -1, 0.0 if n else 1.0
    beta = np.linalg.solve(x.T @ x + np.eye(len(teams) + 1), x.T @ np.array([g[2] for g in games]))
    keep = [t for t in teams if sum(t in g[:2] for g in games) >= 10]
    r = {t: beta[teams.index(t)] for t in keep}
    middle = np.mean(list(r.values()))
    assert set(got) == set(keep) and all(got[t] == pytest.approx(r[t] - middle, abs=1e-6) for t in keep)


def test_text_model_sees_only_earlier_texts(spark):
    rng = random.Random(4)
    word = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(i, i % 3, f"{word(12)} {'splendid' if i % 2 else 'dreadful'} {word(5)}", float(i % 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "i long, c long, t string, y double")
    got = models.causal_text_scores(df, "t", "y", "c", [0, 1, 2], penalty=0.1).select("i", "c", "y", "score").toPandas()
    assert set(got["c"]) == {1, 2} and got.groupby("c").apply(lambda g: g["score"].corr(g["y"]), include_groups=False).min() > 0.9
    spoiled = df.withColumn("t", F.when(F.col("c") == 2, F.concat("t", F.lit(" later"))).otherwise(F.col("t"))).withColumn("y", F.when(F.col("c") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    again = models.causal_text_scores(spoiled, "t", "y", "c", [1], penalty=0.1).select("i", "score").toPandas().sort_values("i")
    assert np.allclose(again["score"], got[got["c"] == 1].sort_values("i")["score"])


def test_draws(spark):
    x = spark.range(4000).select(sampling.draw("id").alias("u"), sampling.normal("id").alias("z"), sampling._share("id", 3).alias("s")).toPandas()
    assert abs(x["u"].mean() - 0.5) < 0.02 and abs(x["z"].std() - 1) < 0.05 and abs(x["s"].var() - 0.05) < 0.006 and x["u"].nunique() == 4000


# -- sinks ---------------------------------------------------------------------------------


def test_documents_are_for_reports(spark):
    with pytest.raises(ValueError, match="at most"):
        sinks.document(spark.range(50), landing(spark, "d"), most_rows=49)


def test_versions(spark):
    path = landing(spark, "v")
    for i in range(4):
        assert sinks.snapshot(spark.range(i + 1), path) == i + 1
    sinks.restore(spark, path, 2)
    assert sinks.current(spark, path).count() == 2
    assert sinks.prune(spark, path, 1) == [1, 3] and sinks.versions(spark, path) == [2, 4]
    with pytest.raises(ValueError):
        sinks.restore(spark, path, 3)


def test_database_round_trip(spark):
    from orderloom.sources import readers

    url = "jdbc:derby:memory:orderloom;create=true"
    df = spark.createDataFrame([(i, float(i), f"n{i}") for i in range(1200)], "id long, v double, name string")
    try:
        sinks.execute(spark, url, ["create table facts (id bigint not null primary key, v double, name varchar(40))"])
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no database driver: {e}")
    sinks.jdbc(df, url, "facts")
    sinks.jdbc_replace(df.filter("id < 10").withColumn("v", F.lit(-1.0)), url, "facts", "id < 100")
    back = readers.jdbc(spark, url, "facts", "id", 0, 1200, 4)
    assert back.count() == 1110 and back.filter("v = -1").count() == 10
    made = sinks.ddl(df, "facts", ["id"], (("name",), ("name", "v")), readers="anon")
    assert made[0] == 'create table if not exists "facts" ("id" bigint not null, "v" double precision, "name" text, primary key ("id"))'
    assert made[1:3] == ['create index if not exists "facts_name" on "facts" ("name")', 'create index if not exists "facts_name_v" on "facts" ("name", "v")'] and "row level security" in made[3] and made[4].endswith("to anon using (true)")


def test_fetching_is_idempotent(spark, tmp_path):
    import http.server
    import threading
    from collections import Counter

    from orderloom.sources.fetch import fetch

    asked = Counter()

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked[self.path] += 1
            status = {"/none": 404, "/broken": 500}.get(self.path, 503 if self.path == "/late" and asked["/late"] < 2 else 200)
            self.send_response(status)
            self.end_headers()
            if status == 200:
                self.wfile.write(b"page " + self.path.encode())

        def log_message(self, *args):
            return

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{base}{p}",) for p in ("/a", "/b", "/a", "/none", "/broken", "/late")] + [(None,)], "u string")
    try:
        first, second = ({r["url"].removeprefix(base): r["state"] for r in fetch(urls, "u", str(tmp_path / "pages"), pause=0.01).collect()} for _ in range(2))
    finally:
        server.shutdown()
    assert first == {"/a": "fetched", "/b": "fetched", "/none": "missing", "/broken": "failed", "/late": "fetched"}
    assert second == {"/a": "cached", "/b": "cached", "/none": "missing", "/broken": "failed", "/late": "cached"}
    assert asked == {"/a": 1, "/b": 1, "/none": 1, "/broken": 6, "/late": 2}
    assert sorted(p.read_bytes() for p in (tmp_path / "pages").glob("*.page")) == [b"page /a", b"page /b", b"page /late"]
