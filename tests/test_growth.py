"""Queries whose cost must grow no faster than their tables: what is read once, sent and held."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderloom.operators import windows
from orderloom.plans import catalogue

QUERIES = catalogue.queries()


@pytest.mark.parametrize("name", ["residual_scores", "layer_one_run", "wide_predictions", "bagged_scores", "period_sum_scores", "hurdle_scores"])
def test_rows_are_joined_once(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert not [f for f in df.inputFiles() if "lineitem" in f or "orders" in f]


def test_ranges_compute_a_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def told(x):
        seen.add(1)
        return x

    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 3).alias("g"), told(F.col("id") * 7 % 101).alias("v"))
    out = windows.ranked(df, ["g"], {"a": "v", "b": -F.col("v")}, counts=True, most_bytes=0, parts=16).collect()
    assert seen.value == 1000
    assert all(r["a"] + r["b"] == r["a_n"] + 1 for r in out)


def test_packed_rank_correlations_by_windows(spark):
    from orderloom.functions.nulls import corr
    from orderloom.operators.ranks import rank_correlations

    h = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(97)).cast("double")
    df = spark.range(0, 3000, 1, 5).select(F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 == 7, 2).alias("g"), "id", F.when(h(0) > 5, h(0) / 7).alias("v"), F.array(h(1), F.when(h(2) > 20, -h(2) + h(0) / 3), F.lit(None).cast("double"), F.lit(4.0), -h(0)).alias("s"))
    df = windows.ranked(df, ["g"], {"_v": "v"})
    long = windows.ranked(df.select("g", "_v", F.posexplode("s").alias("_rule", "x")), ["g", "_rule"], {"_s": "x"})
    want = {(r["g"], r["_rule"]): r["rho"] for r in long.groupBy("g", "_rule").agg(corr("_s", "_v").alias("rho")).collect()}
    for rows in (1 << 20, 100):
        got = {(r["g"], r["_rule"]): r["rho"] for r in rank_correlations(df, "g", "_v", "s", 5, part_rows=rows).collect()}
        assert got.keys() == want.keys() and len(want) == 15
        assert all(got[c] == want[c] or abs(got[c] - want[c]) < 1e-9 for c in want)


def test_a_sweep_makes_no_row_of_a_score(spark):
    from orderloom.operators import rules

    df = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"), (F.col("id") * 7 % 11).alias("v"))
    out = rules.sweep(df, {"x": "rank(a)", "y": "median(a,b)", "z": "blend(rank(a),b)"}, "g", "v")
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert out.count() == 3


def test_audited_sources_are_not_sent_whole(spark, sf_dir):
    assert "BroadcastHashJoin [p_partkey" not in QUERIES["collision_audit"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def _ring(spark):
    return spark.range(400).select((F.col("id") % 40).alias("a"), ((F.col("id") * 7 + F.col("id") % 3 + 1) % 40).alias("b"), (F.col("id") % 13 - 6.0).alias("m"), (F.col("id") % 4 == 0).alias("n")).filter("a <> b")


@pytest.mark.parametrize("name", ["ridge_ratings", "iterated_ratings"])
def test_ratings_send_no_pairs_in_a_round(spark, monkeypatch, name):
    """Pairs are packed once, in several blocks; what a round joins to them leaves them where they lie."""
    from orderloom.operators import stats

    plans, many = [], stats._of_opponents

    def watched(blocks, x):
        out = many(blocks, x)
        plans.append((blocks[1], out._jdf.queryExecution().executedPlan().toString()))
        return out

    args = ("a", "b", "m", "n") if name == "ridge_ratings" else ("a", "b", "m")
    want = {r[0]: r["r"] for r in getattr(stats, name)(_ring(spark), *args, rounds=3).collect()}
    monkeypatch.setattr(stats, "BLOCK_PAIRS", 50)
    monkeypatch.setattr(stats, "_of_opponents", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r[0]: r["r"] for r in getattr(stats, name)(_ring(spark), *args, rounds=3).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-8 for t in want)
    lines = [(k, p.splitlines()) for k, p in plans]
    at = [(k, p, i) for k, p in lines for i, x in enumerate(p) if "Scan ExistingRDD[j#" in x]
    assert len(at) == len(plans) > 0 and all(k > 1 and not any("Exchange" in x for x in p[i - 3 : i]) for k, p, i in at)


def test_games_are_sent_once(spark, sf_dir):
    """Box lines of a game meet by the game alone: lines are sent for the rows and (the same way) for the seasons' levels, teams and sides beside."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["player_game"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "opp_team_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert "team_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_a_screen_splits_cohorts_and_values(spark, monkeypatch):
    """Ranks of a screen are those of windows, and no window runs over a cohort or over all rows of a value."""
    from orderloom.functions.nulls import corr
    from orderloom.operators import stats

    h = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double")
    df = spark.range(0, 1500, 1, 2).select(
        F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").when(F.col("id") % 50 == 9, "c").alias("g"), F.when(h(0, 9) > 0, h(1, 700)).alias("t"), F.when(h(2, 3) > 0, h(3, 5)).alias("u"), (h(1, 700) + h(4, 900)).alias("v"), F.lit(1.0).alias("w")
    )
    want = {}
    for c in "uvw":
        rows = windows.ranked(df.filter(F.col(c).isNotNull() & F.col("t").isNotNull()), ["g"], {"x": c, "y": "t"}).groupBy("g").agg(F.count("*").alias("n"), corr("x", "y").alias("rho")).filter("rho is not null")
        n, s = rows.agg(F.sum("n"), F.sum(F.col("n") * F.col("rho"))).first()
        if n:
            want[c] = (n, s / n)
    seen, dealt = [], windows.with_below

    def watched(counts, *args):
        out = dealt(counts, *args)
        at = out._jdf.queryExecution().optimizedPlan().toString()
        seen.append([x for x in at.splitlines() if "Window [" in x and "__p" not in x])
        return out

    for most, each in ((windows.MOST_SENT, windows.RANGE_ROWS), (0, 100)):
        monkeypatch.setattr(windows, "MOST_SENT", most)
        monkeypatch.setattr(windows, "RANGE_ROWS", each)
        monkeypatch.setattr(stats, "with_below", watched)
        monkeypatch.setattr(stats, "SCREEN_RANGES", 7)
        got = {r["column"]: (r["n"], r["rho"]) for r in stats.screen(df, ["u", "v", "w"], "t", "g").collect()}
        assert got.keys() == want.keys() == {"u", "v"}
        assert all(got[c][0] == want[c][0] and abs(got[c][1] - want[c][1]) < 1e-9 for c in want)
    assert len(seen) == 4 and not any(seen)


def test_next_rows_of_a_random_order_by_ranges(spark):
    """Next rows are those of a window over the cohort, whether ranges hold many rows, few or none, and no window runs over a cohort's rows."""
    from pyspark.sql import Window

    from orderloom.operators import sampling

    df = spark.range(0, 700, 1, 3).select(F.when(F.col("id") % 10 < 8, "a").when(F.col("id") % 100 == 9, "b").when(F.col("id") == 19, "c").alias("g"), "id", (F.col("id") * 37 % 101).cast("double").alias("x"))
    row, order = F.struct("id", "x"), Window.partitionBy("g").orderBy(sampling.draw("id", seed=3), "id")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for many in (1, 8):
        want = {r["id"]: r["n"] for r in df.select("id", F.collect_list(row).over(order.rowsBetween(1, many)).alias("n")).collect()}
        for p in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            try:
                out = sampling.with_next(df, ["g"], "id", row, many, 3)
                assert {r["id"]: r["_next"] for r in out.collect()} == want
                plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
                assert len([x for x in plan if "Window [lead(" in x and "_p#" not in x]) == 0 < len([x for x in plan if "Window [lead(" in x])
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.mark.parametrize("name", ["smote_rows", "mixup_rows"])
def test_synthetic_rows_hold_no_cohort(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    windows_ = [x for x in plan.splitlines() if "Window [" in x and "lag(" not in x]  # the other one sees a range's first rows
    assert windows_ and all("_p#" in x for x in windows_)


def test_ranges_of_several_columns_send_whole_rows_once(spark):
    df = spark.range(0, 2000, 1, 4).select((F.col("id") % 3).alias("g"), *(F.when(F.col("id") % 7 != i, F.col("id") * (3 + i) % 101).alias(f"v{i}") for i in range(4)), F.repeat(F.lit("x"), 50).alias("burden"))
    columns = {f"r{i}": f"v{i}" for i in range(4)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranges = windows.ranked(df, ["g"], columns, counts=True, most_bytes=0, parts=16)
        plan = ranges._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum("Exchange hashpartitioning" in a and "burden" in b for a, b in zip(plan, plan[1:])) <= 1
    whole = windows.ranked(df, ["g"], columns, counts=True, most_bytes=1 << 62)
    assert sorted(ranges.columns) == sorted(whole.columns)
    told = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
    assert told(ranges) == told(whole)


@pytest.mark.parametrize(("scores", "digits", "most"), [("shares", 9, 6.5), ("places", 9, 7.5), ("shares", None, 13), ("huge", 9, 13), ("none", 9, 100)])
def test_packed_scores_come_back(scores, digits, most):
    import numpy as np

    from orderloom.operators import ranks

    rng = np.random.default_rng(3)
    s = {"shares": rng.random(5000), "places": -rng.integers(1, 10**6, 5000) / 2.0, "huge": rng.normal(size=5000) * 1e30, "none": np.empty(0)}[scores]
    s = np.sort(s if digits is None else np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits, s))
    places = rng.integers(0, 1 << 23, len(s)).astype(np.uint32)
    sent = ranks._sent(s, places, digits)
    back = ranks._received(sent, digits)
    assert (back[0] == s).all() and (back[1] == places).all()
    assert len(sent) < most * max(1, len(s))
