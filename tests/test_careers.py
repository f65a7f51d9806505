"""Careers against plain loops; missing values, ties, repeated rows, empty tables and further columns."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.functions import lists
from orderloom.operators import careers, context, facts, specs, stats
from orderloom.sources import sinks


def _near(a, b):
    return a is None and b is None or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_development_is_that_of_plain_loops(spark):
    r = random.Random(3)
    persons = [(w, 2010 + w % 4) for w in range(40)]
    seasons = [(w, y, r.choice([None, 0.0, -1.0, *map(float, range(1, 30))]), None if r.random() < 0.2 else r.gauss(0, 3), "x") for w in range(45) for y in range(2005, 2015) if r.random() < 0.5]
    s = spark.createDataFrame(seasons, "who long, year int, w double, m double, n string")  # n clashes with a result's name
    p = spark.createDataFrame(persons, "who long, cutoff int")
    got = {x["who"]: x for x in careers.development(s, p, "who", "year", "cutoff", ["m"], "w").collect()}
    slopes, want = {}, {}
    for who, cutoff in persons:
        own = sorted((y, max(w or 0.0, 0.0), m) for q, y, w, m, _ in seasons if q == who and y <= cutoff)
        if not own:
            continue
        used = [(y, w, m) for y, w, m in own if w > 0 and m is not None]
        slope = None
        if len(used) >= 2:
            y, w, m = map(np.array, zip(*used, strict=True))
            ym, mm = np.average(y, weights=w), np.average(m, weights=w)
            slope = (w * (y - ym) * (m - mm)).sum() / (w * (y - ym) ** 2).sum()
        ms = [m for *_, m in own]
        gain = ms[-1] - ms[0] if len(ms) >= 2 and None not in (ms[0], ms[-1]) else None
        bend = ms[-1] - 2 * ms[-2] + ms[-3] if len(ms) >= 3 and None not in ms[-3:] else None
        slopes[who], want[who] = (cutoff, slope), (len(own), slope, ms[0], gain, bend)
    assert set(got) == set(want)
    for who, (n, slope, first, gain, bend) in want.items():
        g, cutoff = got[who], slopes[who][0]
        old = [s for c, s in slopes.values() if c < cutoff and s is not None]
        population = sum(old) / len(old) if old else None
        assert g["n"] == n and all(_near(g[f"m_{k}"], v) for k, v in (("slope", slope), ("first", first), ("gain", gain), ("bend", bend), ("population", population)))
        assert _near(g["m_shrunk"], None if slope is None or population is None else n / (n + 2) * slope + 2 / (n + 2) * population)


def test_latent_shares_take_the_role_or_all(spark):
    r = random.Random(5)
    seasons = []
    for w in range(90):
        role = None if w % 10 == 0 else "rare" if w % 10 == 1 else "common"
        p = r.betavariate(6, 4)
        for y in range(2000, 2004):
            n = r.choice([0, 5, 20, 40, 200])
            seasons.append((w, y, role, sum(r.random() < p for _ in range(n)), n))
    persons = [(w, 2002 + w % 4 if w else 1999, None if w % 10 == 0 else "rare" if w % 10 == 1 else "common") for w in range(90)] + [(900, 2003, "common")]
    s, p = spark.createDataFrame(seasons, "who long, year int, role string, made long, tried long"), spark.createDataFrame(persons, "who long, cutoff int, role string")
    got = {x["who"]: x for x in careers.latent_shares(s, p, "who", "year", "cutoff", "role", "made", "tried").collect()}

    def prior(cutoff, role):
        q = [(m / n, n) for _, y, k, m, n in seasons if y < cutoff and n >= 20 and (role is all or k == role)]
        if len(q) < 30:
            return None
        ps = np.array([x for x, _ in q])
        mean = ps.mean()
        left = ps.var(ddof=1) - np.mean([mean * (1 - mean) / n for _, n in q])
        return mean, min(500.0, max(2.0, mean * (1 - mean) / left - 1)) if left > 0 else 500.0

    assert 900 not in got and 0 not in got  # no season, none by the cutoff
    for who, cutoff, role in persons:
        if who not in got:
            continue
        g, own = got[who], prior(cutoff, role) if role else None
        mean, worth = own or prior(cutoff, all) or (None, None)
        made, tried = (sum(x[i] for x in seasons if x[0] == who and x[1] <= cutoff) for i in (3, 4))
        assert (g["made"], g["tried"], g["from_role"]) == (made, tried, own is not None)
        assert _near(g["mean"], mean) and _near(g["worth"], worth) and _near(g["share"], None if mean is None or not tried else (made + mean * worth) / (tried + worth))
    assert {g["from_role"] for g in got.values()} == {True, False}


def test_last_lines_sum_moves_and_break_ties(spark):
    rows = [(1, 5, "a", 1, 2, 30.0, 9), (1, 5, "a", 1, 1, 30.0, 6), (1, 5, "b", 2, 4, 60.0, 5), (1, 5, "c", 2, 1, 20.0, 1), (1, 7, "a", 1, 9, 99.0, 9), (1, 4, "z", 9, 9, 999.0, 9), (2, 2, "a", 1, 1, 10.0, 1), (3, 5, "d", None, None, None, None), (None, 5, "a", 1, 1, 1.0, 1)]
    s = spark.createDataFrame(rows, "who long, season int, league string, level int, g int, mp double, pts int")
    p = spark.createDataFrame([(1, 6), (2, 6), (3, 5), (4, 5)], "who long, cutoff int")
    got = {x["who"]: x for x in careers.last_lines(s, p, "who", "season", "cutoff", "league", "level", "g", "mp", {"pts": "pts"}).collect()}
    assert set(got) == {1, 3}  # 2 is too long ago, 4 has no line
    a = got[1]
    assert (a["season"], a["gap"], a["leagues"], a["main"], a["top"], a["games"]) == (5, 1, 3, "b", "b", 8)  # equal minutes: the higher level
    assert _near(a["per_game"], 140 / 8) and _near(a["main_pts"], 36 * 5 / 60) and _near(a["all_pts"], 36 * 21 / 140)
    assert got[3]["main"] == "d" and got[3]["per_game"] is None and got[3]["main_pts"] is None


def test_mates_are_those_of_all_pairs(spark):
    r = random.Random(9)
    box = [(r.randrange(30), r.choice([None, *range(8)]), r.choice([None, 0, -2, 5, 10, 20]), r.choice([None, 1.0, 7.0])) for _ in range(400)]
    rating = {w: None if w % 3 == 0 else w * 1.5 for w in range(8)}
    rows = [(g, w, m, rating.get(w), a) for g, w, m, a in box]
    got = {x["who"]: x for x in careers.mates_over_games(spark.createDataFrame(rows, "game long, who long, m int, rating double, a double"), ["game"], "who", "m", "rating", ["a"]).collect()}
    side = defaultdict(lambda: defaultdict(lambda: [0, 0.0]))
    for g, w, m, a in box:
        if m and m > 0:
            side[g][w][0] += m
            side[g][w][1] += a or 0.0
    for who in {w for s in side.values() for w in s}:
        games = [s for s in side.values() if who in s]
        mates = [(w, v[0]) for s in games for w, v in s.items() if w != who]
        known = [(m, rating[w]) for w, m in mates if rating.get(w) is not None]
        x = got[who]
        assert x["games"] == len(games) and _near(x["minutes"], sum(s[who][0] for s in games))
        assert _near(x["mates_rating"], sum(m * v for m, v in known) / sum(m for m, _ in known)) and _near(x["mates_known"], sum(m for m, _ in known) / sum(m for _, m in mates))
        assert _near(x["a_share"], sum(s[who][1] for s in games) / sum(v[1] for s in games for v in s.values()))


def test_elasticity_needs_games_and_shrinks_to_regulars(spark):
    r = np.random.default_rng(2)
    rows = []
    for who in range(12):
        for _ in range(3 if who == 0 else 25):
            u, c, w = r.normal(), r.normal(), float(r.integers(10, 30))
            rows.append((1, who, (1 + who / 10) * u + 0.5 * c + r.normal() / 10, u, c if r.random() < 0.8 else None, w))
    rows.append((2, 1, None, 1.0, 1.0, 5.0))
    got = {(x["season"], x["who"]): x for x in careers.elasticity(spark.createDataFrame(rows, "season int, who long, y double, u double, c double, w double"), ["season"], "who", "y", "u", ["c"], "w").collect()}
    assert (2, 1) not in got and got[1, 0]["slope"] is None and got[1, 0]["shrunk"] is None and got[1, 0]["n"] == 3
    slopes, counts = [], []
    for who in range(1, 12):
        y, u, c, w = (np.array(v) for v in zip(*((y, u, c or 0.0, w) for _, k, y, u, c, w in rows[:-1] if k == who), strict=True))
        x, root = np.stack([np.ones(len(u)), u, c], 1), np.sqrt(w)
        b = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
        assert _near(got[1, who]["slope"], b[1])
        slopes.append(b[1])
        counts.append(len(u))
    held = np.clip(slopes, *np.percentile(slopes, [1, 99]))
    assert _near(got[1, 5]["population"], float(np.average(held, weights=counts)))


def test_compared_values_know_only_the_past(spark):
    t = spark.createDataFrame([(1, "ann", 3), (2, "bob", 3), (3, None, 3), (4, "zoe", 3), (5, "ann", 1), (5, "ann", 1), (6, "ann", None)], "id long, key string, now int")
    n = spark.createDataFrame([("ann", 10), ("ann", 10), ("bob", 11), ("bob", 12), (None, 13), ("zoe", 14)], "name string, person long")
    v = spark.createDataFrame([(10, 1, 4.0), (10, 1, 2.0), (10, 2, None), (10, 3, 100.0), (14, 1, None)], "person long, year int, v double")
    x = careers.compared_values(t, n, v, "key", "name", "person", "year", "v", "now")
    assert sorted((tuple(r) for r in x.select("id", "compared", "compared_value").collect()), key=str) == [(1, 10, 6.0), (2, None, None), (3, None, None), (4, 14, None), (5, 10, None), (5, 10, None), (6, 10, None)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "who long, year int, cutoff int, role string, made long, tried long, w double, m double, league string, level int, game long")
    p = none.select("who", "cutoff", "role")
    assert careers.development(none.drop("cutoff"), p, "who", "year", "cutoff", ["m"], "w").count() == 0
    assert careers.latent_shares(none.drop("cutoff"), p, "who", "year", "cutoff", "role", "made", "tried").count() == 0
    assert careers.last_lines(none.drop("cutoff"), p, "who", "year", "cutoff", "league", "level", "made", "w", {"pts": "tried"}).count() == 0
    assert careers.mates_over_games(none, ["game"], "who", "w", "m", ["made"]).count() == 0
    assert careers.elasticity(none, ["year"], "who", "m", "made", ["tried"], "w").count() == 0


def test_least_squares_of_missing_and_hot_groups(spark):
    r = np.random.default_rng(4)
    rows = [(g, *map(float, r.normal(size=3))) for g in [None] * 2000 + ["a"] * 9 + ["b"] * 2]
    got = {x["g"]: x for x in stats.wls_fit(spark.createDataFrame(rows, "g string, y double, a double, b double"), ["g"], "y", ["a", "b"]).collect()}
    assert got["b"]["coefficients"] is None
    for g in (None, "a"):
        y, a, b = (np.array(v) for v in zip(*(x[1:] for x in rows if x[0] == g), strict=True))
        assert np.allclose(got[g]["coefficients"], np.linalg.lstsq(np.stack([np.ones(len(a)), a, b], 1), y, rcond=None)[0])


def test_grids_keys_and_documents(spark, tmp_path):
    x = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (1, "a")], "y int, s string")
    assert sorted(map(tuple, lists.grid(x, ["y", "s"]).collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    k = lambda **e: specs.signature_of(e)
    r = x.select(k(b=F.col("s"), a=F.col("y")).alias("one"), k(a=F.col("y"), b=F.col("s")).alias("two"), k(a=F.col("y")).alias("three")).collect()
    assert all(i["one"] == i["two"] != i["three"] for i in r) and len({i["one"] for i in r}) == 3
    ids = spark.range(2500)
    sinks.documents(ids, str(tmp_path / "d"), F.floor(F.col("id") / 1000))
    docs = spark.read.text(str(tmp_path / "d"))
    assert docs.count() == 3 and docs.select(F.inline(F.from_json("value", "array<struct<id:long>>"))).agg(F.sum("id")).first()[0] == 2500 * 2499 // 2


@pytest.mark.parametrize("name", ["career_development", "latent_shares", "last_lines_abroad", "use_elasticity", "mates_over_games", "compared_values"])
def test_plans_hold_no_window_over_rows_of_a_person(spark, sf_dir, name):
    """Rows combine by aggregates; what windows see has one row a person and season, a person and game, or a year and role."""
    from orderloom.plans import careers as plans

    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    if name in ("last_lines_abroad", "compared_values"):  # use_elasticity: the selection of percentiles has one over a bracket
        assert "Window [" not in physical


def test_identities_by_name_birth_and_last_resort(spark):
    p = spark.createDataFrame([(1, 10, "ann bo", "bo", "2000-01-01"), (2, 10, "cy do", "do", None), (3, 10, "el fo", "fo", "2000-05-05"), (4, 10, None, None, None), (5, 10, "gi ho", "ho", "2001-01-01")], "who int, cutoff int, name string, last string, birth string").withColumn("birth", F.col("birth").cast("date"))
    rows = [
        (101, "ann bo", "bo ann", "bo", "2000-12-31", 5), (102, "bo ann", "ann bo", "bo", None, 1), (103, "ann bo", "bo ann", "bo", "2002-01-01", 5),
        (201, "cy do", "do cy", "do", "1990-01-01", 10), (202, "cy do", "do cy", "do", None, 1), (203, "cy do", "do cy", "do", None, 11),
        (301, "nick fo", "fo nick", "fo", "2000-05-05", 3), (302, "nick fo", "fo nick", "fo", "2000-05-06", 3), (401, None, None, None, None, 3), (501, "gi ho", "ho gi", "ho", "2005-01-01", 3), (501, "gi ho", "ho gi", "ho", "2005-01-01", 3),
    ]
    r = spark.createDataFrame(rows, "record int, name string, reversed string, last string, birth string, first int").withColumn("birth", F.col("birth").cast("date"))
    got = sorted(map(tuple, careers.identities(p, r, "who", "cutoff", "record", "first").collect()))
    assert got == [(1, 101), (1, 102), (2, 201), (3, 301)]  # 202 is nine years back, 203 lies ahead


def test_youth_events_know_who_took_part(spark):
    e = spark.createDataFrame(
        [(7, "a", 1, 4, 17, 3, False, 2, 40.0, 30), (7, "b", 2, 2, 17, 1, False, None, None, None), (7, "c", 2, 1, 18, 9, True, None, None, None), (8, "c", 2, 1, 18, 2, None, 0, 0.0, 0), (8, "a", 1, 4, 17, 3, True, None, None, None), (7, "d", 5, 4, 20, 1, True, 9, 9.0, 9), (8, "e", 2, 3, None, None, None, 1, 0.0, 4), (9, None, 1, 1, 15, 1, True, None, None, None)],
        "record int, competition string, year int, level int, age int, rank int, listed boolean, g int, mp double, pts int",
    )
    links, p = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 8)], "who int, record int"), spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "who int, cutoff int")
    got = {x["who"]: x.asDict() for x in careers.youth_events(links, p, e, "who", "cutoff", "record", ["pts"], {"world17": ([17], True), "low18": ([18], False), "any20": ([20], None)}).collect()}
    assert set(got) == {1, 2}
    a = got[1]  # a of 7; c of 7 (listed where nobody has a game); e of 8; not a of 8, which has no game where others have
    assert (a["ids"], a["events"], a["max_level"], a["first_year"], a["last_year"], a["best_rank"]) == (2, 3, 4, 1, 2, 3)
    assert (a["world17"], a["low18"], a["any20"], a["g"], a["pts"], a["best_ppg"]) == (1, 1, 0, 3, 34, 15.0)
    assert (a["last_level"], a["last_age"], a["last_gp"], a["last_ppg"], a["last_pts_36"]) == (3, None, 1, 4.0, None)
    assert (got[2]["events"], got[2]["g"], got[2]["last_level"]) == (0, None, None)  # a competition without a name is not counted


def test_ratio_splits_of_each_season(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 2, None]), r.randrange(3), r.choice([None, *map(float, range(12))]), r.choice([None, 0, 1, 2]), r.choice([None, 0, 3])) for _ in range(300)]
    got = {(x["s"], x["w"]): x for x in context.ratio_splits(spark.createDataFrame(rows, "s int, w int, o double, a int, b int"), "s", ["w"], "o", "a", "b").collect()}
    for s in (1, 2, None):
        known = [x for x in rows if x[0] == s and x[2] is not None]
        hi, mid = np.percentile([x[2] for x in known], [75, 50])
        for w in range(3):
            for n, here in (("top", lambda o: o >= hi), ("bot", lambda o: o < mid), ("rest", lambda o: o < hi)):
                own = [x for x in known if x[1] == w and here(x[2])]
                a, b = (sum(x[i] or 0 for x in own) for i in (3, 4))
                assert got[s, w][f"{n}_n"] == len(own) and _near(got[s, w][f"{n}_ratio"], a / b if b else None) and _near(got[s, w][f"{n}_se"], a / b * math.sqrt(1 / max(a, 1) + 1 / b) if b else None)


def test_rates_of_totals_that_are_there(spark):
    assert set(facts.box_rates(["pts"], "x_")) == {"x_gp", "x_mpg", "x_pts_pg", "x_pts_36"}
    every = ["pts", "trb", "orb", "ast", "stl", "blk", "tov", "pir", "fg", "fga", "fg3", "fg3a", "ft", "fta"]
    x = spark.createDataFrame([(2, 60.0, 40, 10, 3, 6, 2, 1, 4, 30, 15, 30, 4, 10, 6, 8), (0, 0.0, *[0] * 14)], f"g int, mp double, {', '.join(f'{c} int' for c in every)}")
    one, none = x.select(*(c.alias(n) for n, c in facts.box_rates(every, "").items())).collect()
    assert _near(one["eff_pg"], (40 + 10 + 6 + 2 + 1 - 15 - 2 - 4) / 2) and _near(one["ts"], 40 / (2 * (30 + 0.44 * 8))) and _near(one["efg"], 17 / 30) and _near(one["orb_36"], 1.8) and _near(one["fta_rate"], 8 / 30)
    assert all(v is None for n, v in none.asDict().items() if n != "gp")
