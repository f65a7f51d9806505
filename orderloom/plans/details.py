"""Contexts of a season, text and date forms, further matches, classifiers on bins, file locks and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions import keys, nulls
from orderloom.operators import context, facts, guards, labels, ledgers, models, pit, resolve, specs, windows
from orderloom.operators.lineage import landing
from orderloom.plans.base import MEMBERS, SUPPLIER_YEARS, Book, member_values, pct_sql, rounded, supplier_years
from orderloom.plans.facts import BOX, _box
from orderloom.plans.features import ROWS, _rows

from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql


# -- contexts ------------------------------------------------------------------------------

YEARS = f"{SUPPLIER_YEARS}, y AS (SELECT s.*, s_nationkey AS team, s_nationkey % 5 AS conf, CASE WHEN supp % 4 <> 0 THEN qty / lines - 25 END AS level, revenue / qty AS load FROM s JOIN supplier ON supp = s_suppkey)"


def _team_years(spark, d):
    s = supplier_years(spark, d).join(table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]), F.col("supp") == F.col("s_suppkey"))
    return s.select("supp", "year", "qty", "revenue", "lines", F.col("s_nationkey").alias("team"), (F.col("s_nationkey") % 5).alias("conf"), F.when(F.col("supp") % 4 != 0, F.col("qty") / F.col("lines") - 25).alias("level"), (F.col("revenue") / F.col("qty")).alias("load"))


def _others(c: str) -> str:
    here = f"(CASE WHEN {c} IS NULL THEN 0 ELSE lines END)"
    return f"(sum({here} * coalesce({c}, 0)) OVER w - {here} * coalesce({c}, 0)) / nullif(sum({here}) OVER w - {here}, 0)"


@book.query(f"""WITH {YEARS}, p AS (SELECT *, lines * greatest(coalesce(level, 0), 0) AS pos, row_number() OVER (PARTITION BY team, year ORDER BY level DESC NULLS LAST, supp) AS k FROM y),
t AS (SELECT *, {', '.join(f'max(level) FILTER (k = {n}) OVER w AS l{n}' for n in (1, 2, 3))}, {_others('level')} AS ml, {_others('load')} AS mo, pos / nullif(sum(pos) OVER w, 0) AS share, sum(pos * pos) OVER w / nullif(sum(pos) OVER w * sum(pos) OVER w, 0) AS conc,
 5 * sum(pos) OVER w / nullif(sum(lines) OVER w, 0) AS total, count(*) OVER w AS n, qty / nullif(sum(qty) OVER w, 0) AS qs FROM p WINDOW w AS (PARTITION BY team, year))
SELECT supp, year, round(ml, 5) + 0.0 AS t_mates_level, round(mo, 4) + 0.0 AS t_mates_load, round(CASE WHEN k = 1 THEN l2 ELSE l1 END, 5) + 0.0 AS t_mates_best, round(CASE WHEN k = 1 THEN l2 + l3 WHEN k = 2 THEN l1 + l3 ELSE l1 + l2 END / 2, 5) + 0.0 AS t_mates_top2,
round(share, 5) + 0.0 AS t_level_share, round(conc, 5) + 0.0 AS t_talent_conc, round(total, 5) + 0.0 AS t_team_sum, n AS t_team_n, round(qs, 5) + 0.0 AS t_qty_share FROM t""")
def team_context(spark, d):
    """The others of a team, the best of them, shares and concentration."""
    x = context.team_mates(_team_years(spark, d), ["team", "year"], "supp", "lines", "level", "load", {"qty": "qty"})
    names = ["t_mates_level", "t_mates_load", "t_mates_best", "t_mates_top2", "t_level_share", "t_talent_conc", "t_team_sum", "t_team_n", "t_qty_share"]
    return rounded(x.select("supp", "year", *(n if n == "t_team_n" else F.round(n, 4 if n == "t_mates_load" else 5).alias(n) for n in names)))


@book.query(f"""WITH {YEARS}, t AS (SELECT team, conf, year, sum(qty) / sum(lines) AS level, sum(lines) AS w FROM y GROUP BY 1, 2, 3), c AS (SELECT conf, year, sum(w * level) / sum(w) AS same FROM t GROUP BY 1, 2),
p AS (SELECT a.conf, a.year, sum(b.w * b.level) / sum(b.w) AS prior FROM t a JOIN t b ON b.team = a.team AND b.year = a.year - 1 GROUP BY 1, 2) SELECT conf::BIGINT AS conf, year, round(same, 6) AS same, round(prior, 6) AS prior FROM c LEFT JOIN p USING (conf, year)""")
def conference_strength(spark, d):
    """A conference's level in a season and what its teams had the season before."""
    t = _team_years(spark, d).groupBy("team", "conf", "year").agg((F.sum("qty") / F.sum("lines")).alias("level"), F.sum("lines").alias("w"))
    return rounded(context.conference(t, "conf", "team", "year", "level", "w"))


def _curve_sql() -> str:
    """Orthogonal polynomials of each year's past, evaluated at the row's age."""
    return f"""WITH {SUPPLIER_YEARS}, a AS (SELECT supp, year, qty AS y, (supp * 7 + year) % 9 + 18.0::DOUBLE AS age FROM s), n AS (SELECT DISTINCT year AS now FROM a),
h AS (SELECT now, age, y, age - avg(age) OVER w AS p1 FROM a JOIN n ON year < now WINDOW w AS (PARTITION BY now)),
h2 AS (SELECT *, (age - sum(age * p1 * p1) OVER w / sum(p1 * p1) OVER w) * p1 - sum(p1 * p1) OVER w / count(*) OVER w AS p2 FROM h WINDOW w AS (PARTITION BY now)),
h3 AS (SELECT *, (age - sum(age * p2 * p2) OVER w / sum(p2 * p2) OVER w) * p2 - sum(p2 * p2) OVER w / sum(p1 * p1) OVER w * p1 AS p3 FROM h2 WINDOW w AS (PARTITION BY now)),
f AS (SELECT now, avg(age) AS a1, sum(age * p1 * p1) / sum(p1 * p1) AS a2, sum(age * p2 * p2) / sum(p2 * p2) AS a3, sum(p1 * p1) / count(*) AS b1, sum(p2 * p2) / sum(p1 * p1) AS b2, avg(y) AS c0, sum(y * p1) / sum(p1 * p1) AS c1, sum(y * p2) / sum(p2 * p2) AS c2, sum(y * p3) / sum(p3 * p3) AS c3,
 quantile_cont(age, 0.005) AS lo, quantile_cont(age, 0.995) AS hi, count(*) AS n FROM h3 GROUP BY 1), r AS (SELECT h3.now, sqrt(sum((y - c0 - c1 * p1 - c2 * p2 - c3 * p3) ** 2) / (any_value(n) - 1)) AS sd FROM h3 JOIN f USING (now) GROUP BY 1),
e AS (SELECT supp, year, y, f.*, sd, greatest(lo, least(hi, age)) AS g FROM a JOIN f ON now = year JOIN r ON r.now = year), q AS (SELECT *, g - a1 AS q1 FROM e), q2 AS (SELECT *, (g - a2) * q1 - b1 AS q2 FROM q), q3 AS (SELECT *, (g - a3) * q2 - b2 * q1 AS q3 FROM q2)
SELECT a.supp, a.year, round(a.y - c0 - c1 * q1 - c2 * q2 - c3 * q3, 3) AS resid, round((a.y - c0 - c1 * q1 - c2 * q2 - c3 * q3) / sd, 4) AS z FROM a LEFT JOIN q3 ON q3.supp = a.supp AND q3.year = a.year"""


@book.query(_curve_sql())
def causal_age_curve(spark, d):
    """Distance from a cubic of age that only earlier seasons shaped."""
    s = supplier_years(spark, d).withColumn("age", ((F.col("supp") * 7 + F.col("year")) % 9 + 18).cast("double"))
    x = context.age_curves(s, "year", "age", "qty")
    return x.select("supp", F.col("year").cast("long").alias("year"), F.round("resid", 3).alias("resid"), F.round("z", 4).alias("z"))


@book.query(f"WITH {YEARS} SELECT supp, year, round((qty - avg(qty) OVER w) / nullif(stddev_samp(qty) OVER w, 0), 6) AS t_qty, round(count(*) OVER w / count(*) OVER (PARTITION BY year)::DOUBLE, 6) AS t_rarity FROM y WINDOW w AS (PARTITION BY conf, year)")
def role_context(spark, d):
    """Against persons of the same role, and how rare that is."""
    x = facts.league_scores(_team_years(spark, d), ["conf", "year"], ["qty"], "t_")
    return rounded(x.withColumn("t_rarity", context.rarity("conf", "year")).select("supp", "year", "t_qty", "t_rarity"))


_GAME = f"""WITH g AS (SELECT l_orderkey, min(l_suppkey) AS one, max(l_suppkey) AS two FROM lineitem GROUP BY 1), b AS (SELECT l_partkey % 40 AS who, ({BOX['pts']})::DOUBLE AS pts, l_quantity AS minutes, CASE WHEN l_suppkey = one THEN two ELSE one END AS opp FROM lineitem JOIN g USING (l_orderkey)),
v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS x1, s_nationkey::DOUBLE AS x2 FROM supplier), m AS (SELECT avg(x1) AS m1, stddev_samp(x1) AS s1, avg(x2) AS m2, stddev_samp(x2) AS s2 FROM v),
t AS (SELECT s_suppkey, list_avg(list_filter([(x1 - m1) / s1, (x2 - m2) / s2], lambda x: x IS NOT NULL)) AS talent FROM v, m), k AS (SELECT b.*, talent FROM b LEFT JOIN t ON s_suppkey = opp WHERE opp % 7 <> 0), q AS (SELECT quantile_cont(talent, 0.75) AS hi, quantile_cont(talent, 0.5) AS mid FROM k)"""


def _split_sql() -> str:
    parts = {"top": "talent >= hi", "bot": "talent < mid", "rest": "talent < hi"}
    cols = ", ".join(f"sum(minutes * pts) FILTER ({c}) / sum(minutes) FILTER ({c}) AS {n}_mean, count(*) FILTER ({c}) AS {n}_n" for n, c in parts.items())
    errs = ", ".join(f"CASE WHEN any_value({n}_n) > 1 THEN sqrt(sum((minutes * (pts - {n}_mean)) ** 2) FILTER ({c})) / sum(minutes) FILTER ({c}) END AS {n}_se" for n, c in parts.items())
    out = ", ".join(f"round({n}_mean, 5) AS {n}_mean, round({n}_se, 5) AS {n}_se, {n}_n" for n in parts)
    return f"""{_GAME}, a AS (SELECT who, count(*) AS n, {cols} FROM k, q WHERE talent IS NOT NULL GROUP BY 1), e AS (SELECT who, {errs} FROM k JOIN a USING (who), q WHERE talent IS NOT NULL GROUP BY 1)
SELECT who, n, {out}, round(top_mean - rest_mean, 5) AS top_minus_rest, round(sqrt(top_se * top_se + rest_se * rest_se), 5) AS top_minus_rest_se FROM a JOIN e USING (who)"""


@book.query(_split_sql())
def opponent_splits(spark, d):
    """Weighted means with errors against strong, weak and other opponents."""
    box, _, _ = _box(spark, d)
    v = table(spark, d, "supplier", ["s_suppkey", "s_acctbal", "s_nationkey"]).select(F.col("s_suppkey").alias("opp_team_id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("x1"), F.col("s_nationkey").cast("double").alias("x2"))
    v = v.select("opp_team_id", context.talent(v, ["x1", "x2"]).alias("talent"))
    k = box.select("who", F.col("pts").cast("double").alias("pts"), "minutes", "opp_team_id").filter("opp_team_id % 7 <> 0").join(v, "opp_team_id", "left")
    s = context.opponent_splits(k, ["who"], "talent", "pts", "minutes")
    return rounded(s, 5)


@book.query("""WITH p AS (SELECT o_custkey % 60 AS who, year(o_orderdate) AS season, o_orderkey % 9 AS role, o_totalprice AS v, o_orderkey FROM orders), f AS (SELECT who, role, v, season, row_number() OVER (PARTITION BY who ORDER BY season DESC, o_orderkey DESC) AS k FROM p)
SELECT who, count(*) AS games, round(avg(v), 4) AS mean, round(avg(v) FILTER (k <= 3), 4) AS latest, max(season)::BIGINT AS final_season, arg_min(role, k) AS final_role, CASE WHEN count(*) >= 20 THEN 'full' WHEN count(*) >= 5 THEN 'part' ELSE 'thin' END AS class FROM f GROUP BY 1""")
def base_table(spark, d):
    """The final line of each person with what led to it, in one pass."""
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    p = o.select((F.col("o_custkey") % 60).alias("who"), F.year("o_orderdate").alias("season"), (F.col("o_orderkey") % 9).alias("role"), F.col("o_totalprice").alias("v"), "o_orderkey")
    k = p.withColumn("k", windows.ordinal(["who"], F.desc("season"), F.desc("o_orderkey")))
    n = F.count("*")
    g = k.groupBy("who").agg(n.alias("games"), F.avg("v").alias("mean"), F.avg(F.when(F.col("k") <= 3, F.col("v"))).alias("latest"), F.max("season").alias("final_season"), F.min_by("role", "k").alias("final_role"))
    return rounded(g.withColumn("class", F.when(F.col("games") >= 20, "full").when(F.col("games") >= 5, "part").otherwise("thin")), 4)


# -- forms ---------------------------------------------------------------------------------


def _plain_sql(x: str) -> str:
    for a, b in keys.TRANSLITERATED.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


@book.query(f"SELECT n_nationkey::BIGINT AS n_nationkey, {_plain_sql(chr(39) + 'Ław ßø ' + chr(39) + ' || n_name || ' + chr(39) + ' Æı' + chr(39))} AS plain FROM nation")
def transliterated_names(spark, d):
    """F3."""
    n = table(spark, d, "nation", ["n_nationkey", "n_name"])
    return rounded(n.select("n_nationkey", keys.transliterated(F.concat(F.lit("Ław ßø "), "n_name", F.lit(" Æı"))).alias("plain")))


@book.query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 12.0 * (6 + p_partkey % 2) + p_size % 12 WHEN p_partkey % 4 = 1 THEN 70.0 + p_size % 20 END::DOUBLE AS wing,
CASE WHEN p_size = 0 THEN '—' ELSE p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END END AS place, (p_size * 2) || '%' AS share,
CASE WHEN p_partkey < 1000 THEN p_partkey::VARCHAR ELSE (p_partkey // 1000) || ',' || printf('%03d', p_partkey % 1000) END AS shown FROM part""")
def plausible_patterns_and_formats(spark, d):
    """The first pattern with a plausible number; ordinals, percentages and counts for print."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 4 == 0, F.format_string("wingspan: %d'%d", 6 + k % 2, s % 12)).when(k % 4 == 1, F.format_string("a %d inch wingspan", 70 + s % 20)).when(k % 4 == 2, F.format_string("wingspan: 9'%d", s % 12)).otherwise("none")
    wing = keys.first_in_range(text, (r"wingspan: (\d+)'(\d+)", r"(\d+) inch"), 60, 100)
    p = table(spark, d, "part", ["p_partkey", "p_size"])
    return rounded(p.select("p_partkey", wing.alias("wing"), keys.ordinal_text(F.nullif("p_size", F.lit(0))).alias("place"), keys.percent_text(s * 2 / 100).alias("share"), keys.whole_text("p_partkey").alias("shown")))


@book.query("""WITH t AS (SELECT o_orderkey, year(o_orderdate)::INT AS y, o_orderdate::DATE AS d FROM orders) SELECT o_orderkey, CASE WHEN y % 3 = 0 THEN NULL ELSE make_date(y, 6, 20 + y % 8) END AS night, (CASE WHEN month(d) < 7 THEN y - (18 + o_orderkey % 9) - 1 ELSE y - (18 + o_orderkey % 9) END)::BIGINT AS born FROM t""")
def dates_of_years(spark, d):
    """a date from a table of days by year, and the likelier year of birth."""
    o = table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).withColumn("y", F.year("o_orderdate"))
    days = o.select("y").distinct().withColumn("day", F.when(F.col("y") % 3 == 0, "13-40").otherwise(F.format_string("06-%02d", 20 + F.col("y") % 8)))
    x = o.join(days, "y")
    return rounded(x.select("o_orderkey", keys.date_of("y", "day").alias("night"), keys.birth_year(18 + F.col("o_orderkey") % 9, F.to_date("o_orderdate")).alias("born")))


for _how, _sql in {"log": "ln(1 + w)", "sqrt": "sqrt(w)", "rank": pct_sql("w", "cohort"), "zclass": "(ln(1 + w) - avg(ln(1 + w)) OVER (PARTITION BY cohort)) / coalesce(nullif(stddev_pop(ln(1 + w)) OVER (PARTITION BY cohort), 0), 1)"}.items():

    def _target(spark, d, how=_how):
        v = member_values(spark, d).withColumn("y", F.when(F.col("entity") % 5 != 0, F.round(F.col("value") / 10000, 2)))
        return rounded(v.select("cohort", "entity", labels.fold_target("y", ["cohort"], how).alias("target")))

    book.query(f"WITH {MEMBERS}, t AS (SELECT cohort, entity, greatest(0, least(40, coalesce(CASE WHEN entity % 5 <> 0 THEN round(value / 10000, 2) END, 0)))::DOUBLE AS w FROM v) SELECT cohort, entity, round({_sql}, 6) AS target FROM t", f"fold_target_{_how}")(_target)


@book.query(f"WITH {MEMBERS}, r AS (SELECT cohort, value, row_number() OVER (PARTITION BY cohort ORDER BY c_acctbal DESC, entity) AS o, row_number() OVER (PARTITION BY cohort ORDER BY entity) AS t FROM v JOIN customer ON entity = c_custkey) SELECT cohort, round(sum(value) FILTER (o <= 10), 4) AS ours, round(sum(value) FILTER (t <= 10), 4) AS theirs FROM r GROUP BY 1")
def top_ten_value(spark, d):
    """What the first ten of two orders were worth; limits come before the shuffle."""
    x = _rows(spark, d)
    ours = windows.top_k(x, ["cohort"], [F.desc("c_acctbal"), F.col("entity")], 10).groupBy("cohort").agg(F.sum("value").alias("ours"))
    theirs = windows.top_k(x, ["cohort"], [F.col("entity")], 10).groupBy("cohort").agg(F.sum("value").alias("theirs"))
    return rounded(ours.join(theirs, "cohort"), 4)


# -- matches -------------------------------------------------------------------------------


@book.query("""WITH e AS (SELECT event_id, user_id, ts, event_type, value FROM events), l AS (SELECT event_id, user_id, ts FROM e WHERE event_type = 'purchase'),
a AS (SELECT event_id, arg_max(v, (t, i)) AS v FROM (SELECT l.event_id, r.value AS v, r.ts AS t, r.event_id AS i FROM l JOIN e r ON r.user_id = l.user_id AND r.event_type = 'click' AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 2 DAY) GROUP BY 1),
b AS (SELECT event_id, arg_max(v, (t, i)) AS v FROM (SELECT l.event_id, r.value AS v, r.ts AS t, r.event_id AS i FROM l JOIN e r ON r.user_id = l.user_id AND r.event_type = 'view' AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 9 DAY) GROUP BY 1)
SELECT event_id, round(coalesce(a.v, b.v), 6) AS value, CASE WHEN a.v IS NOT NULL THEN 'click' WHEN b.v IS NOT NULL THEN 'view' END AS source FROM l LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""")
def asof_with_fallback(spark, d):
    """The latest click within two days, else the latest view within nine."""
    e = table(spark, d, "events", ["event_id", "user_id", "ts", "event_type", "value"])
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    of = lambda k: e.filter(F.col("event_type") == k).select("user_id", "ts", F.col("event_id").alias("tie"), "value")
    return rounded(pit.as_of_any(left, [("click", of("click"), "2 days"), ("view", of("view"), "9 days")], "user_id", "ts", "ts", "tie", "value").select("event_id", "value", "source"))


@book.query("""WITH a AS (SELECT DISTINCT p_type AS x FROM part), b AS (SELECT DISTINCT substr(p_type, 1, 4 + p_partkey % 9) AS y FROM part)
SELECT x, y FROM a JOIN b ON substr(x, 1, 3) = substr(y, 1, 3) WHERE (length(y) >= 5 AND starts_with(x, y)) OR (length(x) >= 5 AND starts_with(y, x)) OR (length(x) >= 9 AND substr(x, 1, 9) = substr(y, 1, 9))""")
def prefix_keys(spark, d):
    """One key starts with the other, or both with the same nine letters."""
    p = table(spark, d, "part", ["p_partkey", "p_type"])
    return resolve.by_prefix(p.select(F.col("p_type").alias("x")), p.select(F.expr("substr(p_type, 1, cast(4 + p_partkey % 9 as int))").alias("y")), "x", "y")


@book.query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '2-HIGH')::INT DESC, o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k = 1")
def preferred_row(spark, d):
    """Of rows with one key the one that agrees, then the weightiest."""
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"])
    return resolve.preferring(o, ["o_custkey"], F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice"), [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@book.query("""WITH r AS (SELECT s_suppkey + 500 AS id, s_suppkey AS key, 'n' || s_suppkey % 7 AS name FROM supplier), l AS (SELECT c_custkey AS id, 'n' || CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 ELSE c_custkey % 20 END AS name FROM customer), n AS (SELECT name, count(*) AS n, min(key) AS key FROM r GROUP BY 1)
SELECT l.id, CASE WHEN r.key IS NOT NULL THEN r.key WHEN n.n = 1 THEN n.key END AS key, CASE WHEN r.key IS NOT NULL THEN 'id' WHEN n.n = 1 THEN 'name' WHEN n.n > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM l LEFT JOIN r ON r.id = l.id LEFT JOIN n ON n.name = l.name""")
def id_then_name(spark, d):
    """By id, else by a name that is unique; ambiguous ones are told."""
    r = table(spark, d, "supplier", ["s_suppkey"]).select((F.col("s_suppkey") + 500).alias("rid"), F.col("s_suppkey").alias("key"), F.concat(F.lit("n"), F.col("s_suppkey") % 7).alias("rname"))
    l = table(spark, d, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 7).otherwise(F.col("c_custkey") % 20)).alias("name"))  # noqa: E741
    return resolve.by_id_or_name(l, r, "id", "rid", "key", "name", "rname")


# -- models, files, ledgers -----------------------------------------------------------------


@book.query()
def bin_classifier(spark, d):
    """M7: shares of outcome bins by a classifier, and the bin that they expect."""
    x = windows.with_bins(_rows(spark, d), ["cohort"], "value", 3, "bin").withColumn("bin", F.col("bin").cast("double"))
    return rounded(models.bin_shares(x.filter("cohort <= 1998"), x.filter("cohort > 1998"), ["c_acctbal", "c_nationkey"], "bin", 3).select("cohort", "entity", "p0", "p1", "p2", "expected"), 4)


@book.query()
def forest_cohort_fit(spark, d):
    """M5 through the plug-in table."""
    x = _rows(spark, d)
    return rounded(models.FAMILIES["forest"](x.filter("cohort <= 1998"), x.filter("cohort > 1998"), ["c_acctbal", "c_nationkey"], "value").select("cohort", "entity", "score"), 2)


@book.query("SELECT 'altered' AS change, 1::BIGINT AS n UNION ALL SELECT 'removed', 1 UNION ALL SELECT 'added', 1")
def file_lock(spark, d):
    """Hashes of files, and what changed since they were locked."""
    one, two = landing(spark, "locked"), landing(spark, "locked")
    n = table(spark, d, "nation", ["n_name"])
    for folder, names in ((one, {"a": "x", "b": "x", "c": "x"}), (two, {"a": "x", "b": "y", "d": "x"})):
        for name, mark in names.items():
            n.select(F.concat("n_name", F.lit(mark)).alias("value")).coalesce(1).write.text(f"{folder}/{name}")
    named = lambda folder: guards.file_hashes(spark, folder, "part-*").select("sha256", F.lit(folder).alias("_f"))
    of = lambda folder, names: [named(f"{folder}/{x}").select(F.lit(x).alias("file"), "sha256") for x in names]
    locked, now = (a.unionByName(b).unionByName(c) for a, b, c in (of(one, "abc"), of(two, "abd")))
    return guards.changed_files(locked, now).groupBy("change").agg(F.count("*").alias("n"))


@book.query("SELECT 0::BIGINT AS broken, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS lines, 1::BIGINT AS edited, 1::BIGINT AS removed")
def chained_ledger(spark, d):
    """R-1, G8: two additions to a ledger chain on; an edited line and a removed one show."""
    path = landing(spark, "ledger")
    guards.append_to_ledger(table(spark, d, "region", ["r_regionkey", "r_name"]).toDF("k", "name"), path, ["k"], ["k", "name"])
    guards.append_to_ledger(table(spark, d, "nation", ["n_nationkey", "n_name"]).toDF("k", "name"), path, ["k"], ["k", "name"])
    ledger = spark.read.json(path)
    n = lambda df: guards.broken_ledger(df, ["k", "name"]).agg(F.count("*").alias("n"))
    edited = n(ledger.withColumn("name", F.when(F.col("seq") == 3, "other").otherwise(F.col("name")))).withColumnRenamed("n", "edited")
    removed = n(ledger.filter("seq <> 7")).withColumnRenamed("n", "removed")
    return n(ledger).withColumnRenamed("n", "broken").join(ledger.agg(F.count("*").alias("lines")), F.lit(True)).join(edited, F.lit(True)).join(removed, F.lit(True))


@book.query("""WITH k AS (SELECT md5(to_json({brand: brand, dear: price > 100, kind: kind, steps: [size, 1]})) AS key, md5(to_json({brand: brand, dear: price > 100, kind: kind, steps: [1, size]})) AS other FROM items) SELECT key, count(*) AS n, true AS any_order, min(other) AS other FROM k GROUP BY 1""")
def config_signatures(spark, d):
    """Each item's make-up as a configuration with a key; the order of entries does not matter, that of a list does."""
    i = table(spark, d, "items", ["item_id", "brand", "kind", "size", "price"])
    one = {"kind": F.col("kind"), "brand": F.col("brand"), "steps": F.array("size", F.lit(1)), "dear": F.col("price") > 100}
    keyed = i.select(specs.signature_of(one).alias("key"), specs.signature_of(dict(reversed(one.items()))).alias("same"), specs.signature_of(one | {"steps": F.array(F.lit(1), "size")}).alias("other"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.bool_and(F.col("key") == F.col("same")).alias("any_order"), F.min("other").alias("other"))


@book.query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN 99.5 ELSE p_retailprice END::DOUBLE AS price, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN 99.5 / greatest(p_size, 1) ELSE p_retailprice / greatest(p_size, 1) END::DOUBLE AS per_size FROM part")
def patched_cells(spark, d):
    """Cells that are cleared, set or kept, and what is derived from them made anew."""
    p = table(spark, d, "part", ["p_partkey", "p_retailprice", "p_size"])
    patches = p.select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, "NA").when(F.col("p_partkey") % 6 == 1, "99.5").when(F.col("p_partkey") % 6 == 2, "").alias("cell")).filter("cell is not null")
    x = p.join(patches, "p_partkey", "left").select("p_partkey", "p_size", nulls.patch("p_retailprice", "cell").alias("price"))
    return x.select("p_partkey", "price", (F.col("price") / F.greatest("p_size", F.lit(1))).alias("per_size"))


@book.query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS x FROM customer), b AS (SELECT c_custkey, c_acctbal * CASE WHEN c_custkey % 50 = 0 THEN 3 ELSE 2 END AS x FROM customer WHERE c_custkey % 2 = 0), k AS (SELECT median(b.x / nullif(a.x, 0)) AS k FROM a JOIN b USING (c_custkey) WHERE a.x IS NOT NULL)
SELECT c_custkey, round(CASE WHEN v BETWEEN -900 AND 9000 THEN v END, 4) AS x, CASE WHEN v NOT BETWEEN -900 AND 9000 OR v IS NULL THEN NULL WHEN f THEN 'a' ELSE 'b' END AS source FROM (SELECT c_custkey, coalesce(a.x, b.x / k) AS v, a.x IS NOT NULL AS f FROM a LEFT JOIN b USING (c_custkey), k)""")
def bridge_columns(spark, d):
    """One scale from two sources, the second rescaled by the median ratio, implausible values out."""
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal"])
    a = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("a"))
    b = c.filter("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") * F.when(F.col("c_custkey") % 50 == 0, 3).otherwise(2)).alias("b"))
    j = a.join(b, "c_custkey", "left")
    k = j.filter("a is not null").agg(F.median(nulls.sdiv("b", "a")).alias("k")).first()["k"]
    value, source = nulls.first_of(("a", F.col("a")), ("b", F.col("b") / F.lit(k)))
    x = j.select("c_custkey", nulls.plausible(value, -900.0, 9000.0).alias("x"), source.alias("source"))
    return rounded(x.withColumn("source", nulls.gate("source", F.col("x").isNotNull())), 4)


@book.query("""WITH q AS (SELECT o_custkey AS who, o_clerk_ AS book, d, CASE WHEN k % 3 = 0 THEN -100.0 - k % 150 ELSE 100.0 + k % 200 END::DOUBLE AS price, (k % 30 + 0.5)::DOUBLE AS line, k FROM (SELECT o_custkey, o_orderkey % 4 AS o_clerk_, o_orderdate AS d, o_orderkey AS k FROM orders)),
l AS (SELECT *, row_number() OVER (PARTITION BY who, book ORDER BY d DESC, k DESC) AS r FROM q), p AS (SELECT who, line, CASE WHEN price < 0 THEN -price / (-price + 100) ELSE 100 / (price + 100) END AS p FROM l WHERE r = 1) SELECT who, count(*) AS odds_books, round(median(line), 4) AS odds_line, round(median(p), 6) AS odds_p, round(max(line) - min(line), 4) AS odds_spread FROM p GROUP BY 1""")
def market_odds(spark, d):
    """The last price of each book, and the middle of books in probabilities."""
    from orderloom.functions import numbers
    from orderloom.operators.dedup import best_by

    k = F.col("o_orderkey")
    q = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]).select(F.col("o_custkey").alias("who"), (k % 4).alias("book"), "o_orderdate", F.when(k % 3 == 0, -100.0 - k % 150).otherwise(100.0 + k % 200).cast("double").alias("price"), (k % 30 + 0.5).cast("double").alias("line"), k.alias("k"))
    last = best_by(q, ["who", "book"], [F.desc("o_orderdate"), F.desc("k")]).withColumn("p", numbers.price_probability("price"))
    return rounded(last.groupBy("who").agg(F.count("*").alias("odds_books"), F.round(F.median("line"), 4).alias("odds_line"), F.median("p").alias("odds_p"), F.round(F.max("line") - F.min("line"), 4).alias("odds_spread")))


@book.query("""WITH o AS (SELECT o_orderkey % 2 AS addition, o_orderkey AS k, o_orderpriority AS name FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY addition ORDER BY k) - 1 AS place FROM o),
l AS (SELECT addition, place // 500 AS segment, place, sha256('{"at":' || place || ',"k":' || k || ',"name":' || coalesce('"' || name || '"', 'null') || '}') AS h FROM a)
SELECT addition::BIGINT AS addition, segment::BIGINT AS segment, count(*) AS n, list_reduce(list(h ORDER BY place), lambda x, y: sha256(x || y), '') AS head FROM l GROUP BY 1, 2""")
def segmented_ledger(spark, d):
    """G8, R-1: two additions to a ledger in segments; the heads that verify it."""
    path = landing(spark, "ledger")
    o = table(spark, d, "orders", ["o_orderkey", "o_orderpriority"]).toDF("k", "name")
    for i in (0, 1):
        ledgers.append(o.filter(F.col("k") % 2 == i), path, ["k"], ["k", "name"], segment=500)
    return ledgers.read(spark, path, "heads").select("addition", "segment", "n", "head")


@book.query("""WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT 'edited' AS change, 'line' AS fault, place // 500 AS segment, place FROM o WHERE k % 1000 = 7 UNION ALL SELECT DISTINCT 'edited', 'segment', place // 500, NULL FROM o WHERE k % 1000 = 7
UNION ALL SELECT DISTINCT 'removed', 'segment', place // 500, NULL FROM o WHERE k % 1300 = 11""")
def ledger_faults(spark, d):
    """Every edited and removed line of a ledger, found segment by segment."""
    path = landing(spark, "ledger")
    ledgers.append(table(spark, d, "orders", ["o_orderkey", "o_custkey"]).toDF("k", "c"), path, ["k"], ["k", "c"], segment=500)
    lines, heads, roots = (ledgers.read(spark, path, x) for x in ("lines", "heads", "roots"))
    edited = lines.withColumn("c", F.when(F.col("k") % 1000 == 7, F.col("c") + 1).otherwise(F.col("c")))
    out = None
    for change, these in (("edited", edited), ("removed", lines.filter("k % 1300 <> 11"))):
        own = ledgers.faults(these, heads, roots, ["k", "c"]).select(F.lit(change).alias("change"), "fault", "segment", F.col("at").alias("place"))
        out = own if out is None else out.unionByName(own)
    return out
