"""Facts of games and persons, group fits, ratings and reshaping for reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from orderloom.functions import lists, nulls
from orderloom.operators import facts, models, stats, windows
from orderloom.plans.aggregates import GAMES, _games
from orderloom.plans.base import MEMBERS, SUPPLIER_YEARS, Book, member_values, rank_sql, rounded, supplier_years
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql


# -- player and game -----------------------------------------------------------------------

#: Box counts made from order lines, as expressions that both engines read.
BOX = {
    "minutes": "l_quantity", "pts": "l_linenumber * 3 + l_partkey % 7", "fga": "l_partkey % 15 + 2", "fgm": "l_partkey % 7", "tpa": "l_linenumber", "tpm": "l_linenumber % 3", "fta": "l_partkey % 6", "ftm": "l_partkey % 3",
    "oreb": "l_partkey % 4", "dreb": "l_partkey % 5", "reb": "l_partkey % 4 + l_partkey % 5", "ast": "l_suppkey % 9", "stl": "l_linenumber % 4", "blk": "l_partkey % 2", "tov": "l_suppkey % 5", "pf": "l_linenumber % 6",
}


def _box(spark, d):
    l = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate"])  # noqa: E741
    teams = l.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("one"), F.max("l_suppkey").alias("two"))
    rows = l.join(teams, "l_orderkey").selectExpr(
        "year(l_shipdate) AS season", "l_orderkey AS game_id", "l_orderkey * 10 + l_linenumber AS athlete_id", "l_suppkey AS team_id", "CASE WHEN l_suppkey = one THEN two ELSE one END AS opp_team_id",
        "CASE WHEN l_suppkey = one THEN 'home' ELSE 'away' END AS side", "l_partkey % 11 = 0 AS dnp", "l_partkey % 40 AS who", "l_suppkey + 60 AS team_score", "CASE WHEN l_suppkey = one THEN two ELSE one END + 60 AS opp_score", *(f"{e} AS {c}" for c, e in BOX.items()),
    )
    team_box = l.filter("l_suppkey % 4 <> 0").groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("team_id")).agg(*(F.sum(F.expr(BOX[c])).alias(c) for c in ("fga", "oreb", "tov", "fta")))
    o = table(spark, d, "orders", ["o_orderkey"])
    return rows, team_box, o.select(F.col("o_orderkey").alias("game_id"), (F.col("o_orderkey") % 3 == 0).alias("neutral"))


_SUMS = ", ".join(f"sum({c}) FILTER (played) OVER (PARTITION BY game_id, team_id) AS tm_{c}" for c in facts.TEAM_SUMS)


@book.query(f"""WITH g AS (SELECT l_orderkey, min(l_suppkey) AS one, max(l_suppkey) AS two FROM lineitem GROUP BY 1),
b AS (SELECT year(l_shipdate) AS season, l_orderkey AS game_id, l_orderkey * 10 + l_linenumber AS athlete_id, l_suppkey AS team_id, CASE WHEN l_suppkey = one THEN two ELSE one END AS opp_team_id, l_suppkey = one AS home, l_partkey % 11 = 0 AS dnp,
 {', '.join(f'({e})::DOUBLE AS {c}' for c, e in BOX.items())} FROM lineitem JOIN g USING (l_orderkey)), c AS (SELECT *, NOT dnp AND minutes > 0 AS played FROM b), t AS (SELECT *, {_SUMS} FROM c),
p AS (SELECT l_orderkey AS game_id, l_suppkey AS team_id, sum({BOX['fga']}) - sum({BOX['oreb']}) + sum({BOX['tov']}) + 0.44 * sum({BOX['fta']}) AS poss FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1, 2),
j AS (SELECT t.*, CASE WHEN tm_minutes BETWEEN 190 AND 300 THEN tm_minutes ELSE 200 END AS tm_min, coalesce(list_avg(list_filter([x.poss, y.poss], lambda v: v IS NOT NULL)), tm_fga - tm_oreb + tm_tov + 0.44 * tm_fta) AS tm_poss,
 fga + 0.44 * fta + tov AS load, tm_fga + 0.44 * tm_fta + tm_tov AS tm_load, pts + 0.4 * fgm - 0.7 * fga - 0.4 * (fta - ftm) + 0.7 * oreb + 0.3 * dreb + stl + 0.7 * ast + 0.7 * blk - 0.4 * pf - tov AS gs
 FROM t LEFT JOIN p x ON x.game_id = t.game_id AND x.team_id = t.team_id LEFT JOIN p y ON y.game_id = t.game_id AND y.team_id = t.opp_team_id),
k AS (SELECT *, CASE WHEN played THEN gs / minutes * 36 END AS gs36 FROM j), l AS (SELECT season, sum(gs36 * minutes) / sum(minutes) AS level FROM k WHERE played AND minutes >= 1 GROUP BY 1)
SELECT athlete_id, game_id, CASE WHEN game_id % 3 = 0 THEN 0 WHEN home THEN 1 ELSE -1 END::BIGINT AS home, round(tm_poss, 4) AS tm_poss, round(CASE WHEN fga + 0.44 * fta > 0 THEN pts / (2 * (fga + 0.44 * fta)) END, 6) AS ts,
 round(CASE WHEN fga > 0 THEN (fgm + 0.5 * tpm) / fga END, 6) AS efg, round(CASE WHEN tm_load > 0 THEN load / tm_load END, 6) AS poss_share, round(CASE WHEN played AND tm_load > 0 THEN 100 * load * (tm_min / 5) / (minutes * tm_load) END, 4) AS usg,
 round(CASE WHEN played AND minutes / (tm_min / 5) * tm_fgm - fgm > 0 THEN 100 * ast / (minutes / (tm_min / 5) * tm_fgm - fgm) END, 4) AS ast_pct, round(CASE WHEN load > 0 THEN 100 * tov / load END, 4) AS tov_pct,
 round(gs36, 4) + 0.0 AS gs36, round(gs36 - level, 4) + 0.0 AS gbpm, (team_id - opp_team_id)::DOUBLE AS margin FROM k JOIN l USING (season)""")
def player_game(spark, d):
    """The fact table of players and games."""
    x = facts.player_game(*_box(spark, d))
    return rounded(x.select("athlete_id", "game_id", "home", F.round("tm_poss", 4).alias("tm_poss"), "ts", "efg", "poss_share", *(F.round(c, 4).alias(c) for c in ("usg", "ast_pct", "tov_pct", "gs36", "gbpm")), "margin"))


_RATES = {"qty_36": "36.0 * qty / lines", "rev_36": "36.0 * revenue / lines / 1000"}


@book.query(f"""WITH {SUPPLIER_YEARS}, r AS (SELECT supp, year, s_nationkey AS league, lines, (supp % 12 + 14)::DOUBLE AS age, {', '.join(f'{e} AS {c}' for c, e in _RATES.items())} FROM s JOIN supplier ON supp = s_suppkey WHERE lines >= 5),
z AS (SELECT *, {', '.join(f'({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) AS iz_{c}' for c in _RATES)}, (rank() OVER (PARTITION BY league, year ORDER BY qty_36) + (count(*) OVER (PARTITION BY league, year, qty_36) - 1) / 2.0) / count(*) OVER w AS pct, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY league, year))
SELECT supp, year, {', '.join(f'round(iz_{c}, 6) AS iz_{c}, round(iz_{c} * greatest(22 - age, 0), 6) + 0.0 AS iz_young_x_{c}' for c in _RATES)}, round(pct, 6) AS iz_pct, n AS iz_n FROM z""")
def league_season_scores(spark, d):
    """Rates against the league and season, and times the years under twenty-two."""
    s = supplier_years(spark, d).filter("lines >= 5").join(table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]), F.col("supp") == F.col("s_suppkey")).withColumnRenamed("s_nationkey", "league")
    s = s.withColumns({c: F.expr(e) for c, e in _RATES.items()}).withColumn("age", (F.col("supp") % 12 + 14).cast("double"))
    z = facts.league_scores(s, ["league", "year"], list(_RATES))
    z = windows.ranked(z, ["league", "year"], {"pct": "qty_36"}, counts=True).withColumn("iz_pct", F.col("pct") / F.col("pct_n"))
    z = facts.young(z, "age", [f"iz_{c}" for c in _RATES])
    return rounded(z.select("supp", "year", *(x for c in _RATES for x in (f"iz_{c}", f"iz_young_x_{c}")), "iz_pct", F.col("pct_n").alias("iz_n")))


@book.query("""WITH m AS (SELECT p_partkey, p_size + 60.0::DOUBLE AS h, CASE WHEN p_partkey % 4 <> 0 THEN p_size + 64.5::DOUBLE END AS w, p_size + 80.0::DOUBLE AS r, p_retailprice / 5 AS g, CASE WHEN p_partkey % 3 <> 0 THEN p_size % 20 + 1.0::DOUBLE END AS f, p_size % 12 + 24.0::DOUBLE AS s, p_size % 15 + 28.0::DOUBLE AS v FROM part)
SELECT p_partkey, round(w / h, 6) AS wing_ratio, round(703 * g / (h * h), 6) AS bmi_like, round(g * (1 - f / 100), 4) AS lean_mass, round(g * f / 100, 4) AS fat_mass, v - s AS run_up_gain, r + v AS max_touch, (3 + (w IS NOT NULL)::INT + (f IS NOT NULL)::INT)::BIGINT AS measures, 2::BIGINT AS drills FROM m""")
def physical_ratios(spark, d):
    """F36, D23."""
    s = F.col("p_size").cast("double")
    p = table(spark, d, "part", ["p_partkey", "p_size", "p_retailprice"]).select(
        "p_partkey", (s + 60).alias("h"), F.when(F.col("p_partkey") % 4 != 0, s + 64.5).alias("w"), (s + 80).alias("r"), (F.col("p_retailprice") / 5).alias("g"), F.when(F.col("p_partkey") % 3 != 0, s % 20 + 1).alias("f"), (s % 12 + 24).alias("s"), (s % 15 + 28).alias("v"),
    )
    x = facts.physique(p, "h", "w", "r", "g", "f", "s", "v")
    return rounded(x.select("p_partkey", "wing_ratio", "bmi_like", F.round("lean_mass", 4).alias("lean_mass"), F.round("fat_mass", 4).alias("fat_mass"), "run_up_gain", "max_touch", "measures", "drills"))


@book.query("""WITH x AS (SELECT c_custkey, (c_custkey % 40 + 50) / 100.0::DOUBLE AS ft, (c_custkey % 23 + 20) / 100.0::DOUBLE AS tp, (c_custkey % 11)::DOUBLE AS vol, c_acctbal / 10000 AS proj, c_nationkey::DOUBLE AS age FROM customer),
m AS (SELECT avg(ft) AS mf, stddev_samp(ft) AS sf, avg(vol) AS mv, stddev_samp(vol) AS sv, avg(proj) AS mp, stddev_samp(proj) AS sp, avg(age) AS ma, stddev_samp(age) AS sa FROM x WHERE c_custkey % 3 <> 0)
SELECT c_custkey, round(ft * vol, 6) AS x_free_volume, round(ft - tp, 6) AS x_free_gap, round((ft - mf) / sf + (vol - mv) / sv + (proj - mp) / sp, 6) AS x_shoot, round(-((age - ma) / sa) * ((ft - mf) / sf + (vol - mv) / sv), 6) AS x_age_shoot, (age >= 21.5 AND ft >= 0.78 AND vol >= 4)::INT::DOUBLE AS x_old_shooter FROM x, m""")
def interaction_features(spark, d):
    """products and sums in the training rows' deviations."""
    k = F.col("c_custkey")
    x = table(spark, d, "customer").select("c_custkey", ((k % 40 + 50) / 100.0).alias("ft"), ((k % 23 + 20) / 100.0).alias("tp"), (k % 11).cast("double").alias("vol"), (F.col("c_acctbal") / 10000).alias("proj"), F.col("c_nationkey").cast("double").alias("age"))
    out = facts.interactions(x, F.col("c_custkey") % 3 != 0, "ft", "tp", "vol", "proj", "age")
    return rounded(out.select("c_custkey", "x_free_volume", "x_free_gap", "x_shoot", "x_age_shoot", "x_old_shooter"))


@book.query("SELECT page_id, CASE WHEN length(concat_ws(' ', regexp_extract(url, '://([^/]+)', 1), substr(html, 1, 30))) > 40 THEN concat_ws(' ', regexp_extract(url, '://([^/]+)', 1), substr(html, 1, 30)) END AS t FROM pages")
def joined_text_gate(spark, d):
    """texts in a row, if they are long enough together."""
    p = table(spark, d, "pages", ["page_id", "url", "html"]).select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("a"), F.substring("html", 1, 30).alias("b"))
    return p.select("page_id", facts.joined_text(["a", "b"]).alias("t"))


# -- fits and ratings ----------------------------------------------------------------------


def _wls_sql() -> str:
    """Two columns and an intercept by the normal equations about the means."""
    return f"""WITH {SUPPLIER_YEARS}, x AS (SELECT supp, qty AS y, (year - 1995)::DOUBLE AS a, revenue / 1000 AS b, lines::DOUBLE AS w FROM s),
m AS (SELECT supp, count(*) AS n, sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * y) / sum(w) AS my FROM x GROUP BY 1), c AS (SELECT supp, n, sw, ma, mb, my, a - ma AS a, b - mb AS b, y - my AS y, w FROM x JOIN m USING (supp)),
t AS (SELECT supp, any_value(n) AS n, any_value(sw) AS sw, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum(w * a * a) AS aa, sum(w * a * b) AS ab, sum(w * b * b) AS bb, sum(w * a * y) AS ay, sum(w * b * y) AS by_, sum(w * y * y) AS yy FROM c GROUP BY 1),
f AS (SELECT *, aa * bb - ab * ab AS d, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS k1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS k2 FROM t WHERE n > 3), s2 AS (SELECT *, greatest(yy - k1 * ay - k2 * by_, 0) / (n - 3) AS v FROM f)
SELECT supp, n, round(my - k1 * ma - k2 * mb, 3) AS intercept, round(k1, 4) AS year_slope, round(k2, 4) AS revenue_slope, round(sqrt((1 / sw + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / d) * v), 3) AS intercept_error, round(sqrt(bb / d * v), 4) AS year_error, round(sqrt(aa / d * v), 4) AS revenue_error FROM s2"""


@book.query(_wls_sql())
def wls_with_errors(spark, d):
    """Weighted least squares of each group with standard errors."""
    s = supplier_years(spark, d).select("supp", "qty", (F.col("year") - 1995).cast("double").alias("a"), (F.col("revenue") / 1000).alias("b"), "lines")
    f = stats.wls_fit(s, ["supp"], "qty", ["a", "b"], "lines").filter("coefficients is not null")
    c, e = (lambda i: F.get("coefficients", F.lit(i))), (lambda i: F.get("errors", F.lit(i)))
    return rounded(f.select("supp", "n", F.round(c(0), 3).alias("intercept"), F.round(c(1), 4).alias("year_slope"), F.round(c(2), 4).alias("revenue_slope"), F.round(e(0), 3).alias("intercept_error"), F.round(e(1), 4).alias("year_error"), F.round(e(2), 4).alias("revenue_error")))


@book.query(f"""WITH RECURSIVE {GAMES}, g AS (SELECT a, b, m, CASE WHEN l_orderkey % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS h FROM games), e AS (SELECT a, b, m, h FROM g UNION ALL SELECT b, a, -m, -h FROM g),
q AS (SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT a, count(*) AS games, sum(m) AS s, sum(h) AS h FROM e GROUP BY 1), z AS (SELECT sum(h * m) AS s, sum(h) + 1 AS w FROM g),
r AS (SELECT a, 0.0::DOUBLE AS r, 0.0::DOUBLE AS v, 0 AS i FROM t UNION ALL
 SELECT a, r - avg(r) OVER () AS r, v, i FROM (SELECT t.a, (t.s - t.h * x.v + x.near) / (t.games + 1) AS r, x.v2 AS v, x.i + 1 AS i FROM t JOIN
  (SELECT q.a, sum(q.n * r.r) AS near, any_value(r.v) AS v, any_value(r.i) AS i, any_value(y.v2) AS v2 FROM q JOIN r ON r.a = q.b, (SELECT (any_value(z.s) - sum(t.h * r.r)) / any_value(z.w) AS v2 FROM r JOIN t USING (a), z) y WHERE r.i < 400 GROUP BY q.a) x USING (a))),
f AS (SELECT a, r, games FROM r JOIN t USING (a) WHERE i = 400 AND games >= 10) SELECT a AS team, round(r - avg(r) OVER (), 3) AS r, games FROM f""")
def ridge_ratings(spark, d):
    """Ridge ratings with a home advantage; the SQL comes to them by four hundred plain rounds."""
    g = _games(spark, d).withColumn("neutral", F.col("l_orderkey") % 4 == 0)
    return rounded(stats.ridge_ratings(g, "a", "b", "m", "neutral"), 3)


@book.query("WITH g AS (SELECT user_id, value, ts, event_id FROM events), r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM g) SELECT user_id, any_value(n) AS n, round(max(value) FILTER (k <= n - k + 1), 6) AS first_half_best FROM r GROUP BY 1")
def grouped_function(spark, d):
    """A function of a group's rows, on groups of bounded size (one user)."""
    import pyarrow.compute as pc

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ts", "ascending"), ("event_id", "ascending")])
        half = (t.num_rows + 1) // 2
        best = pc.max(t["value"].slice(0, half)).as_py()
        return pa.table({"user_id": t["user_id"].slice(0, 1), "n": pa.array([t.num_rows], pa.int64()), "first_half_best": pa.array([best], pa.float64())})

    e = table(spark, d, "events", ["user_id", "ts", "event_id", "value"])
    return rounded(stats.by_group(e, ["user_id"], work, "user_id long, n long, first_half_best double"))


@book.query("""WITH s AS (SELECT vendor_id, amount, quantity FROM sale_lines WHERE amount IS NOT NULL AND quantity IS NOT NULL AND quantity > 0), m AS (SELECT vendor_id, count(*) AS n, sum(quantity) AS w, sum(quantity * amount) / sum(quantity) AS mean FROM s GROUP BY 1),
v AS (SELECT vendor_id, sum(quantity * (amount - mean) ** 2) AS ss FROM s JOIN m USING (vendor_id) GROUP BY 1), r AS (SELECT vendor_id, amount, row_number() OVER (PARTITION BY vendor_id ORDER BY amount DESC) AS k FROM s), t AS (SELECT vendor_id, sum(amount) AS top FROM r WHERE k <= 10 GROUP BY 1)
SELECT vendor_id, n, round(mean, 4) AS mean, round(sqrt(ss / w), 4) AS sd, round(top, 2) AS top_ten FROM m JOIN v USING (vendor_id) JOIN t USING (vendor_id)""")
def grouped_function_in_parts(spark, d):
    """Weighted mean, deviation and best ten of each vendor's lines; a vendor with a third of all rows is many tasks."""
    import numpy as np

    def partial(t: pa.Table) -> pa.Table:
        x, w = t["amount"].to_numpy(), t["quantity"].to_numpy().astype(float)
        mean = (w * x).sum() / w.sum()
        top = np.sort(x)[::-1][:10]
        return pa.table({"vendor_id": t["vendor_id"].slice(0, 1), "n": [len(x)], "w": [w.sum()], "mean": [mean], "ss": [(w * (x - mean) ** 2).sum()], "top": pa.array([top.tolist()], pa.list_(pa.float64()))})

    def final(t: pa.Table) -> pa.Table:
        w, mean = t["w"].to_numpy(), t["mean"].to_numpy()
        all_ = (w * mean).sum() / w.sum()
        ss = (t["ss"].to_numpy() + w * (mean - all_) ** 2).sum()
        top = np.sort(np.concatenate([np.asarray(x) for x in t["top"].to_pylist()]))[::-1][:10]
        return pa.table({"vendor_id": t["vendor_id"].slice(0, 1), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "mean": [all_], "sd": [float(np.sqrt(ss / w.sum()))], "top_ten": [float(top.sum())]})

    s = table(spark, d, "sale_lines", ["vendor_id", "amount", "quantity"]).filter("amount is not null and quantity > 0")
    out = stats.by_group_in_parts(s, ["vendor_id"], partial, "vendor_id long, n long, w double, mean double, ss double, top array<double>", final, "vendor_id long, n long, mean double, sd double, top_ten double", part_rows=4096)
    return out.select("vendor_id", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("top_ten", 2).alias("top_ten"))


@book.query(f"WITH {MEMBERS}, x AS (SELECT v.*, c_nationkey FROM v JOIN customer ON entity = c_custkey), r AS (SELECT c_nationkey, {rank_sql('value', 'cohort', True)} AS t, {rank_sql('entity', 'cohort')} AS p FROM x) SELECT c_nationkey::BIGINT AS c_nationkey, round(avg(t - p), 6) AS gain FROM r GROUP BY 1")
def rank_gain_by_group(spark, d):
    """A mean over a group of what only the whole cohort can say of a row; the column comes first."""
    x = member_values(spark, d).join(table(spark, d, "customer", ["c_custkey", "c_nationkey"]), F.col("entity") == F.col("c_custkey"))
    r = windows.ranked(x.withColumn("down", -F.col("value")), ["cohort"], {"t": "down", "p": "entity"})
    return rounded(r.groupBy("c_nationkey").agg(F.avg(F.col("t") - F.col("p")).alias("gain")))


@book.query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS b FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)) SELECT coalesce(c_nationkey::VARCHAR, 'all') AS nation, coalesce(c_mktsegment, 'all') AS segment, n, b AS balance FROM c""")
def grouping_cube(spark, d):
    """All grouping sets of two columns."""
    g = table(spark, d, "customer").cube("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return g.select(F.coalesce(F.col("c_nationkey").cast("string"), F.lit("all")).alias("nation"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n", "balance")


@book.query("WITH g AS (SELECT c_custkey, sum(l_quantity) AS a, count(*)::DOUBLE AS b FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey, round(a / b, 6) AS ratio, round(abs(a / b) * sqrt(1 / greatest(a, 1) + 1 / b), 6) AS se FROM g")
def ratio_error(spark, d):
    """The delta-method error of a ratio of two counts."""
    l = table(spark, d, "lineitem", ["l_orderkey", "l_quantity"]).join(table(spark, d, "orders", ["o_orderkey", "o_custkey"]), F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    g = l.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("l_quantity").alias("a"), F.count("*").cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rounded(g.select("c_custkey", (a / b).alias("ratio"), F.when(b > 0, F.abs(a / b) * F.sqrt(1 / F.greatest(a, F.lit(1.0)) + 1 / b)).alias("se")))


# -- reshaping for reports -----------------------------------------------------------------


@book.query("""WITH g AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT 'n' AS "column", max(n) FILTER (k = '1-URGENT') AS urgent, max(n) FILTER (k = '5-LOW') AS low FROM g UNION ALL SELECT 'total', max(total) FILTER (k = '1-URGENT'), max(total) FILTER (k = '5-LOW') FROM g""")
def transposed_report(spark, d):
    """X8."""
    g = table(spark, d, "orders", ["o_orderpriority", "o_totalprice"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return stats.transposed(g, "o_orderpriority", ["n", "total"], ["1-URGENT", "5-LOW"]).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@book.query("""WITH c AS (SELECT c_nationkey AS n, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer), s AS (SELECT s_nationkey AS n, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier)
SELECT coalesce(c.n, s.n)::BIGINT AS n, coalesce(c.place, s.place) AS place, c_custkey, s_suppkey FROM c FULL JOIN s ON c.n = s.n AND c.place = s.place""")
def side_by_side_places(spark, d):
    """Two tables by their places in an order."""
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]).withColumnRenamed("c_nationkey", "n")
    s = table(spark, d, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).withColumnRenamed("s_nationkey", "n")
    return rounded(stats.beside(c, s, [F.desc("c_acctbal"), F.col("c_custkey")], [F.desc("s_acctbal"), F.col("s_suppkey")], ["n"]).select("n", "place", "c_custkey", "s_suppkey"))


@book.query("SELECT o_custkey, array_to_string(list_distinct_ordered, ',') AS order_, len(list_distinct_ordered)::BIGINT AS n FROM (SELECT o_custkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l FROM orders GROUP BY 1))")
def ordered_distinct(spark, d):
    """Distinct elements in the order in which they first stand."""
    g = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderpriority"]).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))  # one customer's orders
    out = lists.ordered_distinct(F.col("l.o_orderpriority"))
    return rounded(g.select("o_custkey", F.array_join(out, ",").alias("order_"), F.size(out).alias("n")))


@book.query("SELECT s_suppkey AS key, s_nationkey::BIGINT AS league, round(s_acctbal / 100, 4) AS rate, s_acctbal > 5000 AS good FROM supplier")
def frame_from_columns(spark, d):
    """A table from named columns."""
    s = table(spark, d, "supplier")
    made = {"key": F.col("s_suppkey"), "league": F.col("s_nationkey"), "rate": F.round(F.col("s_acctbal") / 100, 4), "good": F.col("s_acctbal") > 5000}
    return rounded(s.select(*(c.alias(n) for n, c in made.items())), 4)


@book.query("""WITH x AS (SELECT o_custkey AS team, o_orderkey % 7 AS a, o_orderkey % 5 AS m, o_orderkey % 3 AS v, o_orderkey % 11 AS p, o_orderkey % 13 AS q, o_orderkey % 2 = 0 AS first_round FROM orders WHERE o_orderkey % 9 <> 0),
c AS (SELECT *, CASE WHEN a < m OR p = q THEN 'agreed' WHEN v = 0 THEN 'ours' WHEN v = 1 THEN 'theirs' ELSE 'tie' END AS c FROM x)
SELECT team, count(*) AS cards, count(*) FILTER (c = 'agreed') AS agreed, count(*) FILTER (c = 'ours') AS ours, count(*) FILTER (c = 'theirs') AS theirs, count(*) FILTER (c = 'tie') AS ties, count(*) FILTER (c = 'agreed' AND first_round) AS agreed_first FROM c GROUP BY 1""")
def recount_with_agreed(spark, d):
    """Cards where both would have chosen alike count for neither side."""
    k = F.col("o_orderkey")
    x = table(spark, d, "orders", ["o_orderkey", "o_custkey"]).filter(k % 9 != 0).withColumnRenamed("o_custkey", "team")
    c = F.when((k % 7 < k % 5) | (k % 11 == k % 13), "agreed").when(k % 3 == 0, "ours").when(k % 3 == 1, "theirs").otherwise("tie")
    n = lambda v, more=F.lit(True): F.count_if((F.col("c") == v) & more)
    return x.withColumn("c", c).groupBy("team").agg(F.count("*").alias("cards"), n("agreed").alias("agreed"), n("ours").alias("ours"), n("theirs").alias("theirs"), n("tie").alias("ties"), n("agreed", k % 2 == 0).alias("agreed_first"))


# -- causal translations and totals --------------------------------------------------------


@book.query(f"""WITH {SUPPLIER_YEARS}, p AS (SELECT a.supp, b.year AS season, a.qty AS x, b.qty AS y FROM s a JOIN s b ON b.supp = a.supp AND b.year = a.year + 1),
g AS (SELECT season, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, count(*) AS n FROM p GROUP BY 1), h AS (SELECT season, sum(sx) OVER w AS sx, sum(sxx) OVER w + 1 AS sxx, sum(sy) OVER w AS sy, sum(sxy) OVER w AS sxy, sum(n) OVER w + 1 AS n FROM g WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT season, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS a FROM h WHERE n > 20)
SELECT supp, season, round(a + b * x, 3) AS gl_pred, round(y, 4) AS gl_own FROM p JOIN f USING (season)""")
def second_league_translation(spark, d):
    """What a line in one league became in the next, learnt from earlier pairs only, beside the own line."""
    s = supplier_years(spark, d)
    old = s.select("supp", (F.col("year") + 1).alias("season"), F.col("qty").alias("x"))
    p = s.select("supp", F.col("year").alias("season"), F.col("qty").alias("y")).join(old, ["supp", "season"])
    enough = p.groupBy("season").agg(F.count("*").alias("n")).select("season", F.coalesce(F.sum("n").over(windows.before([F.lit(1)], F.col("season"))), F.lit(0)).alias("known")).filter("known >= 20")  # seasons, not rows
    scored = models.causal_scores(p, ["x"], "y", "season").join(enough, "season", "left_semi")
    return rounded(scored.select("supp", "season", F.round("score", 3).alias("gl_pred"), F.round("y", 4).alias("gl_own")))


@book.query("""WITH l AS (SELECT l_suppkey, year(l_shipdate)::BIGINT AS season, l_orderkey, sum(l_extendedprice) AS v, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, season ORDER BY v DESC, l_orderkey) AS best, row_number() OVER (PARTITION BY l_suppkey, season ORDER BY l_orderkey DESC) AS late FROM l)
SELECT l_suppkey, season, count(*) AS games, round(avg(v), 2) AS mean, round(avg(v) FILTER (best <= 5), 2) AS top5, round(avg(v) FILTER (best > 5), 2) AS rest, round(avg(v) FILTER (late <= 5) - avg(v) FILTER (late > 5), 2) AS form, round(sum(v) / nullif(sum(q), 0), 4) AS per_unit FROM r GROUP BY 1, 2""")
def season_box(spark, d):
    """A season's totals with the best games, the last ones and the rest side by side."""
    l = table(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_orderkey", "l_extendedprice", "l_quantity"])  # noqa: E741
    g = l.groupBy("l_suppkey", F.year("l_shipdate").alias("season"), "l_orderkey").agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    by = ["l_suppkey", "season"]
    r = g.withColumns({"best": windows.ordinal(by, F.desc("v"), F.col("l_orderkey")), "late": windows.ordinal(by, F.desc("l_orderkey"))})
    mean = lambda c: F.avg(F.when(c, F.col("v")))
    out = r.groupBy(*by).agg(F.count("*").alias("games"), F.avg("v").alias("mean"), mean(F.col("best") <= 5).alias("top5"), mean(F.col("best") > 5).alias("rest"), (mean(F.col("late") <= 5) - mean(F.col("late") > 5)).alias("form"), F.round(stats.ratio("v", "q"), 4).alias("per_unit"))
    return rounded(out.withColumns({c: F.round(c, 2) for c in ("mean", "top5", "rest", "form")}), 4)


@book.query("""WITH k AS (SELECT c_custkey AS key, 1 AS k_listed FROM customer WHERE c_acctbal > 5000), s AS (SELECT DISTINCT o_custkey AS key, 1 AS s_listed FROM orders WHERE o_totalprice > 200000) SELECT c_custkey AS key, coalesce(k_listed, 0)::BIGINT AS k_listed, coalesce(s_listed, 0)::BIGINT AS s_listed FROM customer LEFT JOIN k ON k.key = c_custkey LEFT JOIN s ON s.key = c_custkey""")
def key_only_sources(spark, d):
    """Sources of which only membership counts."""
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select(F.col("c_custkey").alias("key"), "c_acctbal")
    listed = table(spark, d, "orders", ["o_custkey", "o_totalprice"]).filter("o_totalprice > 200000").select(F.col("o_custkey").alias("key")).distinct().withColumn("s_listed", F.lit(1))
    return rounded(c.withColumn("k_listed", (F.col("c_acctbal") > 5000).cast("int")).join(listed, "key", "left").select("key", F.coalesce("k_listed", F.lit(0)).alias("k_listed"), F.coalesce("s_listed", F.lit(0)).alias("s_listed")))


@book.query("""WITH l AS (SELECT o_custkey AS k, o_orderpriority AS t, o_totalprice AS p, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE year(o_orderdate) <= 1998), g AS (SELECT k, count(*) FILTER (t LIKE '1%') AS pro, sum(p) FILTER (t LIKE '1%') AS pro_p, max(p) FILTER (t LIKE '2%' AND r = 1) AS camp_last, count(*) FILTER (t LIKE '3%') AS ngt, count(DISTINCT year(d)) AS years FROM l GROUP BY 1)
SELECT k, (pro > 0)::BIGINT AS i_has_pro, pro AS i_pro_n, round(pro_p / nullif(pro, 0), 4) AS i_pro_mean, round(camp_last, 4) AS i_camp_last, ngt AS i_ngt_n, years AS i_years FROM g""")
def international_lines(spark, d):
    """Several kinds of events of a person before a cutoff, side by side, from one pass."""
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate"]).filter(F.year("o_orderdate") <= 1998)
    kind = lambda n: F.col("o_orderpriority").startswith(n)
    last = F.max(F.when(kind("2"), F.struct("o_orderdate", "o_orderkey", "o_totalprice")))
    g = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(kind("1")).alias("i_pro_n"), F.sum(F.when(kind("1"), F.col("o_totalprice"))).alias("p"), last.alias("c"), F.count_if(kind("3")).alias("i_ngt_n"), F.count_distinct(F.year("o_orderdate")).alias("i_years"))
    return rounded(g.select("k", (F.col("i_pro_n") > 0).cast("int").alias("i_has_pro"), "i_pro_n", nulls.sdiv("p", "i_pro_n").alias("i_pro_mean"), F.col("c.o_totalprice").alias("i_camp_last"), "i_ngt_n", "i_years"), 4)
