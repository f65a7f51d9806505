"""Growth, latent shares, last lines abroad, use and rates, mates over games, values of compared persons."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions import keys
from orderloom.operators import careers, context, facts, pit
from orderloom.plans.base import Book, rounded
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql


def _growth_sql() -> str:
    slope = lambda m: f"CASE WHEN count({m}) >= 2 THEN (sum(w) FILTER ({m} IS NOT NULL) * sum(w * x * {m}) - sum(w * x) FILTER ({m} IS NOT NULL) * sum(w * {m})) / nullif(sum(w) FILTER ({m} IS NOT NULL) * sum(w * x * x) FILTER ({m} IS NOT NULL) - pow(sum(w * x) FILTER ({m} IS NOT NULL), 2), 0) END"
    of = lambda m, place, k: f"max({m}) FILTER ({place} = {k})"
    own = ", ".join(f"{slope(m)} AS {m}_slope, {of(m, 'f', 1)} AS {m}_first, CASE WHEN count(*) >= 2 THEN {of(m, 'l', 1)} - {of(m, 'f', 1)} END AS {m}_gain, {of(m, 'l', 1)} - 2 * {of(m, 'l', 2)} + {of(m, 'l', 3)} AS {m}_bend" for m in ("level", "best"))
    out = ", ".join(f"round({m}_slope, 5) AS {m}_slope, round({m}_population, 5) AS {m}_population, round(n / (n + 2.0) * {m}_slope + 2 / (n + 2.0) * {m}_population, 5) AS {m}_shrunk, round({m}_first, 5) AS {m}_first, round({m}_gain, 5) AS {m}_gain, round({m}_bend, 5) AS {m}_bend" for m in ("level", "best"))
    return f"""WITH s AS (SELECT o_custkey AS who, year(o_orderdate)::BIGINT AS year, count(*)::DOUBLE AS w, sqrt(avg(o_totalprice)) AS level, sqrt(max(o_totalprice)) AS top FROM orders GROUP BY 1, 2), p AS (SELECT c_custkey AS who, 1994 + c_custkey % 5 AS cutoff FROM customer),
c AS (SELECT who, cutoff, year - cutoff AS x, w, level, CASE WHEN (who + year) % 5 <> 0 THEN top END AS best, row_number() OVER (PARTITION BY who ORDER BY year) AS f, row_number() OVER (PARTITION BY who ORDER BY year DESC) AS l FROM s JOIN p USING (who) WHERE year <= cutoff),
g AS (SELECT who, cutoff, count(*) AS n, {own} FROM c GROUP BY 1, 2), k AS (SELECT a.cutoff, avg(b.level_slope) AS level_population, avg(b.best_slope) AS best_population FROM (SELECT DISTINCT cutoff FROM g) a LEFT JOIN g b ON b.cutoff < a.cutoff GROUP BY 1)
SELECT who, cutoff, n, {out} FROM g JOIN k USING (cutoff)"""


@book.query(_growth_sql())
def career_development(spark, d):
    """Slopes over a career's seasons, drawn to what earlier classes had, first seasons and bends."""
    o = table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    s = o.groupBy(F.col("o_custkey").alias("who"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("w"), F.sqrt(F.avg("o_totalprice")).alias("level"), F.sqrt(F.max("o_totalprice")).alias("top"))
    s = s.withColumn("best", F.when((F.col("who") + F.col("year")) % 5 != 0, F.col("top")))
    p = table(spark, d, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("who"), (F.col("c_custkey") % 5 + 1994).alias("cutoff"))
    x = careers.development(s, p, "who", "year", "cutoff", ["level", "best"], "w")
    return rounded(x.select("who", "cutoff", "n", *(f"{m}_{c}" for m in ("level", "best") for c in ("slope", "population", "shrunk", "first", "gain", "bend"))), 5)


_ROLE = "CASE WHEN {0} % 11 <> 0 THEN {0} % 3 END"


def _latent_sql() -> str:
    prior = lambda by: f"SELECT {by}, count(*) AS n, avg(p) AS m, var_samp(p) - avg(p) * (1 - avg(p)) * avg(1.0 / tried) AS v FROM q GROUP BY {by} HAVING count(*) >= 30"
    worth = "greatest(2, least(500, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 500 END))"
    return f"""WITH s AS (SELECT l_suppkey AS supp, year(l_shipdate)::BIGINT AS year, {_ROLE.format("l_suppkey")} AS role, count(*) FILTER (l_quantity > 20 + l_suppkey % 7) AS made, count(*) AS tried FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT s_suppkey AS supp, 1993 + s_suppkey % 7 AS cutoff, {_ROLE.format("s_suppkey")} AS role FROM supplier), q AS (SELECT cutoff, role, made / tried::DOUBLE AS p, tried FROM (SELECT DISTINCT cutoff FROM p) JOIN s ON year < cutoff WHERE tried >= 20),
r AS ({prior("cutoff, role")}), a AS ({prior("cutoff")}), t AS (SELECT supp, cutoff, p.role, sum(made)::BIGINT AS made, sum(tried)::BIGINT AS tried FROM p JOIN s USING (supp) WHERE year <= cutoff GROUP BY 1, 2, 3),
x AS (SELECT t.*, r.m IS NOT NULL AS from_role, coalesce(r.m, a.m) AS mean, coalesce(r.w, a.w) AS worth FROM t LEFT JOIN (SELECT *, {worth} AS w FROM r) r ON r.cutoff = t.cutoff AND r.role = t.role LEFT JOIN (SELECT *, {worth} AS w FROM a) a ON a.cutoff = t.cutoff)
SELECT supp, cutoff, role, made, tried, from_role, round(mean, 5) AS mean, round(worth, 2) AS worth, round(CASE WHEN tried > 0 THEN (made + mean * worth) / (tried + worth) END, 5) AS share FROM x"""


@book.query(_latent_sql())
def latent_shares(spark, d):
    """Career shares under beta priors of the role, learnt from earlier seasons, those of all where a role is rare or unknown."""
    k, role = F.col("l_suppkey"), lambda c: F.when(F.col(c) % 11 != 0, F.col(c) % 3)
    l = table(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"])  # noqa: E741
    s = l.groupBy(k.alias("supp"), F.year("l_shipdate").alias("year")).agg(F.count_if(F.col("l_quantity") > 20 + k % 7).alias("made"), F.count("*").alias("tried")).withColumn("role", role("supp"))
    p = table(spark, d, "supplier", ["s_suppkey"]).select(F.col("s_suppkey").alias("supp"), (F.col("s_suppkey") % 7 + 1993).cast("int").alias("cutoff"), role("s_suppkey").alias("role"))
    x = careers.latent_shares(s, p, "supp", "year", "cutoff", "role", "made", "tried")
    return rounded(x.withColumn("worth", F.round("worth", 2)), 5)


@book.query("""WITH s AS (SELECT client_id AS who, month(sold_at)::BIGINT AS season, 'p' || priority AS league, max(priority % 3) AS level, count(*) AS g, coalesce(sum(total), 0) AS mp, count(*) FILTER (status = 'done') AS pts FROM sales WHERE sold_at IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT client_id AS who, 3 + client_id % 4 AS cutoff FROM clients), w AS (SELECT * FROM s JOIN p USING (who) WHERE season BETWEEN cutoff - 1 AND cutoff), t AS (SELECT *, max(season) OVER (PARTITION BY who) AS last FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY mp DESC, level DESC NULLS LAST, league DESC NULLS LAST) AS a, row_number() OVER (PARTITION BY who ORDER BY level DESC NULLS LAST, mp DESC, league DESC NULLS LAST) AS b FROM t WHERE season = last)
SELECT who, any_value(cutoff) AS cutoff, any_value(season) AS season, any_value(cutoff) - any_value(season) AS gap, count(*) AS leagues, max(league) FILTER (a = 1) AS main, (max(level) FILTER (a = 1))::BIGINT AS main_level, max(league) FILTER (b = 1) AS top, (max(level) FILTER (b = 1))::BIGINT AS top_level,
sum(g)::BIGINT AS games, round(sum(mp) / sum(g), 4) AS per_game, round(36.0 * max(pts) FILTER (a = 1) / nullif(max(mp) FILTER (a = 1), 0), 4) AS main_pts, round(36.0 * max(pts) FILTER (b = 1) / nullif(max(mp) FILTER (b = 1), 0), 4) AS top_pts, round(36.0 * sum(pts) / nullif(sum(mp), 0), 4) AS all_pts FROM r GROUP BY 1""")
def last_lines_abroad(spark, d):
    """The last season before a cutoff in any league, by its main and its highest league."""
    s = table(spark, d, "sales", ["client_id", "sold_at", "priority", "total", "status"]).filter("sold_at is not null")
    s = s.select(F.col("client_id").alias("who"), F.month("sold_at").alias("season"), F.concat(F.lit("p"), "priority").alias("league"), (F.col("priority") % 3).alias("level"), F.lit(1).alias("g"), F.col("total").alias("mp"), (F.col("status") == "done").cast("int").alias("pts"))
    p = table(spark, d, "clients", ["client_id"]).distinct().select(F.col("client_id").alias("who"), (F.col("client_id") % 4 + 3).alias("cutoff"))
    lines = s.groupBy("who", "season", "league").agg(F.max("level").alias("level"), F.sum("g").alias("g"), F.sum("mp").alias("mp"), F.coalesce(F.sum("pts"), F.lit(0)).alias("pts"))  # before the join: a client's sales combine first
    return rounded(careers.last_lines(lines, p, "who", "season", "cutoff", "league", "level", "g", "mp", {"pts": "pts"}, span=1), 4)


_GS = "sum(w * {0} * {1}) OVER g / sum(w * {0} * {0}) OVER g"


@book.query(f"""WITH k AS (SELECT year(l_shipdate)::BIGINT AS year, l_suppkey AS supp, l_extendedprice / 1000 AS y, l_discount * 100 AS u, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_tax * 100 END AS c, (l_linenumber % 2)::DOUBLE AS h, l_quantity AS w, l_orderkey FROM lineitem),
m AS (SELECT year, supp, w, {', '.join(f'{x} - sum(w * {x}) OVER g / sum(w) OVER g AS {x}1' for x in 'yuch')} FROM k WHERE l_orderkey % 13 <> 0 AND w > 0 WINDOW g AS (PARTITION BY year, supp)), n AS (SELECT *, h1 - c1 * {_GS.format('c1', 'h1')} AS h2 FROM m WINDOW g AS (PARTITION BY year, supp)),
o AS (SELECT *, u1 - c1 * {_GS.format('c1', 'u1')} - h2 * {_GS.format('h2', 'u1')} AS u3 FROM n WINDOW g AS (PARTITION BY year, supp)), f AS (SELECT year, supp, count(*) AS n, sum(w * u3 * y1) / sum(w * u3 * u3) AS slope, sum(w * u3 * u3) AS uu, sum(w * y1 * y1) - pow(sum(w * c1 * y1), 2) / sum(w * c1 * c1) - pow(sum(w * h2 * y1), 2) / sum(w * h2 * h2) - pow(sum(w * u3 * y1), 2) / sum(w * u3 * u3) AS rest FROM o GROUP BY 1, 2),
e AS (SELECT year, supp, n, CASE WHEN n >= 6 THEN slope END AS slope, CASE WHEN n >= 6 THEN sqrt(greatest(rest, 0) / (n - 4) / uu) END AS error FROM f), g AS (SELECT year, supp FROM k GROUP BY 1, 2 HAVING count(*) >= 15 AND avg(w) >= 12), r AS (SELECT e.* FROM e JOIN g USING (year, supp) WHERE slope IS NOT NULL), q AS (SELECT year, quantile_cont(slope, 0.01) AS lo, quantile_cont(slope, 0.99) AS hi FROM r GROUP BY 1),
p AS (SELECT year, sum(n * greatest(lo, least(hi, slope))) / sum(n) AS population FROM r JOIN q USING (year) GROUP BY 1)
SELECT year, supp, n, round(slope, 4) AS slope, round(error, 4) AS error, round(population, 4) AS population, round(n / (n + 30.0) * slope + 30 / (n + 30.0) * population, 4) AS shrunk FROM e LEFT JOIN p USING (year)""")
def use_elasticity(spark, d):
    """How a rate moves with use within a person's season, beside the regulars' mean."""
    k = F.col("l_orderkey")
    l = table(spark, d, "lineitem", ["l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_quantity"])  # noqa: E741
    g = l.select(F.year("l_shipdate").cast("long").alias("year"), F.col("l_suppkey").alias("supp"), F.when(k % 13 != 0, F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("u"), F.when(k % 3 != 0, F.col("l_tax") * 100).alias("c"), (F.col("l_linenumber") % 2).alias("h"), F.col("l_quantity").alias("w"))
    return rounded(careers.elasticity(g, ["year"], "supp", "y", "u", ["c", "h"], "w"), 4)


@book.query("""WITH r AS (SELECT sale_id, vendor_id, sum(quantity)::DOUBLE AS m, coalesce(sum(quantity) FILTER (balance IS NOT NULL AND vendor_id % 5 <> 0), 0)::DOUBLE AS k, coalesce(sum(quantity * balance) FILTER (vendor_id % 5 <> 0), 0) AS r, coalesce(sum(amount), 0) AS amount, coalesce(sum(discount), 0) AS discount FROM sale_lines LEFT JOIN vendors USING (vendor_id) WHERE quantity > 0 GROUP BY 1, 2),
t AS (SELECT sale_id, sum(m) AS tm, sum(k) AS tk, sum(r) AS tr, sum(amount) AS ta, sum(discount) AS td FROM r GROUP BY 1)
SELECT vendor_id, count(*) AS games, sum(m) AS minutes, round(CASE WHEN sum(tk - k) > 0 THEN sum(tr - r) / sum(tk - k) END, 3) AS mates_rating, round(CASE WHEN sum(tm - m) > 0 THEN sum(tk - k) / sum(tm - m) END, 6) AS mates_known, round(sum(amount) / nullif(sum(ta), 0), 6) AS amount_share, round(sum(discount) / nullif(sum(td), 0), 6) AS discount_share FROM r JOIN t USING (sale_id) GROUP BY 1""")
def mates_over_games(spark, d):
    """The others over the games that one played, by minutes, and the own part of what the side did."""
    v = table(spark, d, "vendors", ["vendor_id", "balance"]).select("vendor_id", F.when(F.col("vendor_id") % 5 != 0, F.col("balance")).alias("rating"))
    l = table(spark, d, "sale_lines", ["sale_id", "vendor_id", "quantity", "amount", "discount"]).join(v, "vendor_id", "left")  # noqa: E741
    x = careers.mates_over_games(l, ["sale_id"], "vendor_id", "quantity", "rating", ["amount", "discount"])
    return rounded(x.withColumn("mates_rating", F.round("mates_rating", 3)))


@book.query("""WITH n AS (SELECT lower(name) AS name, min(client_id) AS compared FROM clients WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT client_id) = 1), t AS (SELECT a.client_id, 2 + a.client_id % 4 AS cutoff, lower(trim(b.name)) AS name FROM clients a LEFT JOIN clients b ON b.client_id = a.client_id // 2),
y AS (SELECT client_id AS compared, month(sold_at)::BIGINT AS month, sum(total) AS v FROM sales WHERE sold_at IS NOT NULL GROUP BY 1, 2), j AS (SELECT client_id, cutoff, n.compared FROM t LEFT JOIN n USING (name))
SELECT client_id, cutoff, compared, (SELECT round(avg(v), 4) FROM y WHERE y.compared = j.compared AND y.month < j.cutoff) AS compared_value FROM j""")
def compared_values(spark, d):
    """What the person that a text compares someone to had been worth by then; names of several persons are nobody's."""
    c = table(spark, d, "clients", ["client_id", "name"])
    other = c.select(F.col("client_id").alias("_o"), "name")
    text = F.concat(F.lit("A poor man's "), "name", F.lit(" (late) / others"))
    t = c.select("client_id").join(other, F.floor(F.col("client_id") / 2) == F.col("_o"), "left").select("client_id", (F.col("client_id") % 4 + 2).alias("cutoff"), F.lower(keys.comparison(text)).alias("key"))
    s = table(spark, d, "sales", ["client_id", "sold_at", "total"]).filter("sold_at is not null").withColumn("month", F.month("sold_at").cast("long"))
    x = careers.compared_values(t, c.withColumn("name", F.lower("name")), s, "key", "name", "client_id", "month", "total", "cutoff")
    return rounded(x.select("client_id", "cutoff", "compared", "compared_value"), 4)


# -- persons of other lists and their events -----------------------------------------------

_PERSONS = """c AS (SELECT client_id, min(name) AS full_name, min(master_id) AS m FROM clients WHERE client_id IS NOT NULL GROUP BY 1), v AS (SELECT client_id, 3 + client_id % 3 AS cutoff, lower(split_part(full_name, ' ', 1)) AS a, lower(split_part(full_name, ' ', -1)) AS z, DATE '1999-01-01' + (m * 53 % 2000)::INT AS born FROM c),
p AS (SELECT client_id AS who, cutoff, a || ' ' || z AS name, z AS last, CASE WHEN client_id % 4 <> 0 THEN born END AS birth FROM v), f AS (SELECT client_id, min(month(sold_at))::BIGINT AS first FROM sales GROUP BY 1),
r AS (SELECT client_id AS record, CASE WHEN client_id % 5 = 0 THEN z || ' ' || a ELSE a || ' ' || z END AS name, CASE WHEN client_id % 5 = 0 THEN a || ' ' || z ELSE z || ' ' || a END AS reversed, CASE WHEN client_id % 7 <> 0 THEN z END AS last, CASE WHEN client_id % 6 <> 0 THEN born END AS birth, first FROM v JOIN f USING (client_id)),
n AS (SELECT DISTINCT who, record FROM p JOIN r ON p.name = r.name OR p.name = r.reversed WHERE CASE WHEN p.birth IS NULL THEN cutoff - first BETWEEN 0 AND 1 ELSE r.birth IS NULL OR abs(p.birth - r.birth) <= 366 END),
k AS (SELECT who, record FROM n UNION ALL SELECT who, record FROM p JOIN r ON r.last = p.last AND r.birth = p.birth WHERE who NOT IN (SELECT who FROM n))"""


def _listed(spark, d):
    """Persons, and records of another list in which every fifth name stands last name first."""
    c = table(spark, d, "clients", ["client_id", "name", "master_id"]).filter("client_id is not null").groupBy("client_id").agg(F.min("name").alias("full_name"), F.min("master_id").alias("m"))
    k, words = F.col("client_id"), F.split("full_name", " ")
    a, z = F.lower(F.get(words, F.lit(0))), F.lower(F.element_at(words, -1))
    straight, turned = F.concat(a, F.lit(" "), z), F.concat(z, F.lit(" "), a)
    born = F.date_add(F.lit("1999-01-01").cast("date"), (F.col("m") * 53 % 2000).cast("int"))
    p = c.select(k.alias("who"), (k % 3 + 3).alias("cutoff"), straight.alias("name"), z.alias("last"), F.when(k % 4 != 0, born).alias("birth"))
    first = table(spark, d, "sales", ["client_id", "sold_at"]).groupBy("client_id").agg(F.min(F.month("sold_at")).alias("first"))
    r = c.join(first, "client_id").select(k.alias("record"), F.when(k % 5 == 0, turned).otherwise(straight).alias("name"), F.when(k % 5 == 0, straight).otherwise(turned).alias("reversed"), F.when(k % 7 != 0, z).alias("last"), F.when(k % 6 != 0, born).alias("birth"), "first")
    return p, r


@book.query(f"WITH {_PERSONS} SELECT who, record FROM k")
def person_identities(spark, d):
    """A person's records by name in either order and by birth date, by last name and date where no name fits."""
    p, r = _listed(spark, d)
    return careers.identities(p, r, "who", "cutoff", "record", "first", years=1)


_AGES = {"u16": ([15, 16], None), "u17_world": ([17], True), "u17_below": ([17], False), "u18": ([18], None)}


@book.query(f"""WITH {_PERSONS}, e AS (SELECT client_id AS record, year, year * 10 + priority AS competition, max(priority) % 4 + 1 AS level, max(priority) + 14 AS age, (client_id + year) % 9 + 1 AS rank, client_id % 2 = 0 AS listed, CASE WHEN max(priority) <> 4 THEN count(*) FILTER (status = 'done') END AS g, sqrt(abs(coalesce(sum(total), 0))) AS mp, count(*) AS pts, count(*) FILTER (status = 'open') AS trb, count(*) FILTER (status = 'done') AS fg, count(*) FILTER (status IS NOT NULL) AS fga FROM (SELECT *, month(sold_at)::BIGINT AS year FROM sales) WHERE sold_at IS NOT NULL AND priority IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT competition, bool_or(coalesce(g, 0) > 0) AS counted FROM e GROUP BY 1), t AS (SELECT k.who, e.*, coalesce(g, 0) > 0 AS played, row_number() OVER (PARTITION BY k.who, coalesce(g, 0) > 0 ORDER BY year DESC, level DESC, competition DESC, record DESC) AS o FROM k JOIN e USING (record) JOIN b USING (competition) JOIN p USING (who) WHERE year < cutoff AND (coalesce(g, 0) > 0 OR (NOT counted AND listed)))
SELECT who, count(DISTINCT record) AS ids, count(DISTINCT competition) AS events, max(level)::BIGINT AS max_level, min(year) AS first_year, max(year) AS last_year, min(rank) AS best_rank, max((age IN (15, 16))::INT)::BIGINT AS u16, max((age = 17 AND level = 4)::INT)::BIGINT AS u17_world, max((age = 17 AND level < 4)::INT)::BIGINT AS u17_below, max((age = 18)::INT)::BIGINT AS u18,
round(max(pts / g) FILTER (played), 5) AS best_ppg, (max(level) FILTER (played AND o = 1))::BIGINT AS last_level, (max(age) FILTER (played AND o = 1))::BIGINT AS last_age, max(g) FILTER (played AND o = 1) AS last_gp, round(max(mp / g) FILTER (played AND o = 1), 3) AS last_mpg, round(max(pts / g) FILTER (played AND o = 1), 5) AS last_ppg, round(max(36 * pts / nullif(mp, 0)) FILTER (played AND o = 1), 5) AS last_pts_36,
sum(g) FILTER (played)::DOUBLE AS i_gp, round(sum(mp) FILTER (played) / sum(g) FILTER (played), 3) AS i_mpg, round(sum(pts) FILTER (played) / sum(g) FILTER (played), 5) AS i_pts_pg, round(36 * sum(pts) FILTER (played) / nullif(sum(mp) FILTER (played), 0), 5) AS i_pts_36, round(sum(trb) FILTER (played) / sum(g) FILTER (played), 5) AS i_trb_pg, round(36 * sum(trb) FILTER (played) / nullif(sum(mp) FILTER (played), 0), 5) AS i_trb_36, round(36 * sum(fga) FILTER (played) / nullif(sum(mp) FILTER (played), 0), 5) AS i_fga_36, round(sum(fg) FILTER (played) / nullif(sum(fga) FILTER (played), 0), 5) AS i_fg_pct FROM t GROUP BY 1""")
def international_events(spark, d):
    """Youth events of a person's records before the cutoff: who took part, flags of ages, rates, the best and the last event."""
    p, r = _listed(spark, d)
    s = table(spark, d, "sales", ["client_id", "sold_at", "priority", "status", "total"]).filter("sold_at is not null and priority is not null").withColumn("year", F.month("sold_at").cast("long"))
    done, q = F.col("status") == "done", F.max("priority")
    e = s.groupBy(F.col("client_id").alias("record"), "year", (F.col("year") * 10 + F.col("priority")).alias("competition")).agg(
        (q % 4 + 1).alias("level"), (q + 14).alias("age"), F.when(q != 4, F.count_if(done)).alias("g"), F.sqrt(F.abs(F.coalesce(F.sum("total"), F.lit(0.0)))).alias("mp"), F.count("*").alias("pts"), F.count_if(F.col("status") == "open").alias("trb"), F.count_if(done).alias("fg"), F.count("status").alias("fga"),
    ).withColumns({"rank": (F.col("record") + F.col("year")) % 9 + 1, "listed": F.col("record") % 2 == 0})
    totals = ["pts", "trb", "fg", "fga"]
    links = careers.identities(p, r, "who", "cutoff", "record", "first", years=1)
    x = careers.youth_events(links, p, e, "who", "cutoff", "record", totals, _AGES)
    rates = facts.box_rates(totals, "i_")
    fixed = ["who", "ids", "events", "max_level", "first_year", "last_year", "best_rank", *_AGES, "best_ppg", "last_level", "last_age", "last_gp", F.round("last_mpg", 3).alias("last_mpg"), "last_ppg", "last_pts_36"]
    return rounded(x.select(*fixed, *(F.round(c, 3).alias(n) if n == "i_mpg" else c.alias(n) for n, c in rates.items())), 5)


@book.query("""WITH m AS (SELECT change_id, client_id, 2 + client_id % 4 AS cutoff, month(valid_at)::BIGINT AS month, seq, balance FROM client_changes WHERE client_id IS NOT NULL), l AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY month DESC, seq DESC NULLS LAST, change_id DESC) AS k FROM m WHERE month BETWEEN cutoff - 2 AND cutoff),
x AS (SELECT client_id, month, CASE WHEN change_id % 50 <> 0 THEN 60 + change_id % 20 ELSE 0 END::DOUBLE AS h, (64 + change_id % 23)::DOUBLE AS w, (96 + change_id % 17)::DOUBLE AS r, 180 + sqrt(abs(balance)) AS g, CASE WHEN change_id % 3 <> 0 THEN 4.0 + change_id % 9 END AS f, 8.25 + change_id % 3 AS hl, 9.5 + change_id % 2 AS hw, (25 + change_id % 11)::DOUBLE AS s, CASE WHEN change_id % 4 <> 0 THEN 30 + change_id % 13 END::DOUBLE AS v, (change_id % 8)::DOUBLE AS a1, CASE WHEN change_id % 5 <> 0 THEN change_id % 8 ELSE 0 END AS a2, CASE WHEN change_id % 5 <> 0 THEN 15 ELSE 0 END AS t2 FROM l WHERE k = 1)
SELECT client_id, month, round(w / nullif(h, 0), 6) AS wing_ratio, round(r / nullif(h, 0), 6) AS reach_ratio, round(hl / nullif(h, 0), 6) AS hand_length_ratio, round(hw / nullif(h, 0), 6) AS hand_width_ratio, round(g / nullif(h, 0), 4) AS weight_per_inch, round(703 * g / nullif(h * h, 0), 4) AS bmi_like, round(g * (1 - f / 100) / nullif(h, 0), 4) AS lean_ratio, v - s AS run_up_gain, r + v AS max_touch, r + s AS standing_touch, w - h AS wing_minus_height, r - h AS reach_minus_height,
(5 + (g IS NOT NULL)::INT + (f IS NOT NULL)::INT)::BIGINT AS measures, (1 + (v IS NOT NULL)::INT)::BIGINT AS drills, round((a1 + a2) / (10 + t2), 6) AS shoot_pct FROM x""")
def combine_measures(spark, d):
    """The last day of measuring within two months before a cutoff, with all that follows from its measures."""
    k = F.col("change_id")
    c = table(spark, d, "client_changes", ["change_id", "client_id", "valid_at", "seq", "balance"]).filter("client_id is not null").withColumns({"month": F.month("valid_at"), "cutoff": F.col("client_id") % 4 + 2})
    l = pit.latest_within(c, ["client_id"], "month", F.col("cutoff"), 2, [F.desc_nulls_last("seq"), F.desc("change_id")])  # noqa: E741
    none = F.lit(None).cast("double")
    x = l.withColumns({
        "h": F.when(k % 50 != 0, 60 + k % 20).otherwise(0), "w": 64 + k % 23, "r": 96 + k % 17, "g": 180 + F.sqrt(F.abs("balance")), "f": F.when(k % 3 != 0, 4 + k % 9), "hl": 8.25 + k % 3, "hw": 9.5 + k % 2, "s": 25 + k % 11, "v": F.when(k % 4 != 0, 30 + k % 13),
        "lane": none, "shuttle": none, "sprint": none, "bench": none, "spot": F.concat((k % 8).cast("string"), F.lit("-10")), "off": F.when(k % 5 != 0, F.concat((k % 8).cast("string"), F.lit("-15"))).otherwise("did not shoot"),
    })
    names = dict(zip(("height", "wing", "reach", "weight", "fat", "hand_length", "hand_width", "standing", "running"), ("h", "w", "r", "g", "f", "hl", "hw", "s", "v"), strict=True)) | {n: n for n in ("lane", "shuttle", "sprint", "bench")}
    x = facts.combine(x, names, ["spot", "off"])
    four = ("weight_per_inch", "bmi_like", "lean_ratio")
    whole = [F.col(n).cast("double").alias(n) for n in ("run_up_gain", "max_touch", "standing_touch", "wing_minus_height", "reach_minus_height")]
    return rounded(x.select("client_id", "month", "wing_ratio", "reach_ratio", "hand_length_ratio", "hand_width_ratio", *(F.round(n, 4).alias(n) for n in four), *whole, "measures", "drills", "shoot_pct"))


def _ratio_sql() -> str:
    parts = {"top": "price >= hi", "bot": "price < mid", "rest": "price < hi"}
    sums = ", ".join(f"coalesce(sum(quantity) FILTER ({c} AND flag = 'kept'), 0)::DOUBLE AS {n}a, coalesce(sum(quantity) FILTER ({c} AND flag <> 'kept'), 0)::DOUBLE AS {n}b, count(*) FILTER ({c}) AS {n}_n" for n, c in parts.items())
    made = ", ".join(f"CASE WHEN {n}b > 0 THEN {n}a / {n}b END AS {n}_ratio, CASE WHEN {n}b > 0 THEN {n}a / {n}b * sqrt(1 / greatest({n}a, 1) + 1 / {n}b) END AS {n}_se" for n in parts)
    out = ", ".join(f"round({n}_ratio, 5) AS {n}_ratio, round({n}_se, 5) AS {n}_se, {n}_n" for n in parts)
    return f"""WITH g AS (SELECT month(shipped_at)::BIGINT AS month, vendor_id, quantity, flag, price FROM sale_lines JOIN items USING (item_id) WHERE shipped_at IS NOT NULL AND price IS NOT NULL), q AS (SELECT month, quantile_cont(price, 0.75) AS hi, quantile_cont(price, 0.5) AS mid FROM g GROUP BY 1),
s AS (SELECT month, vendor_id, {sums} FROM g JOIN q USING (month) GROUP BY 1, 2), m AS (SELECT *, {made} FROM s) SELECT month, vendor_id, {out}, round(top_ratio - rest_ratio, 5) AS top_minus_rest, round(sqrt(top_se * top_se + rest_se * rest_se), 5) AS top_minus_rest_se FROM m"""


@book.query(_ratio_sql())
def ratio_opponent_splits(spark, d):
    """A ratio of two counts with its error against strong, weak and other opponents of a season."""
    i = table(spark, d, "items", ["item_id", "price"])
    l = table(spark, d, "sale_lines", ["item_id", "vendor_id", "quantity", "flag", "shipped_at"]).filter("shipped_at is not null").join(i, "item_id")  # noqa: E741
    kept = F.col("flag") == "kept"
    g = l.select(F.month("shipped_at").cast("long").alias("month"), "vendor_id", "price", F.when(kept, F.col("quantity")).alias("a"), F.when(~kept, F.col("quantity")).alias("b"))
    return rounded(context.ratio_splits(g, "month", ["vendor_id"], "price", "a", "b"), 5)
