"""Text and number forms, further aggregates and windows, and the dataflows and guards built from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions import keys, nulls, numbers
from orderloom.operators import rules, stats, windows
from orderloom.operators.pit import first_periods
from orderloom.plans.base import MEMBERS, SUPPLIER_YEARS, Book, member_values, pct_sql, rank_sql, rounded, supplier_years
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql


# -- scalar functions -----------------------------------------------------------------------


@book.query(r"SELECT n_nationkey::BIGINT AS n_nationkey, 'Port ' || n_name AS flipped, trim(regexp_replace(lower(n_name || '-X1 Yy'), '[^a-z]+', ' ', 'g')) AS spaced FROM nation")
def name_forms(spark, d):
    """F2, F6."""
    n = table(spark, d, "nation", ["n_nationkey", "n_name"])
    return rounded(n.select("n_nationkey", keys.flip_name(F.concat("n_name", F.lit(", Port"))).alias("flipped"), keys.spaced_key(F.concat("n_name", F.lit("-X1 Yy"))).alias("spaced")))


@book.query("WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'n/a' ELSE p_size || '.5' END AS t FROM part) SELECT p_partkey, try_cast(t AS DOUBLE) AS number, coalesce(try_cast(t AS DOUBLE), -1.0::DOUBLE) AS filled FROM x")
def number_cleanup(spark, d):
    """F15, F16."""
    size = F.col("p_size").cast("string")
    t = F.when(F.col("p_partkey") % 3 == 0, size).when(F.col("p_partkey") % 3 == 1, "n/a").otherwise(F.concat(size, F.lit(".5")))
    return table(spark, d, "part", ["p_partkey", "p_size"]).select("p_partkey", nulls.tnum(t).alias("number"), nulls.tnum(t, -1.0).alias("filled"))


@book.query("""WITH g AS (SELECT l_suppkey, sum(l_quantity) AS minutes, sum(l_linenumber)::DOUBLE AS points, count(*)::DOUBLE AS tries, avg(l_tax) AS rating FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(points * 36 / minutes, 6) AS per36, round(points / (2 * (tries + 0.44 * tries)), 6) AS shooting, round(1.5 * (rating + 2) * minutes, 4) AS above FROM g""")
def rate_formulas(spark, d):
    """F32 to F35 on sums by supplier."""
    g = table(spark, d, "lineitem", ["l_suppkey", "l_quantity", "l_linenumber", "l_tax"]).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("m"), F.sum("l_linenumber").cast("double").alias("p"), F.count("*").cast("double").alias("t"), F.avg("l_tax").alias("r"))
    m, p, t, r = (F.col(c) for c in "mptr")
    return rounded(g.select("l_suppkey", numbers.per(p, m, 36.0).alias("per36"), numbers.shooting(p, t, t).alias("shooting"), F.round(numbers.value_above(r, m, scale=1.5), 4).alias("above")))


@book.query("SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS slog, greatest(-500.0::DOUBLE, least(9000.0::DOUBLE, c_acctbal)) AS clipped, round(sqrt(abs(c_acctbal)), 6) AS root, floor(c_acctbal / 100)::BIGINT AS hundreds FROM customer")
def log_and_clip(spark, d):
    """F29."""
    x = F.col("c_acctbal")
    return rounded(table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select("c_custkey", numbers.sign_log(x).alias("slog"), nulls.clip(x, -500.0, 9000.0).alias("clipped"), F.sqrt(F.abs(x)).alias("root"), F.floor(x / 100).alias("hundreds")))


LEVELS = (("1-", "top"), ("2-", "high"), ("not", "open"), ("low", "low"))
STATES = {"F": "final", "O": "open", "P": "partial"}


@book.query(f"""SELECT CASE {' '.join(f"WHEN contains(lower(o_orderpriority), '{a}') THEN '{b}'" for a, b in LEVELS)} ELSE 'other' END AS level,
coalesce(CASE o_orderstatus {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in STATES.items())} END, 'unknown') AS state, count(*) AS n FROM orders GROUP BY 1, 2""")
def category_maps(spark, d):
    """a fixed map and a classifier by substring."""
    p, level = F.lower("o_orderpriority"), None
    for part, name in LEVELS:
        level = F.when(p.contains(part), name) if level is None else level.when(p.contains(part), name)
    state = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    o = table(spark, d, "orders", ["o_orderpriority", "o_orderstatus"])
    return o.groupBy(level.otherwise("other").alias("level"), F.coalesce(F.try_element_at(state, "o_orderstatus"), F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))


@book.query("""WITH g AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 0), []::VARCHAR[]) AS a, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 1), []::VARCHAR[]) AS b FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, len(list_intersect(a, b))::BIGINT AS n_both, len(list_intersect(a, b)) > 0 AS meet FROM g""")
def array_sets(spark, d):
    """F38."""
    half = lambda k: F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type")))  # noqa: E731  a handful of types
    g = table(spark, d, "events", ["user_id", "event_id", "event_type"]).groupBy("user_id").agg(half(0).alias("a"), half(1).alias("b"))
    return rounded(g.select("user_id", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("either"), F.size(F.array_intersect("a", "b")).alias("n_both"), F.arrays_overlap("a", "b").alias("meet")))


@book.query("""SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.z.y'), 'none') AS nested, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS dumped FROM events""")
def json_get_and_dump(spark, d):
    """F39."""
    e = table(spark, d, "events", ["event_id", "event_type", "props"])
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.z.y"), F.lit("none")).alias("nested"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("dumped"))


@book.query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '—' WHEN 1 THEN '0.0' ELSE printf('%+.1f', floor(c_acctbal)) END AS delta, CASE c_custkey % 5 WHEN 0 THEN '—' WHEN 1 THEN '0.0' ELSE printf('%.1f', floor(c_acctbal)) END AS shown_value, '&lt;b class=&quot;x&quot;&gt;' || c_name || ' &amp; co&lt;/b&gt;' AS shown FROM customer""")
def report_format(spark, d):
    """what rounds to zero has no sign."""
    x = F.when(F.col("c_custkey") % 5 == 1, F.lit(-0.04)).when(F.col("c_custkey") % 5 > 1, F.floor("c_acctbal").cast("double"))
    return table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_name"]).select("c_custkey", keys.signed(x).alias("delta"), keys.fixed(x).alias("shown_value"), keys.escape_html(F.concat(F.lit('<b class="x">'), "c_name", F.lit(" & co</b>"))).alias("shown"))


@book.query(r"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT rid, t, unnest(list_prepend(0, list_transform(string_split_regex(t, 'the '), lambda x: len(x)))) AS n, unnest(range(len(string_split_regex(t, 'the ')) + 1)) AS i FROM t),
s AS (SELECT rid, t, i, sum(n) OVER (PARTITION BY rid ORDER BY i) + 4 * (i - 1) AS place, count(*) OVER (PARTITION BY rid) AS m FROM p),
h AS (SELECT rid, regexp_matches(substr(t, greatest(place - 300, 0)::BIGINT + 1, (place - greatest(place - 300, 0) + 1000)::BIGINT), '[0-9]') AS near FROM s WHERE i > 0 AND i < m - 1),
g AS (SELECT rid, count(*) AS n, count(*) FILTER (near) AS near FROM h GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS mentions, coalesce(near, 0) AS number_near FROM t LEFT JOIN g USING (rid)""")
def proximity_check(spark, d):
    """of all mentions of a word, those with a number from 300 characters before to 1,000 behind their start."""
    t = F.coalesce("text", F.lit(""))
    x = table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", t.alias("t"), keys.positions(t, "the ").alias("at"))
    from_ = lambda at: F.greatest(at - 300, F.lit(0))
    near = F.filter("at", lambda at: F.substring(F.col("t"), from_(at) + 1, at - from_(at) + 1000).rlike("[0-9]"))
    return rounded(x.select("doc_id", F.size("at").alias("mentions"), F.size(near).alias("number_near")))


@book.query("SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def utc_times(spark, d):
    """times without a zone are read at a fixed offset."""
    return table(spark, d, "events", ["event_id", "ts"]).select("event_id", F.date_format(F.to_utc_timestamp("ts", "+02:00"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@book.query(r"WITH n AS (SELECT p_partkey, trim(p_name) AS c, p_name FROM part) SELECT p_partkey, c AS compared, len(list_filter(regexp_split_to_array(trim(p_name), '\s+'), lambda x: x <> ''))::BIGINT AS n_words FROM n")
def comparison_names(spark, d):
    """the first name of a comparison, without asides and hedges."""
    p = table(spark, d, "part", ["p_partkey", "p_name", "p_brand"])
    said = F.concat(F.lit("poor man's "), "p_name", F.lit(" (raw) / "), "p_brand")
    return rounded(p.select("p_partkey", keys.comparison(said).alias("compared"), F.size(keys.words("p_name")).alias("n_words")))


# -- sources inside texts -------------------------------------------------------------------


@book.query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def csv_in_script(spark, d):
    """Rows of a CSV text that a script holds."""
    n = table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    script = n.select(F.format_string('var DATA="key,name,region\n%d,%s,%d";', "n_nationkey", "n_name", "n_regionkey").alias("js"))
    line = F.get(F.split(F.regexp_extract("js", r'DATA="([^"]*)"', 1), "\n"), F.lit(1))
    return script.select(F.from_csv(line, "n_nationkey long, n_name string, n_regionkey long").alias("r")).select("r.*")


@book.query("SELECT event_id, event_type, round(value, 6) AS value FROM events")
def json_in_page(spark, d):
    """Nested values of a JSON document inside a page."""
    e = table(spark, d, "events", ["event_id", "event_type", "value"])
    page = F.concat(F.lit('<script id="data">'), F.to_json(F.struct(F.struct("event_id", F.array(F.struct("event_type", "value")).alias("rows")).alias("props"))), F.lit("</script>"))
    doc = F.from_json(F.regexp_extract(page, "(?s)<script[^>]*>(.*)</script>", 1), "props struct<event_id:long,rows:array<struct<event_type:string,value:double>>>")
    return rounded(e.select(doc.alias("x")).select("x.props.event_id", F.inline("x.props.rows")))


@book.query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+/([^/?#]*)', 1) AS section FROM pages WHERE url LIKE 'http%')
SELECT host, section, min(page_id) AS first_page, count(*) AS captures FROM p GROUP BY 1, 2""")
def capture_index(spark, d):
    """Captures classified by address; the first one of each class stands."""
    p = table(spark, d, "pages", ["page_id", "url"]).filter(F.col("url").startswith("http"))
    return p.groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_extract("url", "://[^/]+/([^/?#]*)", 1).alias("section")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("captures"))


# -- aggregates and windows -----------------------------------------------------------------


@book.query(f"WITH {MEMBERS} SELECT entity, round(sum((cohort - 1990) * value) / sum(cohort - 1990), 1) AS recent FROM v GROUP BY 1")
def recency_weighted_mean(spark, d):
    """A24."""
    v = member_values(spark, d).withColumn("w", F.col("cohort") - 1990)
    return rounded(v.groupBy("entity").agg(stats.wmean("value", "w").alias("recent")), 1)


@book.query("WITH g AS (SELECT conv_id, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first, role) AS k FROM g) SELECT conv_id, role, n FROM r WHERE k = 1")
def longest_list_wins(spark, d):
    """The longest list of a group; ties to the one that starts first."""
    g = table(spark, d, "conversations", ["conv_id", "role", "turn"]).groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("k"), "first", "role", "n")).alias("b")
    return g.groupBy("conv_id").agg(best).select("conv_id", "b.role", "b.n")


@book.query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type, round(value, 6) AS value FROM r WHERE k = 1")
def last_row_per_group(spark, d):
    """W8 as one partial aggregate, without a sort."""
    e = table(spark, d, "events", ["user_id", "ts", "event_id", "event_type", "value"])
    return rounded(e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x")).select("user_id", "x.event_id", "x.event_type", "x.value"))


@book.query(f"WITH {MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cohort) AS k FROM v) SELECT entity, round(regr_slope(value, k), 1) AS slope FROM k WHERE k <= 4 GROUP BY 1 HAVING count(*) > 1")
def horizon_slope(spark, d):
    """Slope over the first four horizons."""
    k = member_values(spark, d).withColumn("k", windows.ordinal(["entity"], F.col("cohort"))).filter("k <= 4")
    return rounded(k.groupBy("entity").agg(F.regr_slope("value", F.col("k").cast("double")).alias("slope"), F.count("*").alias("n")).filter("n > 1").drop("n"), 1)


@book.query(f"WITH {MEMBERS}, s AS (SELECT cohort, entity, CASE WHEN entity % 4 <> 0 THEN value END AS score FROM v) SELECT cohort, entity, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY cohort ORDER BY score DESC NULLS LAST, entity) END AS slot FROM s")
def redraft_slots(spark, d):
    """New slots only for members with a score."""
    v = member_values(spark, d).withColumn("score", F.when(F.col("entity") % 4 != 0, F.col("value")))
    return rounded(v.select("cohort", "entity", nulls.gate(windows.ordinal(["cohort"], F.desc_nulls_last("score"), F.col("entity")), F.col("score").isNotNull()).alias("slot")))


@book.query("""WITH x AS (SELECT user_id, event_id, event_id % 6 AS place, event_type FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, place ORDER BY event_id) AS k FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS j FROM a WHERE k = 1) SELECT user_id, event_id, place, event_type FROM b WHERE j = 1""")
def first_per_rank_then_name(spark, d):
    """First seen of each rank, then of each name, in document order."""
    x = table(spark, d, "events", ["user_id", "event_id", "event_type"]).withColumn("place", F.col("event_id") % 6)
    a = x.groupBy("user_id", "place").agg(F.min(F.struct("event_id", "event_type")).alias("r")).select("user_id", "place", "r.*")
    return a.groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "place")).alias("r")).select("user_id", "event_type", "r.*")


@book.query("WITH u AS (SELECT c_custkey AS id, c_acctbal AS balance, 1 AS source FROM customer UNION ALL SELECT c_custkey, c_acctbal * 2, 2 FROM customer WHERE c_custkey % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source DESC) AS k FROM u) SELECT id, round(balance, 4) AS balance FROM r WHERE k = 1")
def union_keep_last(spark, d):
    """Of rows with one key, that of the last source stays."""
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("source"))
    more = c.filter("id % 3 = 0").select("id", (F.col("balance") * 2).alias("balance"), F.lit(2).alias("source"))
    return rounded(c.unionByName(more).groupBy("id").agg(F.max_by("balance", "source").alias("balance")), 4)


@book.query(f"""WITH {SUPPLIER_YEARS}, g AS (SELECT supp, regr_slope(qty, year) AS slope, sum(lines)::DOUBLE AS w FROM s GROUP BY 1 HAVING count(*) > 1), q AS (SELECT quantile_cont(slope, 0.05) AS lo, quantile_cont(slope, 0.95) AS hi FROM g)
SELECT round(sum(w * greatest(lo, least(hi, slope))) / sum(w), 3) AS slope, count(*) AS n FROM g, q""")
def clipped_slope_mean(spark, d):
    """Weighted mean of entities' slopes, clipped at their 5th and 95th percentile."""
    g = supplier_years(spark, d).groupBy("supp").agg(F.regr_slope("qty", F.col("year").cast("double")).alias("slope"), F.sum("lines").cast("double").alias("w"), F.count("*").alias("n")).filter("n > 1")
    q = g.agg(F.percentile("slope", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    x = g.join(F.broadcast(q), F.lit(True)).withColumn("c", F.greatest(F.get("q", F.lit(0)), F.least(F.get("q", F.lit(1)), F.col("slope"))))  # one row
    return rounded(x.agg(F.round(stats.wmean("c", "w"), 3).alias("slope"), F.count("*").alias("n")), 3)


@book.query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders) SELECT o_orderkey, round(greatest(0, least(1, (o_totalprice - lo) / (hi - lo))), 6) AS part FROM orders, q")
def coverage_norm(spark, d):
    """Position between the 5th and the 95th percentile."""
    o = table(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    q = o.agg(F.percentile("o_totalprice", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    lo, hi = (F.get("q", F.lit(i)) for i in (0, 1))
    return rounded(o.join(F.broadcast(q), F.lit(True)).select("o_orderkey", nulls.clip(nulls.sdiv(F.col("o_totalprice") - lo, hi - lo), 0.0, 1.0).alias("part")))  # one row


# -- dataflows ------------------------------------------------------------------------------


@book.query(f"""WITH {MEMBERS}, o AS (SELECT cohort, c_nationkey, sum(value) OVER (PARTITION BY entity ORDER BY cohort RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS y FROM v JOIN customer ON entity = c_custkey),
g AS (SELECT c_nationkey, cohort, sum(coalesce(y, 0)) AS s, count(*) AS n FROM o GROUP BY 1, 2) SELECT c_nationkey::BIGINT AS c_nationkey, cohort, round(sum(s) OVER w / sum(n) OVER w, 4) AS pop_prior FROM g
WINDOW w AS (PARTITION BY c_nationkey ORDER BY cohort RANGE BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING)""")
def population_outcomes(spark, d):
    """Mean outcome of earlier cohorts of a group, only of those that were complete."""
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    v = member_values(spark, d).withColumn("y", F.sum("value").over(Window.partitionBy("entity").orderBy("cohort").rangeBetween(1, 3)))
    g = v.join(c, F.col("entity") == F.col("c_custkey")).groupBy("c_nationkey", "cohort").agg(F.sum(F.coalesce("y", F.lit(0.0))).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("c_nationkey").orderBy("cohort").rangeBetween(Window.unboundedPreceding, -4)
    return rounded(g.select("c_nationkey", "cohort", nulls.sdiv(F.sum("s").over(w), F.sum("n").over(w)).alias("pop_prior")), 4)


@book.query("""WITH g AS (SELECT user_id % 20 AS team, user_id, ts::DATE AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2, 3), u AS (SELECT team, user_id, sum(n) AS n FROM g GROUP BY 1, 2),
s AS (SELECT team, arg_max(user_id, (n, -user_id)) AS star FROM u GROUP BY 1), x AS (SELECT g.*, star, max((user_id = star)::INT) OVER (PARTITION BY g.team, day) AS there FROM g JOIN s ON s.team = g.team),
m AS (SELECT user_id, sum(v) FILTER (there = 1) / sum(n) FILTER (there = 1) AS a, sum(v) FILTER (there = 0) / sum(n) FILTER (there = 0) AS b, coalesce(sum(n) FILTER (there = 0), 0)::DOUBLE AS k FROM x WHERE user_id <> star GROUP BY 1)
SELECT user_id, round(a, 4) AS with_star, round(b, 4) AS without_star, round(k / (k + 5) * (b - a), 4) AS shrunk_gain FROM m""")
def star_absence(spark, d):
    """A member's rate on days with and without the team's most active one, shrunk to no change."""
    e = table(spark, d, "events", ["user_id", "ts", "value"])
    g = e.groupBy((F.col("user_id") % 20).alias("team"), "user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    u = g.groupBy("team", "user_id").agg(F.sum("n").alias("n"))
    star = u.groupBy("team").agg(F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("star"))
    x = g.join(star, "team").withColumn("there", F.max((F.col("user_id") == F.col("star")).cast("int")).over(Window.partitionBy("team", "day")))
    rate = lambda k: stats.ratio(F.when(F.col("there") == k, F.col("v")), F.when(F.col("there") == k, F.col("n")))
    m = x.filter("user_id <> star").groupBy("user_id").agg(rate(1).alias("with_star"), rate(0).alias("without_star"), F.coalesce(F.sum(F.when(F.col("there") == 0, F.col("n"))), F.lit(0)).cast("double").alias("k"))
    return rounded(m.select("user_id", "with_star", "without_star", (F.col("k") / (F.col("k") + 5) * (F.col("without_star") - F.col("with_star"))).alias("shrunk_gain")), 4)


@book.query("SELECT l_suppkey, round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) AS he_on, round(avg(l_discount) FILTER (l_returnflag <> 'N'), 6) AS he_off, round(avg(l_discount) FILTER (l_returnflag = 'N') - avg(l_discount) FILTER (l_returnflag <> 'N'), 6) AS he_drop FROM lineitem GROUP BY 1")
def lineup_impact(spark, d):
    """Two views of one measure and their difference."""
    on = F.col("l_returnflag") == "N"
    g = table(spark, d, "lineitem", ["l_suppkey", "l_returnflag", "l_discount"]).groupBy("l_suppkey").agg(F.avg(F.when(on, F.col("l_discount"))).alias("he_on"), F.avg(F.when(~on, F.col("l_discount"))).alias("he_off"))
    return rounded(g.withColumn("he_drop", F.col("he_on") - F.col("he_off")))


@book.query(r"""WITH l AS (SELECT conv_id, arg_max(text, turn) AS t FROM conversations WHERE turn < 4 AND text IS NOT NULL GROUP BY 1), n AS (SELECT conv_id, len(regexp_extract_all(lower(t), '\b(the|is|on)\b')) AS g, len(list_filter(regexp_split_to_array(trim(t), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM l)
SELECT conv_id, g::BIGINT AS hits, w::BIGINT AS n_words, round(1000.0 * g / nullif(w, 0), 6) AS rate FROM n""")
def dated_text_features(spark, d):
    """Lexicon counts of the latest revision before the cutoff, which is the fifth turn: later ones are not known yet."""
    c = table(spark, d, "conversations", ["conv_id", "turn", "text"]).filter("turn < 4 AND text IS NOT NULL")
    n, rate = keys.lexicon_rate("t", ("the", "is", "on"))
    return rounded(c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("t")).select("conv_id", n.alias("hits"), F.size(keys.words("t")).alias("n_words"), rate.alias("rate")))


@book.query("SELECT l_suppkey, year(l_shipdate)::BIGINT AS year, count(*) AS lines, round(sum(l_quantity), 4) AS qty, string_agg(DISTINCT l_returnflag, '/' ORDER BY l_returnflag) AS teams FROM lineitem GROUP BY 1, 2")
def season_totals_teams(spark, d):
    """Totals over kinds of a season, with the kinds' names in a row."""
    l = table(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity", "l_returnflag"])  # noqa: E741
    g = l.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "/").alias("teams"))
    return rounded(g, 4)


@book.query("""WITH x AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 10 ELSE o_custkey % 7 END AS team, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey % 60 ELSE o_orderkey % 48 END AS m, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey % 48 ELSE o_orderkey % 60 END AS s, o_custkey FROM orders)
SELECT team, round(sum(m + s / 60.0::DOUBLE), 4) AS minutes, count(DISTINCT o_custkey) AS players FROM x GROUP BY 1""")
def side_box_totals(spark, d):
    """Side to team, two columns that one league swaps, minutes from minutes and seconds."""
    o, swap = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"]), F.col("o_orderpriority").startswith("1")
    a, b = F.col("o_orderkey") % 48, F.col("o_orderkey") % 60
    team = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 10).otherwise(F.col("o_custkey") % 7)
    minutes = F.when(swap, b).otherwise(a) + F.when(swap, a).otherwise(b) / 60.0
    return rounded(o.groupBy(team.alias("team")).agg(F.sum(minutes).alias("minutes"), F.count_distinct("o_custkey").alias("players")), 4)


@book.query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_retailprice ELSE p_retailprice * 2 END AS price FROM part")
def ablation_restore(spark, d):
    """Some rows of a column as an earlier version had them."""
    old = table(spark, d, "part", ["p_partkey", "p_size", "p_retailprice"])
    new = old.select("p_partkey", (F.col("p_retailprice") * 2).alias("price"))
    back = old.filter("p_size < 10").select("p_partkey", F.col("p_retailprice").alias("was"))
    return new.join(back, "p_partkey", "left").select("p_partkey", F.coalesce("was", "price").alias("price"))


# -- labels, metrics and rules --------------------------------------------------------------


@book.query(f"""WITH {MEMBERS}, c AS (SELECT v.*, c_acctbal FROM v JOIN customer ON entity = c_custkey), f AS (SELECT regr_slope(value, c_acctbal) AS b, regr_intercept(value, c_acctbal) AS a FROM c WHERE cohort = 1998)
SELECT cohort, entity, CASE WHEN cohort < 1998 THEN round(a + b * c_acctbal, 1) ELSE value END AS value, CASE WHEN cohort < 1998 THEN 'calibrated' ELSE 'measured' END AS source FROM c, f""")
def label_era_switch(spark, d):
    """L1: before an era values come from another source, calibrated where both are known."""
    c = member_values(spark, d).join(table(spark, d, "customer", ["c_custkey", "c_acctbal"]), F.col("entity") == F.col("c_custkey"))
    f = c.filter("cohort = 1998").agg(F.regr_slope("value", "c_acctbal").alias("b"), F.regr_intercept("value", "c_acctbal").alias("a"))
    early = F.col("cohort") < 1998
    x = c.join(F.broadcast(f), F.lit(True))  # one row
    return rounded(x.select("cohort", "entity", F.when(early, F.round(F.col("a") + F.col("b") * F.col("c_acctbal"), 1)).otherwise(F.col("value")).alias("value"), F.when(early, "calibrated").otherwise("measured").alias("source")), 4)


@book.query(f"WITH {MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cohort) AS k FROM v) SELECT cohort, entity, CASE WHEN entity % 10 = 0 AND k = 2 THEN 1.5::DOUBLE ELSE value END AS value FROM k")
def period_overrides(spark, d):
    """L2: frozen values by the ordinal of a played period."""
    k = member_values(spark, d).withColumn("k", windows.ordinal(["entity"], F.col("cohort")))
    frozen = table(spark, d, "customer", ["c_custkey"]).filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("entity"), F.lit(2).alias("k"), F.lit(1.5).alias("o"))
    return rounded(k.join(frozen, ["entity", "k"], "left").select("cohort", "entity", F.coalesce("o", "value").alias("value")), 4)


@book.query(f"WITH {MEMBERS}, e AS (SELECT entity, min(cohort) AS debut, count(value) AS n FROM v GROUP BY 1) SELECT debut, greatest(1, least(5, max(n)))::BIGINT AS horizon FROM e GROUP BY 1")
def completed_horizon(spark, d):
    """L10."""
    e = member_values(spark, d).groupBy("entity").agg(F.min("cohort").alias("debut"), F.count("value").alias("n"))
    return rounded(e.groupBy("debut").agg(F.greatest(F.lit(1), F.least(F.lit(5), F.max("n"))).alias("horizon")))


@book.query(f"""WITH {MEMBERS}, x AS (SELECT v.*, c_acctbal FROM v JOIN customer ON entity = c_custkey), r AS (SELECT cohort, {rank_sql('value', 'cohort')} AS a, {rank_sql('c_acctbal', 'cohort')} AS b, {rank_sql('entity', 'cohort', True)} AS c FROM x),
e AS (SELECT cohort, corr(a, b) AS ours, corr(a, c) AS base FROM r GROUP BY 1) SELECT round(avg(ours), 6) AS ours, round(avg(base), 6) AS base, count(*) FILTER (ours > base) AS wins, count(*) AS n, round(stddev_samp(ours - base) / sqrt(count(*)), 6) AS se FROM e""")
def evidence_summary(spark, d):
    """Means, wins and the error of the gain over cohorts."""
    x = member_values(spark, d).join(table(spark, d, "customer", ["c_custkey", "c_acctbal"]), F.col("entity") == F.col("c_custkey"))
    r = windows.ranked(x, ["cohort"], {"a": "value", "b": "c_acctbal", "c": -F.col("entity")})
    e = r.groupBy("cohort").agg(nulls.corr("a", "b").alias("ours"), nulls.corr("a", "c").alias("base"))
    return rounded(e.agg(F.avg("ours").alias("ours"), F.avg("base").alias("base"), F.count_if(F.col("ours") > F.col("base")).alias("wins"), F.count("*").alias("n"), (F.stddev_samp(F.col("ours") - F.col("base")) / F.sqrt(F.count("*"))).alias("se")))


_CELLS = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]


@book.query(f"""WITH {MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cohort) AS k FROM v), t AS (SELECT entity, {', '.join(f'round(sum(value) FILTER (k <= {h}), 4) AS t{h}' for h in (1, 2, 3))}, 1 AS g FROM k GROUP BY 1),
r AS (SELECT {', '.join(f"{rank_sql(f't{h}', 'g')} AS r{h}" for h in (1, 2, 3))} FROM t)
{' UNION ALL '.join(f'SELECT {i}::BIGINT AS trained, {j}::BIGINT AS judged, round(corr(r{i}, r{j}), 6) AS rho FROM r' for i, j in _CELLS)}""")
def horizon_matrix(spark, d):
    """Agreement of the orders that two horizons give; ranks by sorted joins of counts, not by one window."""
    v = member_values(spark, d)
    k = windows.ordinal(["entity"], F.col("cohort"))
    t = v.withColumn("k", k).groupBy("entity").agg(*(F.round(F.sum(F.when(F.col("k") <= h, F.col("value"))), 4).alias(f"t{h}") for h in (1, 2, 3)))
    r = t
    for h in (1, 2, 3):
        r = r.join(stats.global_rank(t, f"t{h}").withColumnRenamed("rank", f"r{h}"), f"t{h}")
    row = r.agg(*(nulls.corr(f"r{i}", f"r{j}").alias(f"c{i}{j}") for i, j in _CELLS))
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("trained"), F.lit(j).cast("long").alias("judged"), F.col(f"c{i}{j}").alias("rho")) for i, j in _CELLS))
    return rounded(row.select(F.inline(cells)))


@book.query(f"""WITH {MEMBERS}, e AS (SELECT c_nationkey, entity, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM v JOIN customer ON entity = c_custkey GROUP BY 1, 2), x AS (SELECT c_nationkey, entity, round(m + 0.5 * s, 4) AS up, round(m - 0.5 * s, 4) AS down FROM e)
SELECT entity, round({pct_sql('up', 'c_nationkey')}, 6) AS upside, round({pct_sql('down', 'c_nationkey')}, 6) AS floor FROM x""")
def upside_floor(spark, d):
    """Q3."""
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    e = member_values(spark, d).join(c, F.col("entity") == F.col("c_custkey")).groupBy("c_nationkey", "entity").agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("s"))
    x = e.select("c_nationkey", "entity", F.round(F.col("m") + 0.5 * F.col("s"), 4).alias("up"), F.round(F.col("m") - 0.5 * F.col("s"), 4).alias("down"))
    return rounded(windows.with_pct_ranks(x, ["c_nationkey"], {"upside": "up", "floor": "down"}).select("entity", "upside", "floor"))


@book.query(f"""WITH {MEMBERS}, x AS (SELECT v.*, c_acctbal, (entity % 11)::DOUBLE AS cover FROM v JOIN customer ON entity = c_custkey), p AS (SELECT cohort, entity, cover, median(cover) OVER (PARTITION BY cohort) AS mid, {pct_sql('value', 'cohort')} AS a, {pct_sql('c_acctbal', 'cohort')} AS b FROM x)
SELECT cohort, entity, round(greatest(CASE WHEN cover >= mid THEN 0.6 * a + 0.4 * b ELSE b - 0.05 END, 0.8 * b), 6) AS score FROM p""")
def conditional_stack(spark, d):
    """Q16: the stack where coverage is good, a penalised anchor elsewhere, and the anchor's floor."""
    x = member_values(spark, d).join(table(spark, d, "customer", ["c_custkey", "c_acctbal"]), F.col("entity") == F.col("c_custkey")).withColumn("cover", (F.col("entity") % 11).cast("double"))
    p = x.select("cohort", "entity", "cover", F.median("cover").over(Window.partitionBy("cohort")).alias("mid"), rules.blend([("value", 0.6), ("c_acctbal", 0.4)], ["cohort"]).alias("s"), windows.pct_rank("c_acctbal", ["cohort"]).alias("b"))
    return rounded(p.select("cohort", "entity", F.greatest(F.when(F.col("cover") >= F.col("mid"), F.col("s")).otherwise(F.col("b") - 0.05), 0.8 * F.col("b")).alias("score")))


# -- model inputs and guards ----------------------------------------------------------------


@book.query("WITH u AS (SELECT c_mktsegment AS x FROM customer UNION SELECT o_orderpriority FROM orders), k AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM u WHERE x IS NOT NULL) SELECT c_custkey, code FROM customer LEFT JOIN k ON x = c_mktsegment")
def ordinal_encode(spark, d):
    """M8: codes by the alphabet over the union of two frames; NULL has none."""
    c, o = table(spark, d, "customer", ["c_custkey", "c_mktsegment"]), table(spark, d, "orders", ["o_orderpriority"])
    values = c.select(F.col("c_mktsegment").alias("x")).union(o).filter("x IS NOT NULL").distinct()
    codes = values.withColumn("code", windows.ordinal([F.lit(1)], F.col("x")) - 1)  # a vocabulary, not rows
    return rounded(c.join(codes, F.col("x") == F.col("c_mktsegment"), "left").select("c_custkey", "code"))


@book.query("WITH b AS (SELECT c_nationkey, least(4, greatest(0, floor((c_acctbal + 1000) / 2200)))::BIGINT AS b FROM customer) SELECT c_nationkey::BIGINT AS c_nationkey, round(sum(b)::DOUBLE / count(*), 6) AS expected_bin FROM b GROUP BY 1")
def expected_bin(spark, d):
    """M7: the mean bin under the shares of each bin."""
    c = table(spark, d, "customer", ["c_nationkey", "c_acctbal"])
    b = F.least(F.lit(4), F.greatest(F.lit(0), F.floor((F.col("c_acctbal") + 1000) / 2200)))
    g = c.groupBy("c_nationkey").agg(*((F.count_if(b == i) / F.count("*")).alias(f"p{i}") for i in range(5)))
    return rounded(g.select("c_nationkey", sum((F.col(f"p{i}") * i for i in range(1, 5)), F.lit(0.0)).alias("expected_bin")))


@book.query(r"""WITH w AS (SELECT row_number() OVER () AS rid, conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') AS w FROM conversations),
g AS (SELECT conv_id, turn, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT conv_id, turn, rid, term, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL),
f AS (SELECT term, ln((1 + (SELECT count(*) FROM conversations)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1) SELECT conv_id, turn, count(*) AS terms, round(sqrt(sum(tf * idf * tf * idf)), 4) AS norm FROM c JOIN f USING (term) GROUP BY conv_id, turn, rid""")
def tfidf_norms(spark, d):
    """Weights of one and two words with damped counts, as M11 starts from; each text's length under them, no model."""
    c = table(spark, d, "conversations", ["conv_id", "turn", "text"]).withColumn("rid", F.monotonically_increasing_id())
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda x: x != "")
    two = F.transform(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    terms = c.withColumn("w", w).select("conv_id", "turn", "rid", F.explode(F.concat("w", two)).alias("term"))
    tf = terms.groupBy("conv_id", "turn", "rid", "term").agg((1 + F.ln(F.count("*"))).alias("tf"))
    total = F.broadcast(c.agg(F.count("*").alias("total")))  # one row
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(total, F.lit(True)).select("term", (F.ln((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    return rounded(x.groupBy("conv_id", "turn", "rid").agg(F.count("*").alias("terms"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).drop("rid"), 4)


@book.query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unknown, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS uncovered, (SELECT count(*) FROM customer) AS members,
round((SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) / (SELECT count(*) FROM customer), 6) AS covered""")
def contract_coverage(spark, d):
    """Keys outside the pool, members without a row, and the share with one; one outer join."""
    c = table(spark, d, "customer", ["c_custkey"]).withColumn("member", F.lit(1))
    o = table(spark, d, "orders", ["o_custkey"]).distinct()
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full")
    m, k = F.col("member").isNotNull(), F.col("o_custkey").isNotNull()
    return rounded(j.agg(F.count_if(~m).alias("unknown"), F.count_if(m & ~k).alias("uncovered"), F.count_if(m).alias("members"), nulls.sdiv(F.count_if(m & k), F.count_if(m)).alias("covered")))


@book.query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS look FROM events WHERE event_type = 'purchase'")
def look_counter(spark, d):
    """The number of each look that an owner took."""
    e = table(spark, d, "events", ["user_id", "event_id", "event_type"]).filter("event_type = 'purchase'")
    return rounded(e.select("user_id", "event_id", windows.ordinal(["user_id"], F.col("event_id")).alias("look")))


@book.query("SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS kept, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS refused, max(event_id) FILTER (ts < TIMESTAMP '2024-01-15') AS last_kept FROM events")
def capture_before_cutoff(spark, d):
    """What was captured before a cutoff; later captures are refused."""
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return table(spark, d, "events", ["event_id", "ts"]).agg(F.count_if(early).alias("kept"), F.count_if(~early).alias("refused"), F.max(F.when(early, F.col("event_id"))).alias("last_kept"))


@book.query(f"WITH {MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cohort) AS k FROM v), t AS (SELECT entity, sum(value) FILTER (k <= 3) AS whole, sum(value) FILTER (k <= 3 AND cohort <= 1997) AS known FROM k GROUP BY 1) SELECT entity, round(known, 4) AS known, round(whole, 4) AS whole FROM t WHERE known IS NOT NULL")
def label_as_known(spark, d):
    """L3, L4: what the first three periods were worth as known at a cutoff, beside the full label."""
    v = member_values(spark, d)
    known = first_periods(v, ["entity"], "cohort", "value", 3, through=1997).select("entity", F.col("total").alias("known"))
    return rounded(known.join(first_periods(v, ["entity"], "cohort", "value", 3).select("entity", F.col("total").alias("whole")), "entity"), 4)
