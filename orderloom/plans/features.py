"""Text, entity and label features, guards, models and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.nulls import corr
from orderloom.functions import keys, nulls, numbers
from orderloom.operators import guards, models, sampling, windows
from orderloom.plans.base import MEMBERS, SUPPLIER_YEARS, Book, member_values, rank_sql, rounded, supplier_years
from orderloom.sources import html
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql
GOOD, BAD = ("the", "is", "on"), ("of", "in")


@book.query(r"SELECT doc_id, regexp_replace(regexp_replace(translate(lower(text), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\b(jr|sr|ii|iii|iv)\b', '', 'g'), '[^a-z]', '', 'g') AS key FROM documents")
def norm_key(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", keys.norm_key("text").alias("key"))


@book.query(r"SELECT n_nationkey::BIGINT AS n_nationkey, regexp_replace(regexp_replace(regexp_replace(lower('The University of ' || n_name || ' State'), '\b(the|of|university|college)\b', '', 'g'), '\bstate\b', 'st', 'g'), '[^a-z]', '', 'g') AS key FROM nation")
def school_key(spark, d):
    n = table(spark, d, "nation")
    return rounded(n.select("n_nationkey", keys.place_key(F.concat(F.lit("The University of "), "n_name", F.lit(" State"))).alias("key")))


@book.query(r"WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(trim(p_name), '\s+'), lambda x: x <> '') AS w FROM part) SELECT p_partkey, w[len(w)] AS last, w[1] || ' ' || w[len(w)] AS ends FROM w")
def tokens_last(spark, d):
    return table(spark, d, "part", ["p_partkey", "p_name"]).select("p_partkey", keys.last_word("p_name").alias("last"), keys.ends_key("p_name").alias("ends"))


@book.query("SELECT p_partkey, (5 + p_size % 3) * 12 + (p_size % 12)::DOUBLE AS inches, (p_size % 9)::DOUBLE AS made, 20.0::DOUBLE AS tried, (p_size + 0.5)::DOUBLE AS pct, 2001 + p_size::BIGINT % 10 AS season FROM part")
def regex_extract_height(spark, d):
    """F12, F13, F14, F19 on texts made from sizes."""
    s = F.col("p_size")
    t = table(spark, d, "part", ["p_partkey", "p_size"]).select("p_partkey", F.format_string("%d-%d", 5 + s % 3, s % 12).alias("h"), F.format_string("%d-20", s % 9).alias("m"), F.concat((s + 0.5).cast("string"), F.lit("%")).alias("p"), F.format_string("20%02d/%02d", s % 10, s % 10 + 1).alias("y"))
    made, tried = keys.made_attempted("m")
    return rounded(t.select("p_partkey", keys.feet_inches("h").alias("inches"), made.alias("made"), tried.alias("tried"), keys.percent("p").alias("pct"), keys.season_end("y").alias("season")))


@book.query(r"WITH n AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\b(the|is|on)\b')) AS g, len(regexp_extract_all(lower(text), '\b(of|in)\b')) AS b, len(list_filter(regexp_split_to_array(trim(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM documents WHERE lang = 'en') SELECT doc_id, g AS good, round(1000.0 * g / nullif(w, 0), 6) AS good_rate, round((g - b) / (g + b + 3), 6) AS tone FROM n")
def keyword_counts(spark, d):
    """lexicon counts, rates and tone."""
    t = table(spark, d, "documents", ["doc_id", "text", "lang"]).filter("lang = 'en'")
    g, rate = keys.lexicon_rate("text", GOOD)
    b, _ = keys.lexicon_rate("text", BAD)
    return rounded(t.select("doc_id", g.alias("good"), rate.alias("good_rate"), keys.tone(g, b).alias("tone")))


@book.query("SELECT o_orderkey, (DATE '2001-12-31' - o_orderdate::DATE) AS days_before, round((DATE '2001-12-31' - o_orderdate::DATE) / 365.25, 6) AS age, o_orderdate::DATE AS day, round(year(o_orderdate) + dayofyear(o_orderdate) / 365.25, 6) AS decimal_year FROM orders")
def age_on_date(spark, d):
    """F22 to F26."""
    o = table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    cut = F.lit("2001-12-31").cast("date")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = keys.any_date(text, "yyyy-MM-dd", "dd/MM/yyyy")
    return rounded(o.select("o_orderkey", F.datediff(cut, day).alias("days_before"), keys.years_between(day, cut).alias("age"), day.alias("day"), (F.year(day) + F.dayofyear(day) / 365.25).alias("decimal_year")))


@book.query("WITH x AS (SELECT o_custkey, o_orderdate::DATE AS day FROM orders), n AS (SELECT day, count(DISTINCT o_custkey) AS n FROM x GROUP BY 1) SELECT day, n, n > 8 OR (month(day) = 10 AND day(day) = 15) AS placeholder FROM n")
def placeholder_detection(spark, d):
    o = table(spark, d, "orders", ["o_custkey", "o_orderdate"]).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count_distinct("o_custkey").alias("n"))
    return o.withColumn("placeholder", (F.col("n") > 8) | ((F.month("day") == 10) & (F.day("day") == 15)))


@book.query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<a\s[^>]*href=\"([^\"]*)\"')) AS n_links FROM pages")
def html_title_links(spark, d):
    p = table(spark, d, "pages", ["page_id", "html"])
    return rounded(p.select("page_id", html.title(F.col("html")).alias("title"), F.size(html.links(F.col("html"))).alias("n_links")))


def _visible_sql() -> str:
    t = "coalesce(html, '')"
    for tag in html.HIDDEN:
        t = rf"regexp_replace({t}, '<{tag}\b.*?</{tag}\s*>', '', 'gis')"
    t = rf"regexp_replace(regexp_replace({t}, '<!--.*?-->', '', 'gs'), '</?(?:{'|'.join(html.BLOCKS)})\b[^>]*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for a, b in html.ENTITIES:
        t = "replace({}, '{}', '{}')".format(t, a, b.replace("'", "''"))
    t = rf"regexp_replace(regexp_replace({t}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
    return f"WITH t AS (SELECT page_id, CASE WHEN html IS NOT NULL THEN trim({t}, chr(10) || ' ') END AS t FROM pages) SELECT page_id, length(t)::BIGINT AS chars, CASE WHEN t IS NULL THEN -1 ELSE len(string_split(t, chr(10))) END::BIGINT AS lines FROM t"


@book.query(_visible_sql())
def visible_text_len(spark, d):
    """Text as shown, by block."""
    t = html.visible_text(F.col("html"))
    return rounded(table(spark, d, "pages", ["page_id", "html"]).select("page_id", F.length(t).alias("chars"), F.size(F.split(t, "\n")).alias("lines")))


@book.query("SELECT doc_id, sha256(coalesce(text, '')) AS text_hash, md5(concat_ws('|', lang, source)) AS config_hash FROM documents")
def hash_manifest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), F.md5(F.concat_ws("|", "lang", "source")).alias("config_hash"))


@book.query("""WITH e AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1), l AS (SELECT user_id, sha256(concat_ws('|', user_id::VARCHAR, n::VARCHAR, last::VARCHAR)) AS line_hash FROM e) SELECT user_id, line_hash, coalesce(lag(line_hash) OVER (ORDER BY user_id), repeat('0', 64)) AS prev_hash FROM l""")
def ledger_chain(spark, d):
    e = table(spark, d, "events", ["user_id", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return guards.chain(e, ["user_id"], ["user_id", "n", "last"]).select("user_id", "line_hash", "prev_hash")


@book.query("SELECT 0::BIGINT AS broken_before, 2::BIGINT AS broken_after")
def ledger_chain_verify(spark, d):
    """An edited line breaks its own hash; a removed line breaks the next link."""
    e = table(spark, d, "supplier", ["s_suppkey", "s_name"])
    c = guards.chain(e, ["s_suppkey"], ["s_suppkey", "s_name"])
    ok = guards.broken_links(c, ["s_suppkey"], ["s_suppkey", "s_name"])
    bad = guards.broken_links(c.withColumn("s_name", F.when(F.col("s_suppkey") == 5, "edited").otherwise(F.col("s_name"))), ["s_suppkey"], ["s_suppkey", "s_name"])
    return ok.agg(F.count("*").alias("broken_before")).join(bad.agg(F.count("*").alias("broken_after")), F.lit(True))


@book.query(f"WITH {MEMBERS} SELECT max(cohort) FILTER (cohort <= 1999) AS last_train, min(cohort) FILTER (cohort > 1999) AS first_test, true AS ok FROM v")
def leak_guard_report(spark, d):
    v = member_values(spark, d)
    return rounded(guards.forward_only(v.filter("cohort <= 1999"), v.filter("cohort > 1999"), "cohort"))


@book.query("WITH o AS (SELECT count(*) AS r, sum(('0x' || substr(md5(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus)), 1, 8))::BIGINT)::BIGINT AS g FROM orders) SELECT r AS rows, g AS digest, r AS rows_after, g AS digest_after FROM o")
def invariant_before_after(spark, d):
    """An enrichment leaves rows and their keys as they were."""
    o = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    after = o.withColumn("big", F.col("o_totalprice") > 1000).repartition(4)
    a, b = (guards.fingerprint(x, ["o_orderkey", "o_orderstatus"]) for x in (o, after))
    return a.join(b.toDF("rows_after", "digest_after"), F.lit(True))


@book.query("SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, 0::BIGINT AS nulls FROM lineitem")
def uniqueness_guard(spark, d):
    return guards.uniqueness(table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])


@book.query("SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)")
def disjoint_ids(spark, d):
    o = table(spark, d, "orders", ["o_custkey", "o_orderdate"])
    y = F.year("o_orderdate")
    return guards.shared_keys(o.filter(y == 1995), o.filter(y == 1996), ["o_custkey"]).agg(F.count("*").alias("shared"))


def _collision_sql() -> str:
    rank = lambda c: f'rank() OVER (PARTITION BY "column" ORDER BY {c}) + (count(*) OVER (PARTITION BY "column", {c}) - 1) / 2.0'
    return f"""WITH l AS (SELECT 'p_retailprice' AS "column", p_retailprice AS x, p_retailprice * 2 AS y FROM part UNION ALL SELECT 'p_size', p_size::DOUBLE, p_size::DOUBLE FROM part), k AS (SELECT * FROM l WHERE x IS NOT NULL),
r AS (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry FROM k), g AS (SELECT "column", count(*) AS overlap, corr(rx, ry) AS rho, median(y / nullif(x, 0)) AS m FROM r GROUP BY 1)
SELECT "column", overlap, round(rho, 6) AS rho, round(m, 6) AS median_ratio, CASE WHEN rho > 0.98 AND m BETWEEN 0.95 AND 1.05 THEN 'merge' WHEN rho > 0.9 THEN 'rescale' ELSE 'keep apart' END AS action FROM g"""


@book.query(_collision_sql())
def collision_audit(spark, d):
    """What two sources say about same-named columns."""
    p = table(spark, d, "part", ["p_partkey", "p_retailprice", "p_size"])
    b = p.select("p_partkey", (F.col("p_retailprice") * 2).alias("p_retailprice"), F.col("p_size"))
    return rounded(guards.collisions(p, b, "p_partkey", ["p_retailprice", "p_size"]))


# -- named dataflows ------------------------------------------------------------------------


@book.query(f"WITH {SUPPLIER_YEARS} SELECT supp, year, round(lag(qty) OVER w, 4) AS prev_qty, round(qty - lag(qty) OVER w, 4) AS d_qty, round(avg(qty) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS career_qty FROM s WINDOW w AS (PARTITION BY supp ORDER BY year)")
def trajectory_features(spark, d):
    w = Window.partitionBy("supp").orderBy("year")
    return rounded(supplier_years(spark, d).select("supp", "year", F.lag("qty").over(w).alias("prev_qty"), (F.col("qty") - F.lag("qty").over(w)).alias("d_qty"), F.avg("qty").over(windows.until_now(["supp"], F.col("year"))).alias("career_qty")), 4)


@book.query(f"""WITH {SUPPLIER_YEARS}, p AS (SELECT year, sum(lines * qty) / sum(lines) AS prior FROM s GROUP BY 1) SELECT supp, year, round(lines / (lines + 20.0) * qty + 20.0 / (lines + 20.0) * prior, 4) AS sh_qty, round(lines / (lines + 20.0), 6) AS sh_weight FROM s JOIN p USING (year)""")
def shrunk_features(spark, d):
    from orderloom.operators.stats import wmean

    s = supplier_years(spark, d)
    j = s.join(s.groupBy("year").agg(wmean("qty", "lines").alias("prior")), "year")
    n = F.col("lines").cast("double")
    return rounded(j.select("supp", "year", F.round(numbers.shrink(F.col("qty"), n, F.col("prior"), 20.0), 4).alias("sh_qty"), (n / (n + 20.0)).alias("sh_weight")))


@book.query("""WITH m AS (SELECT conv_id, role, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role THEN 1 ELSE 0 END AS c FROM conversations), i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM m), n AS (SELECT conv_id, k, count(*) AS n FROM i GROUP BY 1, 2)
SELECT conv_id, max(k)::BIGINT AS tr_changes, arg_max(n, k) AS tr_final FROM n GROUP BY 1""")
def transfers_features(spark, d):
    """Number of changes and length of the final run."""
    i = windows.islands(table(spark, d, "conversations", ["conv_id", "role", "turn"]), "role", ["conv_id"], F.col("turn"))
    return rounded(i.groupBy("conv_id", "island").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.max("island").alias("tr_changes"), F.max_by("n", "island").alias("tr_final")))


@book.query("""WITH q AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), x AS (SELECT event_id, user_id, event_type, value, lag(value) OVER w AS p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(avg(value) FILTER (p < m), 6) AS rs_after_low, round(avg(value) FILTER (k > 1), 6) AS rs_rematch, round(corr(value, p), 6) AS rs_auto FROM x JOIN q USING (user_id) GROUP BY 1""")
def response_features(spark, d):
    """D17 in one sort of the event log."""
    e = table(spark, d, "events", ["event_id", "user_id", "event_type", "ts", "value"])
    w, m = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    x = e.withColumns({"p": F.lag("value").over(w), "m": F.avg("value").over(Window.partitionBy("user_id")), "k": F.row_number().over(m)})
    return rounded(x.groupBy("user_id").agg(F.avg(F.when(F.col("p") < F.col("m"), F.col("value"))).alias("rs_after_low"), F.avg(F.when(F.col("k") > 1, F.col("value"))).alias("rs_rematch"), corr("value", "p").alias("rs_auto")))


@book.query("""WITH d AS (SELECT user_id, ts::DATE AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT day, sum(v) AS tv, sum(n) AS tn FROM d GROUP BY 1)
SELECT user_id, round(sum(v) / sum(n), 6) AS g_mean, round(sum(v / tv) / count(*), 6) AS g_share, round(sum(v * v) / (sum(v) * sum(v)), 6) AS g_hhi, count(*) AS g_days FROM d JOIN t USING (day) GROUP BY 1""")
def game_context_features(spark, d):
    e = table(spark, d, "events", ["user_id", "ts", "value"])
    g = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    x = g.withColumn("s", windows.share("v", ["day"]))
    from orderloom.operators.stats import hhi, ratio

    return rounded(x.groupBy("user_id").agg(ratio("v", "n").alias("g_mean"), F.avg("s").alias("g_share"), hhi("v").alias("g_hhi"), F.count("*").alias("g_days")))


@book.query(f"WITH {SUPPLIER_YEARS}, j AS (SELECT s.*, s_nationkey AS team FROM s JOIN supplier ON supp = s_suppkey) SELECT supp, year, round(qty / sum(qty) OVER w, 6) AS t_share, round((sum(qty) OVER w - qty) / nullif(count(*) OVER w - 1, 0), 4) AS t_mates, round((qty - avg(qty) OVER w) / nullif(stddev_samp(qty) OVER w, 0), 6) AS t_z FROM j WINDOW w AS (PARTITION BY team, year)")
def season_context_features(spark, d):
    """Share of the team, mean of the team mates, distance from them."""
    s = supplier_years(spark, d).join(table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]), F.col("supp") == F.col("s_suppkey"))
    by = ["s_nationkey", "year"]
    return rounded(s.select("supp", "year", windows.share("qty", by).alias("t_share"), F.round(windows.leave_one_out("qty", by), 4).alias("t_mates"), windows.zscore("qty", by).alias("t_z")))


@book.query(f"WITH {SUPPLIER_YEARS}, p AS (SELECT a.supp, a.year, b.qty - a.qty AS d FROM s a JOIN s b ON a.supp = b.supp AND b.year = a.year + 1), y AS (SELECT year, sum(d) AS sd, count(*) AS n FROM p GROUP BY 1) SELECT DISTINCT s.year, round((SELECT sum(sd) / sum(n) FROM y WHERE y.year + 1 < s.year), 4) AS dv_prior FROM s")
def development_priors(spark, d):
    """Mean gain of consecutive pairs that were complete before each year."""
    s = supplier_years(spark, d)
    w = Window.partitionBy("supp").orderBy("year")
    pairs = s.withColumns({"n": F.lead("year").over(w), "q": F.lead("qty").over(w)}).filter("n = year + 1")
    y = pairs.groupBy((F.col("year") + 2).alias("year")).agg(F.sum(F.col("q") - F.col("qty")).alias("g"), F.count("*").alias("k"))
    years = s.select("year").distinct().join(y, "year", "full")  # a few years
    c = Window.partitionBy(F.lit(1)).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    out = years.select("year", nulls.sdiv(F.sum("g").over(c), F.sum("k").over(c)).alias("dv_prior"))
    return rounded(out.join(s.select("year").distinct(), "year", "left_semi"), 4)


@book.query(f"WITH {SUPPLIER_YEARS}, c AS (SELECT s_nationkey AS coach, year, avg(qty) AS m, count(*) AS n FROM s JOIN supplier ON supp = s_suppkey GROUP BY 1, 2) SELECT coach::BIGINT AS coach, year, round(sum(m * n) OVER w / sum(n) OVER w, 4) AS co_record FROM c WINDOW w AS (PARTITION BY coach ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def coach_track_record(spark, d):
    """What earlier cohorts of a program became; nothing of the own year."""
    s = supplier_years(spark, d).join(table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]), F.col("supp") == F.col("s_suppkey"))
    c = s.groupBy(F.col("s_nationkey").alias("coach"), "year").agg(F.avg("qty").alias("m"), F.count("*").alias("n"))
    w = windows.before(["coach"], F.col("year"))
    return rounded(c.select("coach", "year", nulls.sdiv(F.sum(F.col("m") * F.col("n")).over(w), F.sum("n").over(w)).alias("co_record")), 4)


# -- models and resampling ------------------------------------------------------------------


def _rows(spark, d):
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    return member_values(spark, d).join(c, F.col("entity") == F.col("c_custkey")).drop("c_custkey")


def _ridge_sql() -> str:
    """Moments of earlier cohorts, then a three by three system by Cramer's rule."""
    x = ("c_acctbal", "c_nationkey::DOUBLE", "1.0::DOUBLE")
    sums = ", ".join([f"sum({x[i]} * {x[j]}) AS c{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum({x[i]} * value) AS b{i}" for i in range(3)])
    past = ", ".join(f"sum({c}) OVER w AS {c}" for c in [*(f"c{i}{j}" for i in range(3) for j in range(i, 3)), "b0", "b1", "b2"])
    cell = lambda i, j: f"(c{min(i, j)}{max(i, j)}{' + 1' if i == j else ''})"

    def det(replaced: int | None) -> str:
        at = lambda i, j: f"b{i}" if j == replaced else cell(i, j)
        return f"({at(0, 0)} * ({at(1, 1)} * {at(2, 2)} - {at(1, 2)} * {at(2, 1)}) - {at(0, 1)} * ({at(1, 0)} * {at(2, 2)} - {at(1, 2)} * {at(2, 0)}) + {at(0, 2)} * ({at(1, 0)} * {at(2, 1)} - {at(1, 1)} * {at(2, 0)}))"

    fit = ", ".join(f"{det(k)} / {det(None)} AS w{k}" for k in range(3))
    return f"""WITH {MEMBERS}, x AS (SELECT v.*, c_acctbal, c_nationkey FROM v JOIN customer ON entity = c_custkey), g AS (SELECT cohort, {sums} FROM x GROUP BY 1), p AS (SELECT cohort, {past} FROM g WINDOW w AS (ORDER BY cohort ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT cohort, {fit} FROM p) SELECT cohort, entity, round(w0 * c_acctbal + w1 * c_nationkey + w2, 2) AS score FROM x JOIN f USING (cohort)"""


@book.query(_ridge_sql())
def ridge_cohort_fit(spark, d):
    """Each cohort scored by a model of the cohorts before it."""
    return rounded(models.causal_scores(_rows(spark, d), ["c_acctbal", "c_nationkey"], "value", "cohort").select("cohort", "entity", "score"), 2)


@book.query()
def gbt_cohort_fit(spark, d):
    """M3 through the plug-in table: every cohort behind the training ones."""
    x = _rows(spark, d)
    return rounded(models.FAMILIES["gbt"](x.filter("cohort <= 1998"), x.filter("cohort > 1998"), ["c_acctbal", "c_nationkey"], "value").select("cohort", "entity", "score"), 2)


@book.query("""WITH t AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 5 <> 0), p AS (SELECT a.vec_id, b.vec_id AS o, b.label AS y, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN t b ON a.vec_id <> b.vec_id WHERE a.vec_id % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS k FROM p) SELECT vec_id, round(sum(y / (d + 1e-9)) / sum(1 / (d + 1e-9)), 5) AS score FROM r WHERE k <= 5 GROUP BY 1""")
def knn_weighted(spark, d):
    """M2; fold 0 is scored by the other four."""
    e = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return rounded(models.knn(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "embedding", "label", "vec_id"), 5)


def _draw_sql(seed: int, *keys: str) -> str:
    """``sampling.draw`` as SQL."""
    return f"('0x' || substr(md5({' || '.join([*(chr(39).join([f'{k} || ', '|', '']) for k in keys), repr(str(seed))])}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


ROWS = f"WITH {MEMBERS}, x AS (SELECT v.*, c_acctbal, c_nationkey FROM v JOIN customer ON entity = c_custkey)"


@book.query(f"""{ROWS}, d AS (SELECT x.*, replicate, {_draw_sql(0, 'entity', 'replicate')} AS u FROM x, (SELECT unnest(range(1, 21)) AS replicate)),
n AS (SELECT *, (u >= 0.36787944)::INT + (u >= 0.73575888)::INT + (u >= 0.91969860)::INT + (u >= 0.98101184)::INT + (u >= 0.99634015)::INT AS n FROM d), k AS (SELECT cohort, replicate, value, c_acctbal, unnest(range(n)) AS k FROM n WHERE n > 0),
r AS (SELECT cohort, replicate, {rank_sql('c_acctbal', 'replicate, cohort')} AS a, {rank_sql('value', 'replicate, cohort')} AS b FROM k), e AS (SELECT replicate, cohort, corr(a, b) AS rho FROM r GROUP BY 1, 2) SELECT replicate, round(avg(rho), 6) AS mean_rho FROM e GROUP BY 1""")
def bootstrap_gap(spark, d):
    return rounded(sampling.bootstrap(_rows(spark, d), "cohort", "entity", "c_acctbal", "value", 20))


@book.query(f"""{ROWS}, a AS (SELECT cohort, c_acctbal, row_number() OVER (PARTITION BY cohort ORDER BY entity) AS i FROM x), b AS (SELECT cohort, value, row_number() OVER (PARTITION BY cohort ORDER BY {_draw_sql(0, 'entity')}, entity) AS i FROM x),
j AS (SELECT cohort, c_acctbal, value FROM a JOIN b USING (cohort, i)), r AS (SELECT cohort, {rank_sql('value', 'cohort')} AS u, {rank_sql('c_acctbal', 'cohort')} AS w FROM j) SELECT cohort, count(*) AS n, round(corr(u, w), 6) AS rho FROM r GROUP BY 1""")
def permutation_null(spark, d):
    from orderloom.operators.stats import spearman

    return rounded(spearman(sampling.permuted(_rows(spark, d), ["cohort"], "entity", "value"), "value", "c_acctbal", ["cohort"]))


@book.query(f"""{ROWS}, m AS (SELECT *, {_draw_sql(1, 'entity')} AS s, coalesce(lead(value) OVER w, value) AS v2, coalesce(lead(c_acctbal) OVER w, c_acctbal) AS b2 FROM x WINDOW w AS (PARTITION BY cohort ORDER BY {_draw_sql(0, 'entity')}, entity))
SELECT cohort, entity, round(s * value + (1 - s) * v2, 6) AS value, round(s * c_acctbal + (1 - s) * b2, 6) AS c_acctbal FROM m""")
def mixup_rows(spark, d):
    return rounded(sampling.mixup(_rows(spark, d), ["cohort"], "entity", ["value", "c_acctbal"]).select("cohort", "entity", "value", "c_acctbal"))


@book.query("SELECT entity, count(*) AS n FROM (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
def folds_cover_members(spark, d):
    """Seeded folds split rows without losing any."""
    x = _rows(spark, d).withColumn("fold", sampling.folds("entity", 3))
    parts = [x.filter(F.col("fold") == i).groupBy("entity").agg(F.count("*").alias("n")) for i in range(3)]
    return parts[0].union(parts[1]).union(parts[2])
