"""Sources, projections, joins, sets and reshaping."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from orderloom.functions import lists, nulls
from orderloom.operators import dedup, pit, resolve, stats, windows
from orderloom.plans.base import MEMBERS, SUPPLIER_YEARS, Book, member_values, rounded, supplier_years
from orderloom.sources import readers
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql


@book.query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') GROUP BY 1")
def scan_prune_pushdown(spark, d):
    l = table(spark, d, "lineitem", ["l_returnflag", "l_shipdate", "l_quantity"])  # noqa: E741
    kept = l.filter((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")) & F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R"))
    return rounded(kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")), 4)


@book.query("SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT 'p', p_partkey, NULL, p_brand FROM part")
def file_union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    p = table(spark, d, "part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return c.unionByName(p, allowMissingColumns=True)


@book.query("""SELECT (json_extract_string(props, '$.k'))::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def json_props_extract(spark, d):
    e = table(spark, d, "events", ["props", "value"]).withColumn("p", F.from_json("props", "k long"))
    return rounded(e.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@book.query("SELECT event_id, user_id, event_type FROM events")
def header_rowset_zip(spark, d):
    """Documents of headers and rows, read by header name."""
    doc = event_documents(table(spark, d, "events", ["event_id", "user_id", "event_type"]))
    return doc.select(F.inline(readers.header_rows(F.col("doc"), {"EVENT_ID": "bigint", "USER_ID": "bigint", "EVENT_TYPE": "string"})))


def event_documents(e):
    """(g, doc): one document for each stretch of 1,000 event ids, so that none grows with the table."""
    row = F.array(F.col("event_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    return e.groupBy(F.floor(F.col("event_id") / 1000).alias("g")).agg(F.to_json(F.struct(F.array(F.lit("EVENT_TYPE"), F.lit("EVENT_ID"), F.lit("USER_ID")).alias("headers"), F.collect_list(row).alias("rowSet"))).alias("doc"))


@book.query("""SELECT c_custkey, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'balance' WHEN b IS NOT NULL THEN 'nation' WHEN c IS NOT NULL THEN 'key' END AS source FROM
(SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS a, CASE WHEN c_nationkey > 12 THEN c_nationkey::DOUBLE END AS b, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE END AS c FROM customer)""")
def coalesce_chain_with_source(spark, d):
    value, source = nulls.first_of(("balance", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal"))), ("nation", F.when(F.col("c_nationkey") > 12, F.col("c_nationkey").cast("double"))), ("key", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("double"))))
    return table(spark, d, "customer").select("c_custkey", value.alias("value"), source.alias("source"))


@book.query("SELECT CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS class, count(*) AS n FROM orders GROUP BY 1")
def when_classify(spark, d):
    c = F.when(F.col("o_totalprice") > 300000, "big").when(F.col("o_totalprice") > 100000, "mid").otherwise("small")
    return table(spark, d, "orders", ["o_totalprice"]).groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@book.query("SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 0 AND 1500 THEN p_retailprice END AS price, CASE WHEN p_size >= 10 THEN p_retailprice END AS gated FROM part")
def ceiling_null_row_gate(spark, d):
    return table(spark, d, "part").select("p_partkey", nulls.plausible("p_retailprice", 0, 1500).alias("price"), nulls.gate("p_retailprice", F.col("p_size") >= 10).alias("gated"))


@book.query("""SELECT p_partkey, CASE WHEN cell = 'NA' THEN NULL WHEN cell IS NULL OR cell = '' THEN p_retailprice ELSE try_cast(cell AS DOUBLE) END AS price FROM part LEFT JOIN
(SELECT p_partkey AS pid, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'NA' ELSE '3.5' END AS cell FROM part WHERE p_partkey % 3 = 0) ON pid = p_partkey""")
def cell_patch_three_state(spark, d):
    p = table(spark, d, "part")
    cells = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("pid"), F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, "NA").otherwise("3.5").alias("cell"))
    return p.join(cells, F.col("pid") == F.col("p_partkey"), "left").select("p_partkey", nulls.patch("p_retailprice", "cell").alias("price"))


@book.query("""WITH x AS (SELECT CASE WHEN l_quantity > 25 THEN l_discount END AS a, CASE WHEN l_quantity > 45 THEN l_tax END AS b, l_quantity AS c FROM lineitem)
SELECT 'a' AS "column", round(count(a) / count(*), 6) AS present, count(DISTINCT a) AS "distinct" FROM x UNION ALL SELECT 'b', round(count(b) / count(*), 6), count(DISTINCT b) FROM x UNION ALL SELECT 'c', round(count(c) / count(*), 6), count(DISTINCT c) FROM x""")
def coverage_by_group(spark, d):
    l = table(spark, d, "lineitem", ["l_quantity", "l_discount", "l_tax"])  # noqa: E741
    x = l.select(F.when(F.col("l_quantity") > 25, F.col("l_discount")).alias("a"), F.when(F.col("l_quantity") > 45, F.col("l_tax")).alias("b"), F.col("l_quantity").alias("c"))
    return rounded(stats.coverage(x, ["a", "b", "c"]))


@book.query("""SELECT CASE WHEN y < 1997 THEN 'early' WHEN y < 1999 THEN 'mid' ELSE 'late' END AS band, count(*) AS n, round(count(CASE WHEN o_totalprice > 100000 THEN 1 END) / count(*), 6) AS priced FROM (SELECT year(o_orderdate) AS y, o_totalprice FROM orders) GROUP BY 1""")
def coverage_banded(spark, d):
    y = F.year("o_orderdate")
    band = F.when(y < 1997, "early").when(y < 1999, "mid").otherwise("late")
    o = table(spark, d, "orders", ["o_orderdate", "o_totalprice"])
    return rounded(o.groupBy(band.alias("band")).agg(F.count("*").alias("n"), (F.count(nulls.gate("o_totalprice", F.col("o_totalprice") > 100000)) / F.count("*")).alias("priced")))


def _rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0"


@book.query(f"""WITH r AS (SELECT l_returnflag, {_rank('l_extendedprice')} AS t, {_rank('l_quantity')} AS q, {_rank('l_discount')} AS d, {_rank('l_tax')} AS x FROM lineitem),
e AS (SELECT 'l_quantity' AS "column", l_returnflag, count(*) AS n, corr(q, t) AS rho FROM r GROUP BY 2 UNION ALL SELECT 'l_discount', l_returnflag, count(*), corr(d, t) FROM r GROUP BY 2 UNION ALL SELECT 'l_tax', l_returnflag, count(*), corr(x, t) FROM r GROUP BY 2)
SELECT "column", sum(n)::BIGINT AS n, round(sum(n * rho) / sum(n), 5) AS rho FROM e GROUP BY 1""")
def topk_by_abs_spearman(spark, d):
    s = stats.screen(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_returnflag")
    return rounded(s.orderBy(F.desc(F.abs("rho"))).limit(3), 5)


@book.query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_inner_chain(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(j.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance")), 4)


@book.query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1")
def join_left(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]).filter("o_totalprice > 400000")
    return table(spark, d, "customer", ["c_custkey"]).join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@book.query("SELECT coalesce(c_nationkey, s_nationkey)::BIGINT AS nation, c AS customers, s AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey < 15 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_nationkey > 5 GROUP BY 1) ON c_nationkey = s_nationkey")
def join_full(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return rounded(c.join(s, "nation", "full"))


@book.query("SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS semi, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)) AS anti")
def join_semi_anti(spark, d):
    c = table(spark, d, "customer", ["c_custkey"])
    o = table(spark, d, "orders", ["o_custkey"]).select(F.col("o_custkey").alias("c_custkey"))
    # equality partial aggregates of one row each
    return c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("semi")).join(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("anti")), F.lit(True))


@book.query("SELECT count(*) AS plain, (SELECT count(*) FROM (SELECT nullif(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 0) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k) AS null_safe FROM (SELECT nullif(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 0) AS k FROM region) b ON a.k = b.k")
def null_key_semantics(spark, d):
    a = table(spark, d, "nation").select(F.nullif("n_regionkey", F.lit(0)).alias("k"))
    b = table(spark, d, "region").select(F.nullif("r_regionkey", F.lit(0)).alias("j"))
    return a.join(b, F.col("k") == F.col("j")).agg(F.count("*").alias("plain")).join(a.join(b, F.col("k").eqNullSafe(F.col("j"))).agg(F.count("*").alias("null_safe")), F.lit(True))


@book.query(f"WITH {SUPPLIER_YEARS} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(s.revenue, 4) AS revenue FROM lineitem LEFT JOIN s ON supp = l_suppkey AND year = year(l_shipdate) - 1")
def lookup_composite_gather(spark, d):
    l = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"])  # noqa: E741
    s = supplier_years(spark, d).select(F.col("supp").alias("l_suppkey"), (F.col("year") + 1).alias("y"), "revenue")
    return rounded(l.withColumn("y", F.year("l_shipdate")).join(s, ["l_suppkey", "y"], "left").select("l_orderkey", "l_linenumber", "revenue"), 4)


@book.query("""WITH g AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT a.l_orderkey, a.l_returnflag, round(a.q, 4) AS own, round(sum(b.q), 4) AS other FROM g a LEFT JOIN g b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag <> b.l_returnflag GROUP BY 1, 2, 3""")
def own_vs_opponent(spark, d):
    """Own and others' totals of the same fact without a self-join."""
    from pyspark.sql import Window

    g = table(spark, d, "lineitem", ["l_orderkey", "l_returnflag", "l_quantity"]).groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("own"))
    w = Window.partitionBy("l_orderkey")
    return rounded(g.withColumn("other", F.when(F.count("*").over(w) > 1, F.sum("own").over(w) - F.col("own"))), 4)


@book.query(f"WITH {SUPPLIER_YEARS} SELECT a.supp, a.year, round(a.qty - b.qty, 4) AS d1, round(a.qty - c.qty, 4) AS d2 FROM s a LEFT JOIN s b ON a.supp = b.supp AND b.year = a.year - 1 LEFT JOIN s c ON a.supp = c.supp AND c.year = a.year - 2")
def self_join_prev_period(spark, d):
    s = supplier_years(spark, d)
    p = pit.previous(s, ["supp"], "year", ["qty"], 1).withColumnRenamed("prev_qty", "p1")
    p = pit.previous(p.join(s.select("supp", "year"), ["supp", "year"]), ["supp"], "year", ["qty"], 2)
    return rounded(p.select("supp", "year", (F.col("qty") - F.col("p1")).alias("d1"), (F.col("qty") - F.col("prev_qty")).alias("d2")), 4)


@book.query(f"WITH {SUPPLIER_YEARS} SELECT a.supp, a.year, round(avg(b.qty), 6) AS career_qty, max(b.lines) AS career_lines FROM s a JOIN s b ON a.supp = b.supp AND b.year <= a.year GROUP BY 1, 2")
def history_until(spark, d):
    w = windows.until_now(["supp"], F.col("year"))
    return rounded(supplier_years(spark, d).select("supp", "year", F.avg("qty").over(w).alias("career_qty"), F.max("lines").over(w).alias("career_lines")))


@book.query(f"WITH {MEMBERS}, f AS (SELECT entity, min(cohort) AS debut FROM v GROUP BY 1) SELECT f.entity, f.debut, round(coalesce(sum(v.value), 0), 4) AS total FROM f LEFT JOIN v ON v.entity = f.entity AND v.cohort > f.debut AND v.cohort <= f.debut + 3 GROUP BY 1, 2")
def validity_window_join(spark, d):
    v = member_values(spark, d)
    f = v.groupBy("entity").agg(F.min("cohort").alias("debut"))
    j = pit.valid_between(f, v, ["entity"], (F.col("r.cohort") > F.col("l.debut")) & (F.col("r.cohort") <= F.col("l.debut") + 3), "left")
    return rounded(j.groupBy(F.col("l.entity").alias("entity"), F.col("l.debut").alias("debut")).agg(F.coalesce(F.sum("r.value"), F.lit(0.0)).alias("total")), 4)


@book.query("""SELECT l.event_id, CASE WHEN r.ts >= l.ts - INTERVAL 2 DAY THEN r.event_id END AS seen FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_tolerance(spark, d):
    e = table(spark, d, "events", ["event_id", "user_id", "ts", "event_type"])
    l = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")  # noqa: E741
    r = e.filter("event_type = 'view'").select("user_id", "ts", "event_id")
    return pit.as_of(l, r, "user_id", "ts", "ts", "2 days", "event_id").select("event_id", F.col("r_event_id").alias("seen"))


@book.query(f"WITH {SUPPLIER_YEARS}, r AS (SELECT *, row_number() OVER (PARTITION BY supp ORDER BY year DESC) AS k FROM s WHERE year BETWEEN 1996 AND 1998) SELECT supp, year, round(qty, 4) AS qty FROM r WHERE k = 1")
def latest_within_n_years(spark, d):
    return rounded(pit.latest_within(supplier_years(spark, d), ["supp"], "year", F.lit(1998), 2, []).select("supp", "year", "qty"), 4)


@book.query("""WITH o AS (SELECT year(o_orderdate)::BIGINT AS year, o_orderpriority AS source, o_totalprice FROM orders), g AS (SELECT year, source FROM (SELECT DISTINCT year FROM o WHERE year IS NOT NULL), (SELECT DISTINCT source FROM o WHERE source IS NOT NULL))
SELECT year, source, count(o.o_totalprice) AS n, round(coalesce(sum(o.o_totalprice), 0), 2) AS total FROM g LEFT JOIN o USING (year, source) GROUP BY 1, 2""")
def config_grid(spark, d):
    """The grid of years and sources, empty cells included; both lists are short, and the grid grows with them alone."""
    o = table(spark, d, "orders", ["o_orderdate", "o_orderpriority", "o_totalprice"]).select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("source"), "o_totalprice")
    cells = o.groupBy("year", "source").agg(F.count("o_totalprice").alias("n"), F.sum("o_totalprice").alias("total"))
    grid = lists.grid(cells, ["year", "source"]).join(cells, ["year", "source"], "left")
    return grid.select("year", "source", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@book.query("(SELECT c_nationkey::BIGINT AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey::BIGINT, 'both' FROM supplier) UNION ALL (SELECT n_nationkey::BIGINT, 'no supplier' FROM nation EXCEPT SELECT s_nationkey::BIGINT, 'no supplier' FROM supplier)")
def except_intersect_sets(spark, d):
    k = lambda t, c, kind: table(spark, d, t).select(F.col(c).cast("long").alias("k"), F.lit(kind).alias("kind"))
    return k("customer", "c_nationkey", "both").intersect(k("supplier", "s_nationkey", "both")).union(k("nation", "n_nationkey", "no supplier").subtract(k("supplier", "s_nationkey", "no supplier")))


@book.query("WITH a AS (SELECT c_nationkey AS nation, c_custkey AS id FROM customer WHERE c_nationkey < 10), b AS (SELECT s_nationkey AS nation, s_suppkey AS id FROM supplier) SELECT nation::BIGINT AS nation, id FROM a UNION ALL SELECT nation, id FROM b WHERE nation NOT IN (SELECT nation FROM a)")
def fill_union_antijoin(spark, d):
    a = table(spark, d, "customer").filter("c_nationkey < 10").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return rounded(dedup.fill_union(a, b, ["nation"]))


@book.query("SELECT team, count(*) AS n, round(sum(q), 4) AS qty FROM (SELECT l_suppkey AS team, l_quantity AS q FROM lineitem UNION ALL SELECT l_partkey, -l_quantity FROM lineitem) GROUP BY 1")
def both_sides_union(spark, d):
    l = table(spark, d, "lineitem", ["l_suppkey", "l_partkey", "l_quantity"])  # noqa: E741
    both = l.select(F.explode(F.array(F.struct(F.col("l_suppkey").alias("team"), F.col("l_quantity").alias("q")), F.struct(F.col("l_partkey").alias("team"), (-F.col("l_quantity")).alias("q")))).alias("s"))
    return rounded(both.groupBy("s.team").agg(F.count("*").alias("n"), F.sum("s.q").alias("qty")), 4)


@book.query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (a = 1) AS first_order, max(o_orderkey) FILTER (b = 1) AS last_order, max(o_orderkey) FILTER (n = 1) AS only_order FROM r GROUP BY 1""")
def dedup_keep_first_last_none(spark, d):
    o = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate"])
    key = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("first_order"), F.max_by("o_orderkey", key).alias("last_order"), F.when(F.count("*") == 1, F.max("o_orderkey")).alias("only_order"))


@book.query("""SELECT user_id, arg_min(value, ts) FILTER (event_type = 'view') AS view_value, arg_min(value, ts) FILTER (event_type = 'error') AS error_value FROM (SELECT user_id, event_type, (epoch_us(ts)::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS ts, value FROM events) GROUP BY 1""")
def merge_first_present(spark, d):
    """U8: the first present value of each column after a sort."""
    e = table(spark, d, "events", ["event_id", "user_id", "ts", "event_type", "value"])
    x = e.select("user_id", F.struct("ts", "event_id").alias("o"), *(F.when(F.col("event_type") == k, F.col("value")).alias(f"{k}_value") for k in ("view", "error")))
    return dedup.merge_records(x, ["user_id"], F.col("o"), ["view_value", "error_value"])


@book.query("PIVOT (SELECT o_orderpriority, year(o_orderdate) AS y, o_totalprice FROM orders) ON y IN (1995, 1996, 2050) USING round(sum(o_totalprice), 2) GROUP BY o_orderpriority")
def pivot_fixed(spark, d):
    o = table(spark, d, "orders", ["o_orderpriority", "o_orderdate", "o_totalprice"]).withColumn("y", F.year("o_orderdate"))
    return rounded(o.groupBy("o_orderpriority").pivot("y", [1995, 1996, 2050]).agg(F.sum("o_totalprice")), 2)


@book.query("""WITH w AS (SELECT o_custkey, sum(o_totalprice) FILTER (year(o_orderdate) = 1995) AS y1, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS y2 FROM orders GROUP BY 1) SELECT o_custkey, 'y1' AS period, round(y1, 2) AS value FROM w WHERE y1 IS NOT NULL UNION ALL SELECT o_custkey, 'y2', round(y2, 2) FROM w WHERE y2 IS NOT NULL""")
def unpivot_periods(spark, d):
    y = F.year("o_orderdate")
    w = table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"]).groupBy("o_custkey").agg(F.sum(F.when(y == 1995, F.col("o_totalprice"))).alias("y1"), F.sum(F.when(y == 1996, F.col("o_totalprice"))).alias("y2"))
    return rounded(w.unpivot(["o_custkey"], ["y1", "y2"], "period", "value").filter("value is not null"), 2)


@book.query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk_global(spark, d):
    """A top-k report: the limit is the feature."""
    l = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"])  # noqa: E741
    return rounded(l.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25))


@book.query("SELECT l_suppkey, round(sum(p), 4) AS top3 FROM (SELECT l_suppkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 3 GROUP BY 1")
def nlargest_sum(spark, d):
    l = table(spark, d, "lineitem", ["l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber"])  # noqa: E741
    return rounded(windows.top_k(l, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("top3")), 4)


@book.query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k % 10 = 0")
def every_nth(spark, d):
    k = windows.ordinal(["p_brand"], F.col("p_retailprice"), F.col("p_partkey"))
    return table(spark, d, "part").withColumn("k", k).filter("k % 10 = 0").select("p_brand", "p_partkey")


def _ladder_sides(spark, d):
    c = table(spark, d, "customer", ["c_custkey", "c_name"])
    other = c.filter("c_custkey % 2 = 0").select((F.col("c_custkey") + 100000).alias("oid"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(F.concat(F.lower("c_name"), F.lit(" jr"))).alias("name"))
    return c, other


@book.query("""WITH o AS (SELECT c_custkey + 100000 AS oid, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE lower(c_name) || ' jr' END AS name FROM customer WHERE c_custkey % 2 = 0),
e AS (SELECT c_custkey, oid FROM customer JOIN o ON c_name = name), k AS (SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS x FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM e)),
j AS (SELECT oid, regexp_replace(regexp_replace(lower(name), '\\b(jr|sr)\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS x FROM o WHERE oid NOT IN (SELECT oid FROM e))
SELECT c_custkey, oid, 'exact' AS method, 1.0::DOUBLE AS confidence FROM e UNION ALL SELECT c_custkey, oid, 'cleaned', 0.8::DOUBLE FROM k JOIN j USING (x)""")
def ladder_match_unique(spark, d):
    c, o = _ladder_sides(spark, d)
    clean = lambda n: F.regexp_replace(F.regexp_replace(F.lower(n), r"\b(jr|sr)\b", ""), "[^a-z0-9]", "")
    return resolve.ladder(c, o, "c_custkey", "oid", [("exact", 1.0, F.col("c_name"), F.col("name")), ("cleaned", 0.8, clean("c_name"), clean("name"))])


@book.query("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY o_custkey) AS share, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM n)
SELECT o_custkey, o_orderpriority, n, round(share, 6) AS share FROM s WHERE k = 1 AND n >= 3 AND share >= 0.3""")
def majority_vote_map(spark, d):
    return rounded(resolve.majority(table(spark, d, "orders", ["o_custkey", "o_orderpriority"]), "o_custkey", "o_orderpriority", 3, 0.3))


@book.query("""WITH l AS (SELECT s_suppkey, s_nationkey, replace(s_name, '0', 'o') AS x FROM supplier), r AS (SELECT s_suppkey AS rid, s_nationkey, s_name AS y FROM supplier),
p AS (SELECT l.s_suppkey, rid, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1) AS score FROM l JOIN r USING (s_nationkey)),
k AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nx FROM p WINDOW w AS (PARTITION BY s_suppkey ORDER BY score DESC, rid))
SELECT s_suppkey, rid, round(score, 6) AS score FROM k WHERE n = 1 AND score >= 0.4 AND score - coalesce(nx, 0) >= 0.01""")
def fuzzy_in_block(spark, d):
    s = table(spark, d, "supplier")
    r = s.select(F.col("s_suppkey").alias("rid"), "s_nationkey", "s_name")
    return rounded(resolve.fuzzy_in_block(s, r, "s_suppkey", "rid", (F.col("s_nationkey"), F.col("s_nationkey")), (F.replace("s_name", F.lit("0"), F.lit("o")), F.col("s_name")), 0.4, 0.01))


@book.query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT a.source AS short, b.source AS long, b.n FROM s a JOIN s b ON substr(a.source, 1, 4) = substr(b.source, 1, 4) AND starts_with(b.source, a.source) AND a.source <> b.source")
def prefix_match(spark, d):
    """Each name meets those that are a beginning of it."""
    s = table(spark, d, "documents", ["source"]).groupBy(F.col("source").alias("long")).agg(F.count("*").alias("n"))
    pairs = resolve.prefix_pairs(s.select(F.col("long").alias("short")), s, "short", "long", 4).filter("short <> long")
    return pairs.join(s, "long").select("short", "long", "n")


@book.query("""WITH a AS (SELECT 'GERMANY' AS alias, 7 AS k UNION ALL SELECT 'FRANCE', 6), x AS (SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'GERMANY' WHEN c_nationkey = 6 THEN 'FRANCE' ELSE n_name END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, coalesce(n_nationkey, k)::BIGINT AS nation, CASE WHEN n_nationkey IS NOT NULL THEN 'name' WHEN k IS NOT NULL THEN 'alias' ELSE 'none' END AS how FROM x LEFT JOIN nation ON label = n_name LEFT JOIN a ON label = alias""")
def alias_resolution(spark, d):
    """By name, then by a small table of aliases."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    x = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_nationkey") == 7, "GERMANY").when(F.col("c_nationkey") == 6, "FRANCE").otherwise(F.col("n_name")).alias("label"))
    alias = spark.createDataFrame([("GERMANY", 7), ("FRANCE", 6)], "alias string, k int")
    j = x.join(n, F.col("label") == F.col("n_name"), "left").join(F.broadcast(alias), F.col("label") == F.col("alias"), "left")  # two fixed rows
    how = F.when(F.col("n_nationkey").isNotNull(), "name").when(F.col("k").isNotNull(), "alias").otherwise("none")
    return rounded(j.select("c_custkey", F.coalesce("n_nationkey", "k").alias("nation"), how.alias("how")))


@book.query("SELECT c_custkey, CASE WHEN o > 0 THEN 1 WHEN c_nationkey < 20 THEN 0 END::BIGINT AS flag FROM (SELECT c_custkey, c_nationkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) AS o FROM customer)")
def tri_state_flag(spark, d):
    """1 if matched, 0 if the source covers the member, else unknown."""
    o = table(spark, d, "orders", ["o_custkey", "o_totalprice"]).filter("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey"]).join(o, "c_custkey", "left")
    return rounded(c.select("c_custkey", F.when(F.col("hit") == 1, 1).when(F.col("c_nationkey") < 20, 0).alias("flag")))


@book.query("WITH k AS (SELECT c_custkey FROM customer) SELECT c_custkey, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS big, c.first_year FROM k LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) b ON b.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(year(o_orderdate)) AS first_year FROM orders GROUP BY 1) c ON c.o_custkey = c_custkey")
def join_chain_left(spark, d):
    """Many views of one key; those of one table share a single aggregate and shuffle."""
    o = table(spark, d, "orders", ["o_custkey", "o_totalprice", "o_orderdate"]).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > 200000).alias("big"), F.min(F.year("o_orderdate")).alias("first_year"))
    return functools.reduce(lambda a, b: a.join(b, "c_custkey", "left"), [o], table(spark, d, "customer", ["c_custkey"])).select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("big", F.lit(0)).alias("big"), F.col("first_year").cast("long"))
