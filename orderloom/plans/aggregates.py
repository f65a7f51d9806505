"""Aggregates, fits and event-sequence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions import numbers
from orderloom.functions.nulls import corr, sdiv
from orderloom.operators import stats, windows
from orderloom.plans.base import SUPPLIER_YEARS, Book, rounded, supplier_years
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql
EV = ["event_id", "ts", "user_id", "event_type", "value"]


def _events(spark, d):
    return table(spark, d, "events", EV)


ORD = "ORDER BY ts, event_id"


@book.query("SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS m FROM lineitem GROUP BY 1")
def wmean_by_group(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_suppkey").agg(stats.wmean("l_discount", "l_quantity").alias("m")))


@book.query("WITH m AS (SELECT l_suppkey, sum(l_quantity * l_discount) / sum(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT l_suppkey, round(sqrt(sum(l_quantity * l_quantity * (l_discount - m) * (l_discount - m))) / sum(l_quantity), 6) AS se, count(*) AS n FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1")
def wmean_se(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_suppkey").agg(stats.wmean_se("l_discount", "l_quantity").alias("se"), F.count("*").alias("n")))


@book.query("SELECT l_returnflag, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS r, round(avg(l_tax) FILTER (l_discount > 0.05), 6) AS hi, round(avg(l_tax) FILTER (l_discount <= 0.05), 6) AS lo, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1")
def ratio_and_side_by_side(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    hi = F.col("l_discount") > 0.05
    return rounded(l.groupBy("l_returnflag").agg(stats.ratio("l_extendedprice", "l_quantity").alias("r"), F.avg(F.when(hi, F.col("l_tax"))).alias("hi"), F.avg(F.when(~hi, F.col("l_tax"))).alias("lo"), F.count_if(F.col("l_linestatus") == "O").alias("open")))


@book.query("WITH g AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(sum(q * q) / (sum(q) * sum(q)), 6) AS hhi FROM g GROUP BY 1")
def hhi_concentration(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return rounded(g.groupBy("l_suppkey").agg(stats.hhi("q").alias("hhi")))


@book.query(f"WITH {SUPPLIER_YEARS} SELECT supp, year, round(qty / sum(qty) OVER (PARTITION BY supp), 6) AS share FROM s")
def share_of_total(spark, d):
    return rounded(supplier_years(spark, d).select("supp", "year", windows.share("qty", ["supp"]).alias("share")))


@book.query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.1), 4) AS q10, round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders GROUP BY 1")
def quantiles_exact(spark, d):
    o = table(spark, d, "orders", ["o_orderpriority", "o_totalprice"])
    return rounded(o.groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("med"), F.percentile("o_totalprice", F.lit(0.1)).alias("q10"), F.percentile("o_totalprice", F.lit(0.9)).alias("q90")), 4)


@book.query("WITH n AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS k FROM n) SELECT l_suppkey, l_linenumber::BIGINT AS m FROM r WHERE k = 1")
def mode_lowest(spark, d):
    return rounded(table(spark, d, "lineitem", ["l_suppkey", "l_linenumber"]).groupBy("l_suppkey").agg(F.mode("l_linenumber", True).alias("m")))


@book.query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY 1")
def argmax_row(spark, d):
    o = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice"])
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@book.query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def crosstab(spark, d):
    p = table(spark, d, "lineitem", ["l_returnflag", "l_linestatus"]).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@book.query("SELECT coalesce(o_orderpriority, 'ALL') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(o_orderpriority)::BIGINT AS is_total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def rollup_grand_total(spark, d):
    r = table(spark, d, "orders", ["o_orderpriority", "o_totalprice"]).rollup("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.grouping("o_orderpriority").alias("is_total"))
    return rounded(r.select(F.coalesce("o_orderpriority", F.lit("ALL")).alias("priority"), "n", "total", "is_total"), 2)


@book.query("SELECT user_id, count(DISTINCT event_type) AS kinds, list_aggregate(list_sort(list(DISTINCT event_type)), 'string_agg', ',') AS names FROM events GROUP BY 1")
def distinct_counts_and_lists(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"))


@book.query("SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 5) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def corr_pearson_slope(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(corr("l_quantity", "l_extendedprice").alias("r"), F.regr_slope("l_extendedprice", "l_quantity").alias("slope"))
    return g.select("l_suppkey", F.round("r", 5).alias("r"), F.round("slope", 4).alias("slope"))


@book.query(f"WITH x AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id {ORD}) AS p FROM events) SELECT user_id, round(corr(value, p), 6) AS r FROM x GROUP BY 1")
def autocorr_lag1(spark, d):
    x = _events(spark, d).withColumn("p", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rounded(x.groupBy("user_id").agg(corr("value", "p").alias("r")))


@book.query(f"""WITH {SUPPLIER_YEARS}, g AS (SELECT supp, sum(lines) AS sw, sum(lines * (year - 1995)) AS sx, sum(lines * qty) AS sy, sum(lines * (year - 1995) * qty) AS sxy, sum(lines * (year - 1995) * (year - 1995)) AS sxx FROM s GROUP BY 1)
SELECT supp, round((sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0), 4) AS slope FROM g""")
def wls_slope_sums(spark, d):
    s = supplier_years(spark, d).withColumn("x", (F.col("year") - 1995).cast("double"))
    return rounded(s.groupBy("supp").agg(stats.wls("x", "qty", F.col("lines").cast("double"))[0].alias("slope")), 4)


@book.query("""WITH f AS (SELECT regr_slope(l_extendedprice, ln(l_quantity)) AS b, regr_intercept(l_extendedprice, ln(l_quantity)) AS a FROM lineitem) SELECT l_returnflag, round(avg(l_extendedprice - (a + b * ln(l_quantity))), 2) AS residual FROM lineitem, f GROUP BY 1""")
def residualise_log(spark, d):
    """Two aggregates; the fit is one row and goes along as literals."""
    l = table(spark, d, "lineitem", ["l_returnflag", "l_quantity", "l_extendedprice"]).withColumn("x", F.ln("l_quantity"))  # noqa: E741
    f = l.agg(F.regr_slope("l_extendedprice", "x").alias("b"), F.regr_intercept("l_extendedprice", "x").alias("a")).first()
    return rounded(l.groupBy("l_returnflag").agg(F.avg(F.col("l_extendedprice") - (f["a"] + f["b"] * F.col("x"))).alias("residual")), 2)


@book.query("SELECT round(regr_slope(c, q), 6) AS slope, round(regr_intercept(c, q), 6) AS intercept FROM (SELECT sum(l_quantity) AS q, count(*)::DOUBLE AS c FROM lineitem GROUP BY l_suppkey)")
def calibration_fit(spark, d):
    g = table(spark, d, "lineitem", ["l_suppkey", "l_quantity"]).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("c"))
    slope, intercept = stats.wls("q", "c")
    return rounded(g.agg(slope.alias("slope"), intercept.alias("intercept")))


@book.query(f"""WITH {SUPPLIER_YEARS}, x0 AS (SELECT supp, year, qty AS y, lines::DOUBLE AS w, (year - 1998)::DOUBLE AS x, 1.0::DOUBLE AS p0 FROM s),
x1 AS (SELECT *, x - sum(w * x) OVER () / sum(w) OVER () AS p1 FROM x0), x2 AS (SELECT *, (x - sum(w * x * p1 * p1) OVER () / sum(w * p1 * p1) OVER ()) * p1 - sum(w * p1 * p1) OVER () / sum(w) OVER () AS p2 FROM x1),
x3 AS (SELECT *, (x - sum(w * x * p2 * p2) OVER () / sum(w * p2 * p2) OVER ()) * p2 - sum(w * p2 * p2) OVER () / sum(w * p1 * p1) OVER () * p1 AS p3 FROM x2),
r AS (SELECT *, y - {" - ".join(f"sum(w * y * p{k}) OVER () / sum(w * p{k} * p{k}) OVER () * p{k}" for k in range(4))} AS r FROM x3) SELECT supp, year, round(r / sqrt(sum(w * r * r) OVER () / sum(w) OVER ()), 4) AS z FROM r""")
def cubic_curve_residual_z(spark, d):
    """A cubic through suppliers' years by moments, then distances in residual deviations."""
    s = supplier_years(spark, d).withColumn("x", (F.col("year") - 1998).cast("double"))
    c, sd = stats.polyfit(s, "x", "qty", 3, "lines")
    curve = sum((F.lit(k) * F.pow("x", F.lit(i)) for i, k in enumerate(c)), F.lit(0.0))
    return rounded(s.select("supp", "year", ((F.col("qty") - curve) / sd).alias("z")), 4)


@book.query("""WITH g AS (SELECT p_type, p_brand, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n, count(*) FILTER (p_size > 25) AS k FROM part GROUP BY 1, 2),
m AS (SELECT p_type, avg(p) AS m, var_samp(p) AS v FROM g GROUP BY 1), a AS (SELECT avg(p) AS m, var_samp(p) AS v FROM g),
t AS (SELECT p_type, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (m * (1 - m) / v - 1) END AS al, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN (1 - m) * (m * (1 - m) / v - 1) END AS be FROM m),
z AS (SELECT m * (m * (1 - m) / v - 1) AS al, (1 - m) * (m * (1 - m) / v - 1) AS be FROM a)
SELECT g.p_type, g.p_brand, round((g.k + coalesce(t.al, z.al)) / (g.n + coalesce(t.al, z.al) + coalesce(t.be, z.be)), 6) AS rate FROM g JOIN t USING (p_type), z""")
def beta_mom_prior_fallback(spark, d):
    """A type's own prior, or that of all if its moments give none."""
    p = table(spark, d, "part")
    g = p.groupBy("p_type", "p_brand").agg(F.avg((F.col("p_size") > 25).cast("double")).alias("p"), F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("k"))
    a, b = stats.beta_prior("p")
    z = g.agg(a.alias("a"), b.alias("b")).first()
    j = g.join(g.groupBy("p_type").agg(a.alias("a"), b.alias("b")), "p_type")
    al, be = F.coalesce("a", F.lit(z["a"])), F.coalesce("b", F.lit(z["b"]))
    return rounded(j.select("p_type", "p_brand", ((F.col("k") + al) / (F.col("n") + al + be)).alias("rate")))


@book.query("""WITH m AS (SELECT avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS sa, avg(c_nationkey) AS b, stddev_samp(c_nationkey) AS sb FROM customer) SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN (c_nationkey - b) / sb ELSE ((c_acctbal - a) / sa + (c_nationkey - b) / sb) / 2 END, 6) AS z FROM customer, m""")
def composite_z(spark, d):
    from orderloom.functions.nulls import row_mean

    c = table(spark, d, "customer")
    m = c.agg(*(f(k).alias(n) for k, x in (("c_acctbal", "a"), ("c_nationkey", "b")) for f, n in ((F.avg, x), (F.stddev_samp, f"s{x}")))).first()
    za = F.when(F.col("c_custkey") % 3 != 0, (F.col("c_acctbal") - m["a"]) / m["sa"])
    return rounded(c.select("c_custkey", row_mean(za, (F.col("c_nationkey") - m["b"]) / m["sb"]).alias("z")))


@book.query("WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM events GROUP BY 1) SELECT user_id, count(*) FILTER (value <= lo) AS low, count(*) FILTER (value >= hi) AS high FROM events JOIN q USING (user_id) GROUP BY 1")
def quartile_splits(spark, d):
    e = _events(spark, d)
    q = e.groupBy("user_id").agg(F.percentile("value", F.lit(0.25)).alias("lo"), F.percentile("value", F.lit(0.75)).alias("hi"))
    return e.join(q, "user_id").groupBy("user_id").agg(F.count_if(F.col("value") <= F.col("lo")).alias("low"), F.count_if(F.col("value") >= F.col("hi")).alias("high"))


# -- sequences ------------------------------------------------------------------------------


def _w():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@book.query(f"SELECT event_id, round(value - lag(value) OVER w, 6) AS delta, round(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 6) AS accel FROM events WINDOW w AS (PARTITION BY user_id {ORD})")
def lag_delta_acceleration(spark, d):
    p1, p2 = F.lag("value").over(_w()), F.lag("value", 2).over(_w())
    return rounded(_events(spark, d).select("event_id", (F.col("value") - p1).alias("delta"), (F.col("value") - 2 * p1 + p2).alias("accel")))


@book.query(f"WITH {SUPPLIER_YEARS} SELECT supp, year, round(avg(qty) OVER (PARTITION BY supp ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS prior FROM s")
def expanding_prior_mean(spark, d):
    return rounded(supplier_years(spark, d).select("supp", "year", F.avg("qty").over(windows.before(["supp"], F.col("year"))).alias("prior")))


@book.query("""WITH days AS (SELECT DISTINCT event_type, ts::DATE AS day FROM events), users AS (SELECT DISTINCT event_type, user_id FROM events), grid AS (SELECT * FROM days JOIN users USING (event_type)),
v AS (SELECT event_type, user_id, ts::DATE AS day, round(sum(value), 6) AS x FROM events GROUP BY 1, 2, 3)
SELECT event_type, user_id, day, round(coalesce(sum(coalesce(x, 0)) OVER (PARTITION BY event_type, user_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 4) AS prev10 FROM grid LEFT JOIN v USING (event_type, user_id, day)""")
def prev10_dense_sum(spark, d):
    """The last ten days of a dense grid, absences counting as zero."""
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    grid = e.select("event_type", "day").distinct().join(e.select("event_type", "user_id").distinct(), "event_type")
    v = e.groupBy("event_type", "user_id", "day").agg(F.round(F.sum("value"), 6).alias("x"))
    x = grid.join(v, ["event_type", "user_id", "day"], "left")
    s = F.sum(F.coalesce("x", F.lit(0.0))).over(windows.before(["event_type", "user_id"], F.col("day"), last=10))
    return rounded(x.select("event_type", "user_id", "day", F.coalesce(s, F.lit(0.0)).alias("prev10")), 4)


@book.query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, round(avg(value) FILTER (k <= 10) - avg(value) FILTER (k > 10), 6) AS form FROM r GROUP BY 1")
def last10_vs_rest(spark, d):
    r = _events(spark, d).withColumn("k", windows.ordinal(["user_id"], F.desc("ts"), F.desc("event_id")))
    return rounded(r.groupBy("user_id").agg((F.avg(F.when(F.col("k") <= 10, F.col("value"))) - F.avg(F.when(F.col("k") > 10, F.col("value")))).alias("form")))


@book.query(f"SELECT event_id, round(avg(value) OVER w, 6) AS mean_so_far, round(max(value) OVER w, 6) AS best_so_far FROM events WINDOW w AS (PARTITION BY user_id {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def career_to_date(spark, d):
    w = windows.until_now(["user_id"], F.col("ts"), F.col("event_id"))
    return rounded(_events(spark, d).select("event_id", F.avg("value").over(w).alias("mean_so_far"), F.max("value").over(w).alias("best_so_far")))


@book.query(f"WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id, event_type {ORD}) AS k, first_value(value) OVER (PARTITION BY user_id, event_type {ORD}) AS f FROM events) SELECT user_id, count(*) FILTER (k > 1) AS rematches, round(avg(value - f) FILTER (k > 1), 6) AS gain FROM r GROUP BY 1")
def first_vs_later_meeting(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    r = _events(spark, d).withColumns({"k": F.row_number().over(w), "f": F.first("value").over(w)})
    return rounded(r.groupBy("user_id").agg(F.count_if(F.col("k") > 1).alias("rematches"), F.avg(F.when(F.col("k") > 1, F.col("value") - F.col("f"))).alias("gain")))


@book.query(f"WITH x AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id {ORD}) AS p FROM events), q AS (SELECT user_id, quantile_cont(value, 0.25) AS lo FROM events GROUP BY 1) SELECT user_id, round(avg(value) FILTER (p <= lo) - avg(value), 6) AS bounce FROM x JOIN q USING (user_id) GROUP BY 1")
def bounce_back(spark, d):
    e = _events(spark, d)
    x = e.withColumn("p", F.lag("value").over(_w())).join(e.groupBy("user_id").agg(F.percentile("value", F.lit(0.25)).alias("lo")), "user_id")
    return rounded(x.groupBy("user_id").agg((F.avg(F.when(F.col("p") <= F.col("lo"), F.col("value"))) - F.avg("value")).alias("bounce")))


@book.query(f"""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id {ORD})), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id {ORD} ROWS UNBOUNDED PRECEDING) AS island FROM c),
n AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2) SELECT user_id, (max(island))::BIGINT AS changes, arg_max(n, island) AS final_run FROM n GROUP BY 1""")
def change_points_final_run(spark, d):
    i = windows.islands(_events(spark, d), "event_type", ["user_id"], F.col("ts"), F.col("event_id"))
    n = i.groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return rounded(n.groupBy("user_id").agg(F.max("island").alias("changes"), F.max_by("n", "island").alias("final_run")))


@book.query("SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, max(turn) - min(turn) + 1 - count(DISTINCT turn) <= 2 AS ok FROM conversations GROUP BY 1")
def contiguity(spark, d):
    g = table(spark, d, "conversations", ["conv_id", "turn"]).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    return g.withColumn("ok", F.col("gaps") <= 2)


@book.query(f"""WITH m AS (SELECT *, max(value) OVER (PARTITION BY user_id {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events), b AS (SELECT *, max(CASE WHEN value <= coalesce(p, value - 1) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id {ORD} ROWS UNBOUNDED PRECEDING) AS x FROM m) SELECT user_id, event_id FROM b WHERE x = 0""")
def rising_prefix(spark, d):
    return windows.rising_prefix(_events(spark, d), "value", ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id")


@book.query("""WITH h AS (SELECT user_id, h, avg(value) AS v FROM (SELECT user_id, value, ts, unnest([28, 21, 14, 7, 0]) AS h FROM events) WHERE ts < TIMESTAMP '2024-01-31' - h * INTERVAL 1 DAY AND ts >= TIMESTAMP '2024-01-31' - (h + 7) * INTERVAL 1 DAY GROUP BY 1, 2)
SELECT user_id, count(*) AS n, round(regr_slope(v, -h), 6) AS slope, round(arg_min(v, h) - arg_max(v, h), 6) AS move FROM h GROUP BY 1""")
def momentum_features(spark, d):
    """A value at several horizons before a cutoff, its slope and move; nothing later is seen."""
    e = _events(spark, d).filter(F.col("ts") < F.lit("2024-01-31").cast("timestamp"))
    # ts lies in [cutoff - (h + 7) days, cutoff - h days), so its week is ceil(days / 7) - 1
    left = (F.lit(1706659200e6) - F.unix_micros(F.col("ts").cast("timestamp")).cast("double")) / (7 * 86400e6)
    e = e.withColumn("h", ((F.ceil(left) - 1) * 7).cast("long")).filter("h between 0 and 28")
    h = e.groupBy("user_id", "h").agg(F.avg("value").alias("v"))
    return rounded(h.groupBy("user_id").agg(F.count("*").alias("n"), F.regr_slope("v", (-F.col("h")).cast("double")).alias("slope"), (F.min_by("v", "h") - F.max_by("v", "h")).alias("move")))


PRICES = "(SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN -100.0 - o_orderkey % 150 ELSE 100.0 + o_orderkey % 200 END::DOUBLE AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE -110.0 END::DOUBLE AS b FROM orders)"


def _quotes(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"]).withColumns({"a": F.when(k % 3 == 0, -100.0 - k % 150).otherwise(100.0 + k % 200).cast("double"), "b": F.when(k % 5 != 0, F.lit(-110.0))})


@book.query(f"WITH p AS (SELECT o_orderkey, CASE WHEN a < 0 THEN -a / (-a + 100.0) ELSE 100.0 / (a + 100.0) END AS pa, CASE WHEN b < 0 THEN -b / (-b + 100.0) WHEN b > 0 THEN 100.0 / (b + 100.0) END AS pb FROM {PRICES}) SELECT o_orderkey, round(CASE WHEN pb IS NULL THEN pa ELSE pa / (pa + pb) END, 6) AS fair FROM p")
def american_odds_fair(spark, d):
    return rounded(_quotes(spark, d).select("o_orderkey", numbers.fair(numbers.price_probability("a"), numbers.price_probability("b")).alias("fair")))


@book.query(f"WITH p AS (SELECT o_custkey, CASE WHEN a < 0 THEN -a / (-a + 100.0) ELSE 100.0 / (a + 100.0) END AS pa FROM {PRICES}), m AS (SELECT o_custkey, median(pa) AS m, count(*) AS books FROM p GROUP BY 1) SELECT o_custkey, books, round(CASE WHEN m > 0.5 THEN -100.0 * m / (1 - m) ELSE 100.0 * (1 - m) / m END, 4) AS price FROM m")
def median_price(spark, d):
    m = _quotes(spark, d).groupBy("o_custkey").agg(F.median(numbers.price_probability("a")).alias("m"), F.count("*").alias("books"))
    return rounded(m.select("o_custkey", "books", numbers.probability_price("m").alias("price")), 4)


_SHARE = "list_sum(list_transform(range(1, 61), lambda k: CASE WHEN {only} THEN {value} * exp(-0.5 * ((k - m) ** 2 - (greatest(1, least(60, m)) - m) ** 2) / (1 + 0.2 * line) ** 2) ELSE 0 END))"


@book.query(f"""WITH RECURSIVE p AS (SELECT o_orderkey, o_orderkey % 30 + 1.5::DOUBLE AS line, CASE WHEN a < 0 THEN -a / (-a + 100.0) ELSE 100.0 / (a + 100.0) END AS under FROM {PRICES}),
b AS (SELECT DISTINCT line, under, greatest(0.02, least(0.98, under)) AS share, -80.0::DOUBLE AS lo, 140.0::DOUBLE AS hi, 0 AS i FROM p
 UNION ALL SELECT line, under, share, CASE WHEN s > share THEN m ELSE lo END, CASE WHEN s > share THEN hi ELSE m END, i + 1
 FROM (SELECT *, {_SHARE.format(only="k < line", value="1")} / {_SHARE.format(only="true", value="1")} AS s FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE i < 60))),
e AS (SELECT line, under, {_SHARE.format(only="true", value="k")} / {_SHARE.format(only="true", value="1")} AS slot FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE i = 60))
SELECT o_orderkey, round(slot, 4) AS slot FROM p JOIN e USING (line, under)""")
def expected_pick(spark, d):
    """the mean slot that a line and a price imply."""
    q = _quotes(spark, d).select("o_orderkey", (F.col("o_orderkey") % 30 + 1.5).cast("double").alias("line"), numbers.price_probability("a").alias("under"))
    return rounded(numbers.expected_slot(q, "line", "under", "slot").select("o_orderkey", "slot"), 4)


@book.query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS k FROM {PRICES}) SELECT o_custkey, count(*) AS books, round(avg(CASE WHEN a < 0 THEN -a / (-a + 100.0) ELSE 100.0 / (a + 100.0) END), 6) AS p FROM r WHERE k = 1 GROUP BY 1")
def odds_per_book_agg(spark, d):
    from orderloom.operators.dedup import best_by

    last = best_by(_quotes(spark, d), ["o_custkey", "o_orderpriority"], [F.desc("o_orderkey")])
    return rounded(last.groupBy("o_custkey").agg(F.count("*").alias("books"), F.avg(numbers.price_probability("a")).alias("p")))


@book.query("""WITH w AS (SELECT o_custkey, max(r) FILTER (o_orderpriority = '1-URGENT') AS a, max(r) FILTER (o_orderpriority = '2-HIGH') AS b, max(r) FILTER (o_orderpriority = '3-MEDIUM') AS c FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 60 GROUP BY 1)
SELECT c_custkey, round((coalesce(a, 61) + coalesce(b, 61) + coalesce(c, 61)) / 3.0, 6) AS mean_rank, ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT)::BIGINT AS boards FROM customer LEFT JOIN w ON o_custkey = c_custkey""")
def consensus_rank_fill(spark, d):
    """Ranks of several boards, the unlisted behind their ends."""
    from orderloom.functions.nulls import row_mean

    o = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice"])
    r = windows.top_k(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 60)
    w = r.groupBy(F.col("o_custkey").alias("c_custkey")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.max("rank")).toDF("c_custkey", "a", "b", "c")
    x = table(spark, d, "customer", ["c_custkey"]).join(w, "c_custkey", "left")
    return rounded(x.select("c_custkey", row_mean(*(F.coalesce(c, F.lit(61)) for c in "abc")).alias("mean_rank"), sum((F.col(c).isNotNull().cast("int") for c in "abc"), F.lit(0)).alias("boards")))


def _games(spark, d):
    """(a, b, m): two suppliers of one order, neighbours by key, and the margin of their sales."""
    l = table(spark, d, "lineitem", ["l_suppkey", "l_orderkey", "l_extendedprice"])  # noqa: E741
    s = l.groupBy("l_orderkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice") / 1000, 4).alias("v"))
    nxt = Window.partitionBy("l_orderkey").orderBy("l_suppkey")
    return s.select("l_orderkey", F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(nxt).alias("b"), (F.col("v") - F.lead("v").over(nxt)).alias("m")).filter("b is not null")


GAMES = """s AS (SELECT l_orderkey, l_suppkey, round(sum(l_extendedprice) / 1000, 4) AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT l_orderkey, l_suppkey AS a, lead(l_suppkey) OVER w AS b, v - lead(v) OVER w AS m FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_suppkey)),
games AS (SELECT * FROM n WHERE b IS NOT NULL), both_ AS (SELECT a, b, m FROM games UNION ALL SELECT b, a, -m FROM games), pairs AS (SELECT a, b, sum(m) AS m, count(*) AS n FROM both_ GROUP BY 1, 2)"""


@book.query(f"""WITH RECURSIVE {GAMES}, r AS (SELECT DISTINCT a, 0.0::DOUBLE AS r, 0 AS i FROM pairs UNION ALL SELECT a, r - avg(r) OVER () AS r, i FROM
(SELECT p.a, sum(p.m + p.n * r.r) / sum(p.n) AS r, max(r.i) + 1 AS i FROM pairs p JOIN r ON r.a = p.b WHERE r.i < 50 GROUP BY p.a)) SELECT a, round(r, 4) AS r FROM r WHERE i = 50""")
def srs_iterative(spark, d):
    """Fifty rounds of mean margin plus opponents' ratings, re-centred each round."""
    return rounded(stats.iterated_ratings(_games(spark, d), "a", "b", "m", rounds=50).select("a", "r"), 4)


@book.query("""SELECT vendor_id, count(amount) AS n, round(median(amount), 4)::DOUBLE AS q0, round(quantile_cont(amount::DOUBLE, 0.1), 4)::DOUBLE AS q1, round(quantile_cont(amount::DOUBLE, 0.95), 4)::DOUBLE AS q2 FROM sale_lines GROUP BY 1""")
def quantiles_of_hot_groups(spark, d):
    """Exact quantiles of each vendor's lines, of whom one may have a third of all rows, by brackets in place of whole groups."""
    from orderloom.operators.selection import quantiles

    return rounded(quantiles(table(spark, d, "sale_lines", ["vendor_id", "amount"]), ["vendor_id"], "amount", [0.5, 0.1, 0.95]), 4)
