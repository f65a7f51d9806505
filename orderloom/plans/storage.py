"""Sources, sinks and streams as round trips: a table is written, read back and compared with what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators.lineage import landing
from orderloom.plans.base import SUPPLIER_YEARS, Book, rounded, supplier_years
from orderloom.sources import html, readers, sinks
from orderloom.sources.readers import table
from orderloom.streaming import events as streams

book = Book()
QUERIES, ORACLE = book.queries, book.sql

CUSTOMERS = "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer"


def _customers(spark, d):
    return table(spark, d, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])


# -- text files ----------------------------------------------------------------------------


@book.query(CUSTOMERS)
def csv_headered(spark, d):
    """Written with headers, read by a schema, only some columns parsed."""
    path = landing(spark, "csv")
    sinks.csv(_customers(spark, d), path)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double", columns=["c_custkey", "c_name", "c_acctbal"])


@book.query(CUSTOMERS)
def csv_positional(spark, d):
    """No header, gzipped."""
    path = landing(spark, "csv")
    _customers(spark, d).drop("c_mktsegment").write.option("compression", "gzip").csv(path)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_acctbal double", header=False)


@book.query(CUSTOMERS)
def csv_marked_and_indexed(spark, d):
    """Files that each begin with a byte order mark and hold a column of row numbers without a name."""
    path = landing(spark, "csv")
    c = _customers(spark, d).select(F.monotonically_increasing_id().alias("\ufeff"), "c_custkey", "c_name", "c_acctbal")
    c.write.option("header", True).csv(path)  # the mark is the nameless column's name, at the start of every file
    return readers.csv(spark, path, "c_custkey long, c_name string, c_acctbal double", index=True)


@book.query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def csv_as_text(spark, d):
    """All cells as text; empty is not missing, and neither is what looks so."""
    path = landing(spark, "csv")
    k = F.col("c_custkey")
    c = _customers(spark, d).select(k.cast("string").alias("c_custkey"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("c_name"), F.when(k % 5 == 0, "NA").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    c.write.option("header", True).option("emptyValue", "").csv(path)
    return readers.csv_cells(spark, path, ["c_custkey", "c_name", "c_mktsegment"])


@book.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 = 0")
def json_lines_with_bad_ones(spark, d):
    """A ledger to which lines are added twice; lines that are no JSON are left out."""
    path = landing(spark, "ledger")
    c = _customers(spark, d).select("c_custkey", "c_name")
    sinks.ledger(c.filter("c_custkey % 4 <> 0"), path)
    sinks.ledger(c.filter("c_custkey % 4 = 0"), path)
    c.limit(3).select(F.lit("{not json").alias("value")).write.mode("append").text(path)
    return readers.json_lines(spark, path, "c_custkey long, c_name string")


@book.query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || ' é' AS name FROM nation")
def decoded_bytes(spark, d):
    """UTF-8, or else the Western code page."""
    text = F.concat("n_name", F.lit(" é"))
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return rounded(table(spark, d, "nation", ["n_nationkey", "n_name"]).select("n_nationkey", readers.decoded(raw).alias("name")))


@book.query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer")
def json_document(spark, d):
    """A table as JSON documents of a thousand keys each, a line for a document, each read back as one value."""
    path = landing(spark, "document")
    sinks.documents(_customers(spark, d).select("c_custkey", "c_name"), path, F.floor(F.col("c_custkey") / 1000))
    rows = F.from_json("value", "array<struct<c_custkey:long,c_name:string>>")
    return spark.read.text(path).select(F.inline(rows)).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


# -- tables --------------------------------------------------------------------------------


@book.query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS balance FROM customer")
def overwritten_and_clean(spark, d):
    """K1, K8: the second writing stands; NaN and infinities are missing."""
    path = landing(spark, "table")
    k = F.col("c_custkey")
    c = _customers(spark, d).select("c_custkey", F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal")).alias("balance"))
    sinks.overwrite(c.withColumn("balance", F.lit(0.0)), path)
    sinks.overwrite(c, path)
    return spark.read.parquet(path)


@book.query("SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1")
def appended_partitions(spark, d):
    """Two additions by partition; later years are read alone."""
    path = landing(spark, "table")
    o = table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"]).withColumn("year", F.year("o_orderdate"))
    sinks.append_partitions(o.filter("o_orderkey % 2 = 0"), path, "year")
    sinks.append_partitions(o.filter("o_orderkey % 2 = 1"), path, "year")
    return rounded(spark.read.parquet(path).filter("year >= 1997").groupBy("year").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@book.query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, 2::BIGINT AS versions FROM customer")
def restored_snapshot(spark, d):
    """Three versions of a table; the first is restored and the middle one deleted."""
    path = landing(spark, "versions")
    c = _customers(spark, d).select("c_custkey", "c_acctbal")
    for factor in (1.0, 2.0, 3.0):
        sinks.snapshot(c.withColumn("c_acctbal", F.col("c_acctbal") * factor), path)
    sinks.restore(spark, path, 1)
    sinks.prune(spark, path, 1)
    return sinks.current(spark, path).withColumn("versions", F.lit(len(sinks.versions(spark, path))).cast("long"))


@book.query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS source, 'r' || n_regionkey AS captured, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"at\":\"r' || n_regionkey || '\"}') AS row_hash FROM nation")
def provenance_rows(spark, d):
    """Where each row came from, when it was taken, and a hash of it."""
    n = table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"]).select("n_nationkey", "n_name", F.concat(F.lit("r"), "n_regionkey").alias("at"))
    return rounded(sinks.provenance(n, ["n_nationkey"], "n_name", "at"))


MEANING = {"supp": "supplier", "year": "year of shipping", "qty": "units", "revenue": "price before discount", "lines": "order lines"}


@book.query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{m}' AS meaning" for c, m in MEANING.items()))
def dictionary_columns(spark, d):
    """A comment on every column, kept by the file, and none without a column."""
    path = landing(spark, "table")
    sinks.overwrite(sinks.with_dictionary(supplier_years(spark, d), MEANING), path)
    kept = spark.read.parquet(path).schema
    return spark.createDataFrame([(f.name, f.metadata.get("comment")) for f in kept], "column string, meaning string")


@book.query(f"WITH {SUPPLIER_YEARS} SELECT supp, year, round(qty, 4) AS f_qty, round(revenue, 4) AS f_revenue, lines AS f_lines FROM s")
def feature_files(spark, d):
    """Feature tables joined by key; text, thin and constant columns stay out."""
    s = supplier_years(spark, d)
    one, two = landing(spark, "feat"), landing(spark, "feat")
    s.select("supp", "year", F.col("qty").alias("f_qty"), F.lit("x").alias("f_note"), F.lit(1).alias("f_one")).write.parquet(one)
    s.select("supp", "year", F.col("revenue").alias("f_revenue"), F.col("lines").alias("f_lines"), F.when(F.col("supp") % 100 == 99, 1.0).alias("f_thin"), F.col("qty").alias("other")).write.parquet(two)
    return rounded(readers.feature_files(spark, [one, two], ["supp", "year"], 0.1, "f_"), 4)


# -- pages ---------------------------------------------------------------------------------


@book.query("SELECT n_regionkey::BIGINT AS n_regionkey, n_name AS name, n_nationkey::VARCHAR AS key FROM nation")
def hidden_table_cells(spark, d):
    """Cells by their attribute, of tables that stand inside comments."""
    row = F.concat(F.lit('<tr><td data-stat="key">'), "n_nationkey", F.lit('</td><td data-stat="name">'), "n_name", F.lit("</td></tr>"))
    n = table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"]).select("n_regionkey", F.concat(F.lit("<div><!-- <table>"), row, F.lit("</table> --></div>")).alias("html"))
    cells = html.attribute_cells(html.uncommented(F.col("html")), "data-stat")
    m = n.select("n_regionkey", F.map_from_entries(F.transform(cells, lambda c: F.struct(c["name"], c["text"]))).alias("m"))
    return rounded(m.select("n_regionkey", F.col("m")["name"].alias("name"), F.col("m")["key"].alias("key")))


_LAYOUTS = ("table", "list", "heading", "line", "data")


@book.query("SELECT p_partkey, p_brand AS name, p_type AS position, (p_size + 1)::VARCHAR AS place FROM part")
def board_pages(spark, d):
    """Boards of five layouts, each page read by its own."""
    p = table(spark, d, "part", ["p_partkey", "p_brand", "p_type", "p_size"]).withColumn("place", F.col("p_size") + 1)
    shape = {
        "table": '<tr class="x"><td>%d.</td><td><a href="#">%s</a></td><td>%s</td></tr>', "list": "<ol><li>%d. %s, %s</li></ol>", "heading": "<h3>%d) <b>%s | %s</b></h3>", "line": "intro\n%d. %s, %s\nend", "data": '{"rank": %d, "name": "%s", "position": "%s"}',
    }
    layout = F.element_at(F.array(*map(F.lit, _LAYOUTS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    page = F.when(F.lit(False), "")
    for i, name in enumerate(_LAYOUTS):
        page = page.when(F.col("p_partkey") % 5 == i, F.format_string(shape[name], "place", "p_brand", "p_type"))
    found = html.entries(page, layout, html.BOARDS, ("place", "name", "position"))
    return p.select("p_partkey", F.explode(found).alias("e")).select("p_partkey", "e.name", "e.position", "e.place")


@book.query("SELECT o_orderkey, 'Clerk ' || chr((65 + o_orderkey % 26)::INT) AS name, o_orderkey % 30 + 0.5::DOUBLE AS line, (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (100 + o_orderkey % 90))::BIGINT AS price FROM orders")
def price_pages(spark, d):
    """Price pages of three layouts."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders", ["o_orderkey"]).select("o_orderkey", F.concat(F.lit("Clerk "), F.char(65 + k % 26)).alias("name"), (k % 30 + 0.5).cast("double").alias("line"), (F.when(k % 2 == 0, -1).otherwise(1) * (100 + k % 90)).cast("long").alias("price"))
    page = (
        F.when(k % 3 == 0, F.format_string("<tr><td>%s</td><td>under %.1f</td><td>%+d</td></tr>", "name", "line", "price"))
        .when(k % 3 == 1, F.format_string("Lines\n%s: over %.1f (%+d)\n", "name", "line", "price")).otherwise(F.format_string('[{"player": "%s", "line": %.1f, "price": "%+d"}]', "name", "line", "price"))
    )
    layout = F.element_at(F.array(*map(F.lit, ("row", "text", "data"))), (k % 3 + 1).cast("int"))
    x = o.select("o_orderkey", F.explode(html.entries(page, layout, html.PRICES, ("name", "line", "price"))).alias("e"))
    return rounded(x.select("o_orderkey", "e.name", F.col("e.line").cast("double").alias("line"), F.col("e.price").cast("long").alias("price")))


@book.query("SELECT c_custkey, (c_custkey % 3)::BIGINT AS relatives, c_custkey % 3 > 0 AS father, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 = 0 END AS left_, (c_custkey % 2 + 1)::BIGINT AS schools, c_custkey % 5 = 0 AS academy FROM customer")
def biography_block(spark, d):
    """Fields of a block of running text."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer", ["c_custkey", "c_name"])
    relatives = F.when(k % 3 == 1, " Relatives: Father X Y").when(k % 3 == 2, " Relatives: Father X Y; Brother Z Y").otherwise("")
    hand = F.when(k % 4 == 0, " Shoots: Left").when(k % 4 == 2, " Shoots: Right").otherwise("")
    school = F.concat(F.lit(" High School: "), F.when(k % 5 == 0, "Oak Hill in Mouth, Virginia").otherwise("Central in Town, Ohio"), F.when(k % 2 == 1, ", North in City, Iowa").otherwise(""))
    text = F.concat("c_name", hand, relatives, F.lit(" College: Some"), school, F.lit(" Draft: one"))
    ends = ("College:", "High School", "Draft:", "Relatives:")
    x = c.select("c_custkey", text.alias("t")).select("c_custkey", html.meta_field(F.col("t"), "Relatives", ends).alias("r"), html.meta_field(F.col("t"), "Shoots", ends).alias("h"), html.meta_field(F.col("t"), "High School", ("Draft:",)).alias("s"))
    return rounded(x.select(
        "c_custkey", F.when(F.col("r").isNull(), 0).otherwise(F.size(F.split("r", ";"))).alias("relatives"), F.coalesce(F.col("r").rlike(r"\bFather\b"), F.lit(False)).alias("father"), (F.col("h") == "Left").alias("left_"),
        F.regexp_count("s", F.lit(r" in [A-Z][^,]*, [A-Z][A-Za-z .]+")).alias("schools"), F.lower("s").contains("oak hill").alias("academy"),
    ))


@book.query("SELECT p_partkey, p_size::DOUBLE AS shooting, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 2.0 END::DOUBLE AS defense, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END::BIGINT AS n, p_name AS words FROM part")
def profile_pages(spark, d):
    """A grid of grades, unknown ones missing, and the text beside it."""
    p = table(spark, d, "part", ["p_partkey", "p_size", "p_name"])
    second = F.when(F.col("p_partkey") % 4 != 0, F.format_string('<div class="grade"><span>defense</span><b>%.1f</b></div>', F.col("p_size") / 2.0)).otherwise("")
    page = F.concat(F.format_string('<div class="grade"> <span>shooting</span> <b>%d</b></div>', "p_size"), second, F.lit("<p>"), "p_name", F.lit("</p>"))
    x = p.select("p_partkey", html.grades(page).alias("g"), html.visible_text(F.regexp_extract(page, "(<p>.*)", 1)).alias("words"))
    return rounded(x.select("p_partkey", F.try_element_at("g", F.lit("shooting")).alias("shooting"), F.try_element_at("g", F.lit("defense")).alias("defense"), F.size("g").alias("n"), "words"))


@book.query("SELECT event_id, user_id FROM events WHERE event_id % 10 <> 0 AND ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")
def capture_listing(spark, d):
    """Captures that answered, before a cutoff and within a look-back."""
    e = table(spark, d, "events", ["event_id", "user_id", "ts"]).withColumn("status", F.when(F.col("event_id") % 10 == 0, 404).otherwise(200))
    return readers.before_cutoff(e, "ts", F.lit("2024-01-20").cast("timestamp"), back="10 days").select("event_id", "user_id")


# -- streams -------------------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _landed(spark, d, keep="true"):
    path = landing(spark, "events")
    spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props").filter(keep).write.parquet(path)
    return path


@book.query("""WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS mark FROM events) SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, m GROUP BY 1, date_trunc('day', ts), mark HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= mark""")
def stream_tumbling(spark, d):
    """R-6: windows that the watermark has passed."""
    s = streams.read_events(spark, _landed(spark, d), EVENTS, files=1000)
    out = streams.drain(streams.tumbling(s, "1 day", "1 day", ["event_type"]), landing(spark, "out"), landing(spark, "mark"))
    return rounded(out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), "n", "total"), 4)


@book.query("""WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM events), g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), t AS (SELECT user_id, k, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM t, m WHERE b + INTERVAL 6 HOUR <= mark GROUP BY 1""")
def stream_sessions(spark, d):
    """R-6: sessions that end when nothing comes for six hours."""
    s = streams.read_events(spark, _landed(spark, d), EVENTS, files=1000)
    out = streams.drain(streams.sessions(s, "6 hours", "1 hour", "user_id"), landing(spark, "out"), landing(spark, "mark"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@book.query("SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-20'")
def stream_refuses_late(spark, d):
    """R-1, R-2: what was captured at or after a cutoff is refused; repeated events count once."""
    path = _landed(spark, d)
    s = streams.read_events(spark, path, EVENTS, cutoff="2024-01-20", files=1000)
    twice = s.unionByName(streams.read_events(spark, path, EVENTS, cutoff="2024-01-20", files=1000))
    return streams.drain(streams.distinct_events(twice, "event_id", "400 days").select("event_id", "user_id"), landing(spark, "out"), landing(spark, "mark"))


@book.query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS round FROM events")
def incremental_fetch(spark, d):
    """R-3: each round takes only what no round before took; a round without news adds nothing."""
    path, out, mark = _landed(spark, d, "event_id % 2 = 0"), landing(spark, "out"), landing(spark, "mark")

    def take(number: int):
        s = streams.read_events(spark, path, EVENTS, files=1000).select("event_id", "user_id", F.lit(number).cast("long").alias("round"))
        return streams.drain(s, out, mark)

    take(1)
    take(1)
    spark.read.schema(EVENTS).parquet(_landed(spark, d, "event_id % 2 = 1")).write.mode("append").parquet(path)
    return take(2)
