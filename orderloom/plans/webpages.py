"""Pages as trees of nodes: links, paragraphs, boards, tables inside comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions import keys
from orderloom.operators.lineage import kept
from orderloom.plans.base import Book, rounded
from orderloom.sources import pages
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql


def _nodes(spark, d):
    return pages.nodes(table(spark, d, "pages", ["page_id", "html"]), F.col("html"), "page_id")


#: Markup without what a tree does not hold as elements: comments, scripts, styles.
_BARE = r"regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)>.*?</(script|style)>', '', 'gs')"
_PLAIN = "replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@book.query(f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all({_BARE}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<(script|style)>', 1)) FROM pages
UNION ALL SELECT page_id, 'comment()' FROM (SELECT page_id, unnest(regexp_extract_all(html, '<!--.*?-->', 0, 's')) FROM pages)) SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""")
def page_elements(spark, d):
    """Every element and comment of every page, by a table function over documents."""
    return _nodes(spark, d).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@book.query(r"""WITH a AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)">([^<]*)</a>', 2) AS n FROM pages),
u AS (SELECT page_id, unnest(range(len(h))) AS i, unnest(h) AS href, unnest(n) AS name FROM a), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY i) AS k FROM u)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place, name, href FROM f WHERE k = 1 AND name <> ''""")
def listed_boards(spark, d):
    """The list of a page as a board: places, names and links, each name once."""
    return rounded(pages.listed(_nodes(spark, d), "//nav/ul", "/li", "//a[@href]", "page_id"))


@book.query(f"""WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(html, '<article>(.*?)(</article>|<footer>|$)', 1, 's'), '<p>')[2:]) AS t FROM pages)
SELECT page_id, count(*) AS n, sum(length({_PLAIN.format("regexp_replace(t, '</p>.*', '', 's')")}))::BIGINT AS chars, max({_PLAIN.format("regexp_replace(t, '</p>.*', '', 's')")}) AS last FROM p GROUP BY 1""")
def page_paragraphs(spark, d):
    """Text of the paragraphs of each article, by a path and the text below it."""
    n = _nodes(spark, d)
    p = pages.content(n, pages.select(n, "//article//p", "page_id"), "page_id")
    return p.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.max("content").alias("last"))


@book.query(f"""SELECT page_id, {_PLAIN.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, {_PLAIN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS heading, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, trim(regexp_extract(html, '<!--(.*?)-->', 1)) AS comment,
{_PLAIN.format("regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')")} AS ad FROM pages""")
def page_heads(spark, d):
    """Single parts of each page by their paths."""
    n = _nodes(spark, d)
    out = pages.select(n, "/html[@lang]", "page_id").select("page_id", F.try_element_at("attributes", F.lit("lang")).alias("lang"))
    for name, path in (("title", "/html/head/title"), ("heading", "//article/h1[1]"), ("comment", "//comment()"), ("ad", '//div[contains(@class,"ad")]')):
        one = pages.select(n, path, "page_id") if name == "comment" else pages.content(n, pages.select(n, path, "page_id"), "page_id")
        text = F.trim("text") if name == "comment" else F.col("content")
        out = out.join(one.groupBy("page_id").agg(F.min_by(text, "node").alias(name)), "page_id", "left")
    return out


def _cents(c: str):
    """A double to two digits as text: halves of the product with 100 go up, all digits before the point, and what rounds to zero keeps its sign."""
    sign = F.when(F.col(c).cast("string").startswith("-"), "-").otherwise("")
    x = F.floor(F.abs(c) * 100 + 0.5).cast("decimal(20,2)") / 100
    plain = F.regexp_replace(x.cast("decimal(20,2)").cast("string"), "0$", "")
    return F.when(F.abs(c) < 1e13, F.concat(sign, plain)).otherwise(F.round(c, 2).cast("string"))  # cents beyond that are no whole longs


@book.query("SELECT c_custkey, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment, round(c_acctbal, 2)::VARCHAR AS balance FROM customer WHERE c_acctbal IS NOT NULL")
def hidden_rows(spark, d):
    """Tables inside comments, opened, row by row and cell by cell; one page holds the customers of a nation."""
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"]).filter("c_acctbal is not null")
    # a missing value has no cell; a text that holds markup is escaped
    cell = lambda name, x: F.coalesce(F.concat(F.lit(f'<td data-stat="{name}">'), keys.escape_html(x.cast("string")), F.lit("</td>")), F.lit(""))
    row = F.concat(F.lit('<tr class="full_table">'), cell("key", F.col("c_custkey")), cell("nation", F.col("c_nationkey")), cell("segment", F.col("c_mktsegment")), cell("balance", _cents("c_acctbal")))
    # in a fixed order: the nodes' numbers rest on it, and the pages are made once for each use of the nodes
    made = c.select((F.col("c_custkey") % 1000).alias("page"), F.struct("c_custkey", row.alias("r")).alias("r")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["r"]), "").alias("rows"))
    n = kept(pages.nodes(made, F.concat(F.lit("<html><body><div id=x><!-- <table>"), "rows", F.lit("</table> --></div></body></html>")), "page", opened=True))  # read five times
    rows = pages.select(n, '//div[@id="x"]//tr[contains(@class,"full")]', "page")
    cells = pages.content(n, pages.select(n, "/td[@data-stat]", "page", under=rows), "page")
    named = cells.withColumn("stat", F.try_element_at("attributes", F.lit("data-stat")))
    wide = named.groupBy("page", "start").pivot("stat", ["key", "nation", "segment", "balance"]).agg(F.first("content"))
    return wide.select(F.col("key").cast("long").alias("c_custkey"), "nation", "segment", "balance")


@book.query("""WITH s AS (SELECT s_suppkey, s_suppkey // 40 AS file, 'No. ' || s_suppkey || ' (' || s_name || ')' AS text FROM supplier), p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s_suppkey) - 1 AS i FROM s)
SELECT file::BIGINT AS file, (i // 25 + 1)::BIGINT AS page, (i % 25 + 1)::BIGINT AS line, text FROM p""")
def pdf_text_lines(spark, d):
    """Reports of forty suppliers each as PDF files of pages of 25 lines, written and read back as text lines."""
    from orderloom.operators.lineage import landing, ship
    from orderloom.sources import pdf

    ship(spark)
    s = table(spark, d, "supplier", ["s_suppkey", "s_name"]).select(F.expr("s_suppkey div 40").alias("file"), "s_suppkey", F.format_string("No. %d (%s)", "s_suppkey", "s_name").alias("text"))
    reports = s.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "text"))), lambda x: x["text"]).alias("lines"))

    @F.pandas_udf("binary")
    def typeset(lines):
        return lines.map(lambda own: pdf.typeset([list(own[i : i + 25]) for i in range(0, len(own), 25)]))

    path = landing(spark, "reports")
    reports.select("file", typeset("lines").alias("content")).write.parquet(path)
    return rounded(pdf.text_lines(spark.read.parquet(path), F.col("content"), "file"))
