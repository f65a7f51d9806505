"""Pages as node tables: trees by hand, paths against a plain walk, text content, odd documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orderloom.sources import pages

PAGE = """<!DOCTYPE html><HTML lang=en><body class="a b"><p>one<b>two<br>three<p id='x y'>four &amp; five</p>six<ul><li>u<li>v<ul><li>w</ul>z</ul>
<table><tr><td>1<td>2<tr><th data-k>3</table><script>var t="<p>";</script></nope></b><!-- <table><tr><td data-stat="q">5</table> -->end</body></html>"""


def tree(html, opened=False):
    return [(r[0], r[1], r[2], r[4], r[5]) for r in pages.parse(html, opened)]


def test_a_page_by_hand():
    want = [
        (0, -1, 18, "html", 1), (1, 0, 18, "body", 1), (2, 1, 4, "p", 1), (3, 2, 4, "b", 1), (4, 3, 4, "br", 1), (5, 1, 5, "p", 2), (6, 1, 10, "ul", 1), (7, 6, 7, "li", 1), (8, 6, 10, "li", 2), (9, 8, 10, "ul", 1), (10, 9, 10, "li", 1),
        (11, 1, 16, "table", 1), (12, 11, 14, "tr", 1), (13, 12, 13, "td", 1), (14, 12, 14, "td", 2), (15, 11, 16, "tr", 2), (16, 15, 16, "th", 1), (17, 1, 17, "script", 1), (18, 1, 18, "comment()", 1),
    ]
    assert tree(PAGE) == want
    rows = list(pages.parse(PAGE))
    assert (rows[5][7], rows[5][8], rows[5][9], rows[17][8], rows[0][7], rows[16][7]) == ({"id": "x y"}, "four & five", "six", 'var t="<p>";', {"lang": "en"}, {"data-k": ""})
    assert [t[3] for t in tree(PAGE, opened=True)][18:] == ["table", "tr", "td"]


@pytest.mark.parametrize("html", [None, "", "plain text", "<", "<p", "</p>", "<!-- open", "<p><p><p>", "<a b=1 b=2>x", "<td>1<td>2", "<li>" * 300, "<div>" * 3000, "&lt;p&gt;", "<script>never ends <b>"])
def test_odd_documents_do_not_fail(html):
    rows = list(pages.parse(html))
    assert all(r[1] < r[0] <= r[2] < len(rows) for r in rows)


def random_page(rnd, depth=0):
    out = ""
    for _ in range(rnd.randint(0, 4)):
        kind = rnd.random()
        if kind < 0.35 or depth > 4:
            out += rnd.choice(["t", "é &lt;", " ", "k v "])
        elif kind < 0.45:
            out += "<!--hid-->"
        else:
            tag = rnd.choice(["div", "span", "i", "em"])
            attrs = rnd.choice(["", ' class="a"', ' class="ab" id=q', " id"])
            out += f"<{tag}{attrs}>{random_page(rnd, depth + 1)}</{tag}>"
    return out


def walked(rows, path):
    """Nodes that a path finds, by walking the tree."""
    by, found = {r[0]: r for r in rows}, {-1}
    for below, name, conditions in pages.steps(path):
        nxt = set()
        for r in rows:
            up = r[1]
            while below and up not in found and up != -1:
                up = by[up][1]
            if up not in found or not (r[4] == name or name == "*" and r[4] != pages.COMMENT):
                continue
            ok = True
            for c in conditions:
                if c.isdigit():
                    ok &= r[5] == int(c)
                elif c == "@id":
                    ok &= "id" in r[7]
                elif c.startswith("@class="):
                    ok &= r[7].get("class") == "a"
                elif c.startswith("contains(@class"):
                    ok &= "a" in r[7].get("class", "")
                else:
                    ok &= "k" in whole(rows, r[0])
            if ok:
                nxt.add(r[0])
        found = nxt
    return found


def whole(rows, n):
    """Text content by recursion."""
    own = rows[n]
    out = "" if own[4] == pages.COMMENT else own[8]
    for r in rows:
        if r[1] == n:
            out += whole(rows, r[0]) + r[9]
    return out


def test_paths_and_contents_are_those_of_a_walk(spark):
    rnd = random.Random(3)
    docs = {i: f"<div>{random_page(rnd)}</div>" * rnd.randint(1, 2) for i in range(40)} | {50: "", 51: None}
    df = spark.createDataFrame(list(docs.items()), "k long, html string")
    table = pages.nodes(df, F.col("html"), "k").cache()
    rows = {k: list(pages.parse(h)) for k, h in docs.items()}
    assert table.count() == sum(map(len, rows.values()))
    paths = ["/div", "//span", "/div/*", "//div//i", "//*[@id]/em", '//*[@class="a"]', '//div[contains(@class,"a")]//*', "//comment()", "/div[2]//span[1]", '//span[contains(.,"k")]']
    n = 0
    for path in paths:
        got = {(r["k"], r["node"]) for r in pages.select(table, path, "k").collect()}
        want = {(k, x) for k, r in rows.items() for x in walked(r, path)}
        assert got == want, path
        n += len(want)
    assert n > 300
    told = {(r["k"], r["node"]): r["content"] for r in pages.content(table, table, "k").collect()}
    assert told == {(k, r[0]): whole(own, r[0]) for k, own in rows.items() for r in own}


def test_starts_are_kept_and_bad_paths_raise(spark):
    df = spark.createDataFrame([(1, "<ul><li><a href=u>n1</a></li><li><a href=v> n2\n</a><a>x</a></li><li></li><li><a>n1</a></li></ul>")], "k long, html string")
    table = pages.nodes(df, F.col("html"), "k")
    both = pages.select(table, "//a", "k", under=pages.select(table, "//*", "k"))
    assert sorted((r["start"], r["node"]) for r in both.collect()) == [(0, 2), (0, 4), (0, 5), (0, 8), (1, 2), (3, 4), (3, 5), (7, 8)]
    assert sorted((r["place"], r["name"], r["href"]) for r in pages.listed(table, "//ul", "/li", "//a", "k").collect()) == [(1, "n1", "u"), (2, "n2", "v")]
    for bad in ("li", "//li[last()]", "//li/", "//li[@"):
        with pytest.raises(ValueError, match="not understood"):
            pages.select(table, bad, "k")


def test_a_named_entity_without_its_semicolon_is_text():
    got = list(pages.parse('<p title="a&amp b&amp;c">x&amp;&amp</p><script>a&b</script><!--c&d--><p>&lt;&#65;&copy 1</p>'))
    assert [(r[4], r[7].get("title"), r[8]) for r in got] == [("p", "a&amp b&c", "x&&amp"), ("script", None, "a&b"), ("comment()", None, "c&d"), ("p", None, "<A&copy 1")]


def test_hidden_pages_are_the_same_each_time(spark, tmp_path, monkeypatch):
    """The pages are made once for each use of their nodes, so rows must not come in an order of chance."""
    from orderloom.plans import webpages

    made = []
    monkeypatch.setattr(webpages.pages, "nodes", lambda df, *a, **k: made.append(df) or (_ for _ in ()).throw(StopIteration))
    for order in ("c_custkey", "-c_custkey"):
        spark.range(400).selectExpr("id * 1000 AS c_custkey", "1 AS c_nationkey", "'s' AS c_mktsegment", "1.5D AS c_acctbal").orderBy(F.expr(order)).coalesce(1).write.parquet(f"{tmp_path}/{order}/customer.parquet")
        with pytest.raises(StopIteration):
            webpages.hidden_rows(spark, f"{tmp_path}/{order}")
    a, b = (df.filter("page = 0").first()["rows"] for df in made)
    assert a == b


def test_paths_and_contents_pass_no_driver(spark):
    """Cells under rows: joins are merges, so neither side passes through the driver."""
    df = spark.createDataFrame([(k, "<table>" + "".join(f"<tr><td a>{k}<b>{i}</b>-<td>no" for i in range(400)) + "</table>") for k in (1, 2)], "k long, html string")
    table = pages.nodes(df, F.col("html"), "k")
    cells = pages.content(table, pages.select(table, "/td[@a]", "k", under=pages.select(table, "//tr", "k")), "k")
    assert sorted((r["k"], r["node"], r["content"]) for r in cells.collect()) == [(k, 2 + 4 * i, f"{k}{i}-") for k in (1, 2) for i in range(400)]
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "NestedLoop" not in plan


def test_hidden_rows_of_odd_customers_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from orderloom.plans import webpages

    balances = [0.0, -0.0, -0.004, 0.004, -0.01, 5.5, 5.05, 10.0, 1.005, 2.675, -2.675, 1e7, 12345678.9, 1.5e10, None, 7.25]
    odd = [(i, None if i == 3 else i, None if i == 4 else ["A & B", "a <b>c</b>", "&amp;", "--> x", "", "plain"][i % 6], b) for i, b in enumerate(balances)]
    spark.createDataFrame(odd, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = webpages.hidden_rows(spark, str(tmp_path)).select("c_custkey", "nation", "segment", "balance").collect()
    want = duckdb.connect().execute(webpages.ORACLE["hidden_rows"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
