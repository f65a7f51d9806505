"""Web pages as tables: visible text, titles, links, table rows; no parser leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions import lists

#: Elements whose content is not shown, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template")
BLOCKS = ("p", "div", "li", "tr", "br", "h[1-6]", "table", "section", "article", "title", "ul", "ol", "td")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def uncommented(html: Column) -> Column:
    """Markup whose comments are opened, for tables that are hidden in them."""
    return F.regexp_replace(html, "<!--|-->", "")


def unescaped(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def visible_text(html: Column) -> Column:
    """Text as shown, one line per block element."""
    for tag in HIDDEN:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    html = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    plain = unescaped(F.regexp_replace(html, "<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), F.lit("\n "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def rows(html: Column) -> Column:
    """array<array<string>> of the cells of all table rows."""
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(unescaped(F.regexp_replace(c, "<[^>]*>", ""))))
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)


def script_json(html: Column, name: str) -> Column:
    """JSON text that a script element of an id holds."""
    return F.regexp_extract(html, rf'(?s)<script[^>]*id="{name}"[^>]*>(.*?)</script>', 1)


def attribute_cells(html: Column, attribute: str) -> Column:
    """map of an attribute's values to the text of the elements that bear it."""
    found = F.regexp_extract_all(html, F.lit(rf'{attribute}="([^"]*)"[^>]*>([^<]*)<'), F.lit(1))
    text = F.regexp_extract_all(html, F.lit(rf'{attribute}="([^"]*)"[^>]*>([^<]*)<'), F.lit(2))
    return F.arrays_zip(found.alias("name"), text.alias("text"))


def meta_field(text: Column, name: str, ends: tuple[str, ...]) -> Column:
    """What stands behind ``name:`` in a block of running text, up to the next of the given words or the end; NULL if absent."""
    stop = "|".join(rf"\s{e}" for e in ends)
    found = F.regexp_extract(text, rf"{name}:\s*(.*?)(?:{stop}|$)", 1)
    return F.when(text.rlike(rf"{name}:"), F.trim(found))


def grades(html: Column, item: str = "grade") -> Column:
    """map of label to number of a grid of ``<div class="grade"><span>label</span><b>number</b></div>`` cells."""
    pattern = rf'(?s)<div class="{item}">\s*<span>([^<]*)</span>\s*<b>([^<]*)</b>'
    names, values = (F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(names, F.transform(values, lambda v: v.try_cast("double")))


#: Board layouts by name: the pattern of one entry, and which of its groups are place, name and position.
BOARDS = {
    "table": (r"(?s)<tr[^>]*>\s*<td[^>]*>\s*(\d+)\.?\s*</td>\s*<td[^>]*>(?:<a[^>]*>)?([^<]+)(?:</a>)?</td>\s*<td[^>]*>([^<]*)</td>", (1, 2, 3)),
    "list": (r"(?s)<li[^>]*>\s*(\d+)\.\s*([^,<]+),\s*([^<]+)</li>", (1, 2, 3)),
    "heading": (r"(?s)<h[23][^>]*>\s*(\d+)[.)]\s*(?:<[^>]+>)*([^<|]+?)\s*\|\s*([^<]+?)\s*(?:</[^>]+>)*</h[23]>", (1, 2, 3)),
    "line": (r"(?m)^\s*(\d+)[.)]\s+([^,\n]+),\s*([^,\n]+)", (1, 2, 3)),
    "data": (r'"rank":\s*(\d+)\s*,\s*"name":\s*"([^"]+)"\s*,\s*"position":\s*"([^"]*)"', (1, 2, 3)),
}

#: Price layouts by name: the pattern of one entry, and which of its groups are name, line and price.
PRICES = {
    "row": (r"(?s)<td[^>]*>([^<]+)</td>\s*<td[^>]*>(?:o|u|over|under)?\s*([\d.]+)</td>\s*<td[^>]*>([+-]\d+)</td>", (1, 2, 3)),
    "text": (r"(?m)^\s*([A-Z][^:\n]*?):\s*(?:over|under|o|u)?\s*([\d.]+)\s*\(([+-]\d+)\)", (1, 2, 3)),
    "data": (r'"player":\s*"([^"]+)"\s*,\s*"line":\s*([\d.]+)\s*,\s*"price":\s*"?([+-]?\d+)"?', (1, 2, 3)),
}


def entries(html: Column, layout: Column, layouts: dict[str, tuple[str, tuple[int, int, int]]], names: tuple[str, str, str]) -> Column:
    """array<struct> of a page's entries in its order, read by the page's layout; an unknown layout has none."""
    out = F.array().cast(f"array<struct<{names[0]}:string,{names[1]}:string,{names[2]}:string>>")
    for name, (pattern, groups) in layouts.items():
        found = [F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(g)), lambda c: F.trim(unescaped(c))) for g in groups]
        parts = F.struct(*(f.alias(n) for f, n in zip(found, names, strict=True)))
        rows = lists.bound(parts, lambda x: F.transform(x[names[0]], lambda v, i: F.struct(v.alias(names[0]), *(F.get(x[n], i).alias(n) for n in names[1:]))))
        out = F.when(layout == name, rows).otherwise(out)
    return out
