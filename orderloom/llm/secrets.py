"""Secret spans and corpus-wide ownership of their values, in DataFrame functions only.

One scan finds the base spans and further candidates (long strings of mixed case and digits).
Values are hashed, and distinct repositories and owners are counted for each hash over the whole
corpus: a value that many own is an example that was copied around, one that few own looks live.
Candidates that look live are added to the base spans as kind ``live``; base spans stay as they
are, and are counted by what their values look like. The scan's result is written once; text is
not shuffled. A hash that a third of all rows hold is met by partial aggregates and a join that
adaptive execution can split.

Positions are code points. Matches come from ``split`` and ``regexp_extract_all`` with one
pattern: the parts between matches and the matches themselves tell where each match starts.

Defined cases: null texts are empty and have no spans; null owners are one owner, null
repositories one repository; repeated rows keep their own spans and count once for a
repository; no rows give no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm import scratch

#: The base patterns and the least length of what must be long.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "live")
LEAST = {"assign": 6, "access": 20, "hex": 24, "live": 32}
#: Runs that may be credentials without a name in front.
LIVE = r"[A-Za-z0-9+/_-]{32,}"


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sums(a: Column) -> Column:
    """Sum of each 64 consecutive numbers of an array that is not empty."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(a) - 1, 6)), lambda i: _total(F.slice(a, i * 64 + 1, F.lit(64))))


def _found(text: Column, pattern: str, kind: int, group: int = 0, few: str | None = None) -> Column:
    """array<struct(start, kind, end, value)> of the leftmost non-overlapping matches of a pattern.

    The i-th match starts behind all gaps and matches before it; sums over blocks of 64 and of 4,096
    numbers keep the work for a text with many matches near to linear.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def steps(x: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(x["w"], F.length))
        return _with(F.struct(x["w"].alias("w"), x["v"].alias("v"), F.zip_with(x["g"], before, lambda a, b: a + b).alias("c")), blocks)

    def blocks(x: Column) -> Column:
        return _with(F.struct(x["w"].alias("w"), x["v"].alias("v"), x["c"].alias("c"), _sums(x["c"]).alias("b")), larger)

    def larger(x: Column) -> Column:
        return _with(F.struct(x["w"].alias("w"), x["v"].alias("v"), x["c"].alias("c"), x["b"].alias("b"), _sums(x["b"]).alias("l")), place)

    def place(x: Column) -> Column:
        far, near = (lambda i: F.shiftright(i, 12)), (lambda i: F.shiftright(i, 6))
        start = lambda i: (
            _total(F.slice(x["l"], F.lit(1), far(i)))
            + _total(F.slice(x["b"], far(i) * 64 + 1, near(i) - far(i) * 64))
            + _total(F.slice(x["c"], near(i) * 64 + 1, i - near(i) * 64 + 1))
        )
        made = F.transform(x["w"], lambda m, i: F.struct(start(i).alias("start"), F.length(m).alias("n"), F.get(x["v"], i).alias("value")))
        made = F.filter(made, lambda s: F.length(s["value"]) >= LEAST[KINDS[kind]])
        return F.transform(made, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), (s["start"] + s["n"]).alias("end"), s["value"].alias("value")))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(text.rlike(few or pattern), _with(F.struct(whole.alias("w"), value.alias("v"), gaps.alias("g")), steps)).otherwise(none)


def _render(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, text: str = "text", repository: str = "doc_id", owner: str = "source", max_owners: int = 1, max_repositories: int = 2, row: str | None = None) -> DataFrame:
    """(doc_id, base, added, n_live, n_copied): spans of every row of docs, as arrays of (start, kind, end).

    max_owners, max_repositories: a value with more of either counts as copied. row: a column of
    docs that is returned as ``row`` beside them.
    """
    also = [] if row is None else [F.col(row).alias("row")]
    t = F.coalesce(F.col(text), F.lit(""))
    # a hex run below the least length fails and hides nothing, so only long ones are searched for;
    # likewise a short access match: what it takes up holds no longer one
    base = F.concat(
        _found(t, ASSIGN, 0, 2, r"(?i)passw(?:or)?d|secret|token|api_?key"),
        _found(t, r"AKIA[A-Z0-9]{16,}", 1),
        _found(t, r"[0-9a-f]{24,}", 2),
    )
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    more = F.filter(_found(t, LIVE, 3), mixed)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
        F.array_sort(base).alias("base"), more.alias("more"), *also,
    )
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    rows = scratch.stash(rows.withColumn("more", F.filter("more", lambda s: ~inside(s))), "secrets")
    some = rows.filter((F.size("base") > 0) | (F.size("more") > 0))
    one = some.select("rid", "repository", "owner", F.explode(F.concat("base", "more")).alias("s"))
    one = one.select("rid", F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"), F.sha2("s.value", 256).alias("hash"), F.struct("s.start", "s.kind", "s.end").alias("s"))
    known = one.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("x"))
    held = known.groupBy("hash", "owner").agg(F.count("*").alias("r")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    told = one.join(held.select("hash", live.alias("live")), "hash").groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s")))).alias("added"),
        F.count_if(F.col("live") & (F.col("s.kind") < 3)).alias("n_live"), F.count_if(~F.col("live") & (F.col("s.kind") < 3)).alias("n_copied"),
    )
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.join(told, "rid", "left").select(
        "doc_id", bare("base").alias("base"), F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), *(["row"] if also else [])
    )


def report(spans: DataFrame) -> DataFrame:
    """Counts, digest and text of the spans that ``scan`` found."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_render(F.col("base")), 256).alias("base_sha256"),
        _render(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied",
    )


def _islands(spans: DataFrame, of: str) -> DataFrame:
    """(of, start, end): spans of each text, those that overlap as one."""
    by = Window.partitionBy(of).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("reach", reach).withColumn("island", number).groupBy(of, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


#: Characters of a block that a text is cut into, as finding a place in a text starts at its beginning.
BLOCK = 1 << 12


def _masked(blocks: Column, islands: Column, mask: str) -> Column:
    """A text, in blocks, with each of its sorted islands replaced by a mask."""

    def piece(a: Column, b: Column | None) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        n = F.size(blocks) - first if b is None else F.floor((b - 1) / BLOCK).cast("int") - first + 1
        text = F.array_join(F.slice(blocks, first + 1, F.greatest(n, F.lit(0))), "")
        inside = F.substring(text, a % BLOCK + 1, F.lit(2**31 - 1) if b is None else b - a)
        return inside if b is None else F.when(b > a, inside).otherwise("")

    before = lambda s, i: piece(F.when(i == 0, 0).otherwise(F.get(islands, i - 1)["end"]), s["start"])
    return F.array_join(F.concat(F.transform(islands, before), F.array(piece(F.element_at(islands, -1)["end"], None))), mask)


def redact(docs: DataFrame, mask: str = "[SECRET]", most_sent: int = 500_000, **how) -> DataFrame:
    """docs with every span of ``scan`` replaced by a mask; spans that overlap become one. Every row stays a row.

    Up to most_sent spans go to all executors, so that texts stay where they are; more are joined
    by a shuffle. The rows are the same.
    """
    row, of, spans = scratch.unused(docs, "row", "of", "spans")
    docs, columns = scratch.numbered(docs, row), scratch.named(docs)
    each = scan(docs, row=row, **how).select(F.col("row").alias(of), F.inline(F.concat("base", "added"))).drop("kind")
    found = scratch.stash(_islands(each, of).groupBy(of).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans)), "spans")
    if (found.agg(F.sum(F.size(spans))).first()[0] or 0) <= most_sent:
        found = F.broadcast(found)
    # bound by lambdas, so that a text is cut into blocks once, whatever the number of its spans
    clean = F.transform(F.array(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), 0)), lambda blocks: _masked(blocks, F.col(spans), mask))[0]
    joined = docs.join(found, F.col(row) == F.col(of), "left").withColumn("text", F.when(F.col(spans).isNotNull(), clean).otherwise(F.col("text")))
    return joined.select(*columns)
