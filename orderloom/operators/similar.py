"""Similarity join of short texts by their matching blocks, filtered so that no block of rows is compared whole.

The measure is that of ``difflib``: twice the characters in matching blocks over the length of both
texts. Let two texts of lengths a and b reach a ratio t, so that M >= t (a + b) / 2 characters match.

- M is at most the shorter length, so the shorter one is at least t / (2 - t) of the longer.
- Between two matching blocks at least one character is unmatched, so there are at most
  (a + b - 2 M) + 1 blocks, and the texts share at least M less that many pairs of neighbouring
  characters: more than (a + b) (3 t / 2 - 1) - 1, repeats counted.
- Where that is nothing (short texts, or t up to 2 / 3) they share M single characters.

Texts that share c of their grams share one among the first n - c + 1 of each, in any common order;
with the rarest first few texts meet. Rows join on (block, such a gram); pairs that the bounds leave
go to Python in Arrow batches, where all their grams are counted before blocks are matched. The
result holds every pair of a block that reaches the ratio.

Short texts of few letters share most of their grams. But matching blocks stand in the same order in
both texts, so the texts have a common subsequence of M characters; where each text of a pair of
lengths has at most ``MOST_KEYS`` choices of as many characters as must match, the pair meets on
these instead. Equal texts of a block are one class: classes meet, each two texts are compared
once, and copies come in only where their rows are given out.
"""

from __future__ import annotations

import difflib
import itertools
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.lineage import cut, ship

_EPS = 1e-9
#: Choices of characters that a text has at most where pairs meet on subsequences, and the longest text of such a pair.
MOST_KEYS, LONGEST = 128, 20


def short_sum(least: float) -> float:
    """Up to this sum of lengths the bound on pairs of characters says nothing."""
    return 1 / (1.5 * least - 1) + _EPS if least > 2 / 3 + 1e-6 else math.inf


def _grams(x: Column, q: int) -> Column:
    """Runs of q characters with their numbers among equal ones, as an array of (q, gram, number)."""
    n = F.length(x) - q + 1
    all_ = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(x, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    # bound by a lambda, so that the runs are cut once
    each = lambda g: F.flatten(F.transform(F.array_distinct(g), lambda one: F.transform(F.sequence(F.lit(1), F.size(F.filter(g, lambda o: o == one))), lambda k: F.struct(F.lit(q).alias("q"), one.alias("gram"), k.alias("k")))))
    return F.transform(F.array(all_), each)[0]


def _needed(a: Column, b: Column, q: int, least: float) -> Column:
    """Number of grams that texts of these lengths share at least."""
    bound = (a + b) * (1.5 * least - 1) - 1 if q == 2 else least * (a + b) / 2
    return F.greatest(F.ceil(bound - _EPS), F.lit(1)).cast("int")


def _by_subsequence(a: int, b: int, least: float) -> int | None:
    """How many characters match at least in texts of these lengths, if such pairs meet on subsequences."""
    m = max(math.ceil(least * (a + b) / 2 - _EPS), 1)
    low, high = min(a, b), max(a, b)
    if not 0 < low <= high <= LONGEST or m > low or low < high * (least / (2 - least)) - _EPS:
        return None
    return m if max(math.comb(a, m), math.comb(b, m)) <= MOST_KEYS else None


def _wanted(least: float) -> list[list[int]]:
    """For each length up to LONGEST the lengths of subsequences that its texts are found by."""
    each = range(1, LONGEST + 1)
    return [[], *(sorted({m for b in each if (m := _by_subsequence(a, b, least))}) for a in each)]


def _grams_needed(least: float) -> list[int]:
    """Lengths up to LONGEST with a partner that they can reach the ratio with and do not meet on subsequences."""
    span = lambda a: range(max(math.ceil(a * (least / (2 - least)) - _EPS), 1), math.floor(a * ((2 - least) / least) + _EPS) + 1)
    return [a for a in range(1, LONGEST + 1) if any(_by_subsequence(a, b, least) is None for b in span(a))]


def _subsequences(least: float):
    """All (m, key) of a text."""
    wanted = _wanted(least)

    @F.pandas_udf("array<struct<m:int,key:string>>")
    def keys(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [(m, k) for m in (wanted[len(t)] if len(t) <= LONGEST else ()) for k in {"".join(c) for c in itertools.combinations(t, m)}])

    return keys


def _marked(df: DataFrame, least: float) -> DataFrame:
    """df (id, block, x) with its length and, for either kind of gram that it may need, all grams."""
    n, top = F.length("x"), short_sum(least)
    shortest = F.ceil(n * (least / (2 - least)) - _EPS)
    far = (n > LONGEST) | n.isin(_grams_needed(least))
    two = F.when(far & (n + F.floor(n * ((2 - least) / least) + _EPS) > top), _grams(F.col("x"), 2))  # some partner makes a sum above
    one = F.when(far & (n + shortest <= top), _grams(F.col("x"), 1))
    return df.withColumns({"n": n, "g2": two, "g1": one, "shortest": shortest})


def _first(df: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(id, block, x, n, q, gram, k): the rarest grams of each text, as many as any partner needs."""
    parts = None
    for q in (2, 1):
        own = df.filter(F.size(f"g{q}") > 0).select("id", "block", "x", "n", "shortest", F.size(f"g{q}").alias("m"), F.inline(f"g{q}"))
        parts = own if parts is None else parts.unionByName(own)
    ranked = parts.join(counts, ["q", "gram", "k"]).groupBy("id", "block", "x", "n", "shortest", "m", "q").agg(F.array_sort(F.collect_list(F.struct("count", "gram", "k"))).alias("g"))
    need = F.when(F.col("q") == 2, _needed(F.col("n"), F.col("shortest"), 2, least)).otherwise(_needed(F.col("n"), F.col("shortest"), 1, least))
    head = F.slice("g", F.lit(1), F.greatest(F.col("m") - need + 1, F.lit(0)))
    return ranked.select("id", "block", "x", "n", "q", F.inline(head)).drop("count")


def _ratio(least: float):
    """The ratio of two texts, or NULL where the bags of their grams show that it stays below ``least``."""
    pairs_from = short_sum(least)

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        bags: dict[str, tuple[Counter, Counter]] = {}

        def bag(t: str) -> tuple[Counter, Counter]:
            if t not in bags:
                bags[t] = Counter(t), Counter(map("".join, zip(t, t[1:], strict=False)))
            return bags[t]

        def one(a: str, b: str) -> float | None:
            n, (a1, a2), (b1, b2) = len(a) + len(b), bag(a), bag(b)
            if 2 * sum((a1 & b1).values()) < least * n - _EPS:
                return None
            if n > pairs_from and sum((a2 & b2).values()) < n * (1.5 * least - 1) - 1 - _EPS:
                return None
            return difflib.SequenceMatcher(None, a, b).ratio()

        return pd.Series([one(a, b) for a, b in zip(x, y, strict=True)], dtype="float64")

    return ratio


def _classes(df: DataFrame, id_: str, block: Column, x: Column) -> DataFrame:
    """(block, x, id): the distinct texts of each block with their smallest ids."""
    rows = df.select(F.col(id_).alias("id"), block.alias("block"), x.alias("x")).filter("block is not null and x is not null")
    return cut(rows.groupBy("block", "x").agg(F.min("id").alias("id"), F.count("*").alias("copies")))  # read many times


def class_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(lid, rid, score): pairs of classes of a block that reach the ratio. left, right: (block, x, id), each text of a block once."""
    ship(left.sparkSession)
    # few bytes and much work a row: adaptive execution would make a few tasks of them, but keeps a number that is given
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [d.select("id", "block", "x") for d in (left, right)]
    a, b = (_marked(d, least) for d in sides)
    every = None
    for d in (a, b):
        for q in (2, 1):
            own = d.select(F.inline(f"g{q}"))
            every = own if every is None else every.unionByName(own)
    counts = every.groupBy("q", "gram", "k").agg(F.count("*").alias("count"))
    l, r = (_first(d, counts, least).select(F.col("x").alias(x), F.col("n").alias(n), "block", "q", "gram", "k") for d, x, n in ((a, "lx", "ln"), (b, "rx", "rn")))  # noqa: E741
    pair = {(i, j): m for i in range(1, LONGEST + 1) for j in range(1, LONGEST + 1) if (m := _by_subsequence(i, j, least))}
    needed = F.lit([pair.get((i, j), 0) for i in range(LONGEST + 1) for j in range(LONGEST + 1)] or [0])
    near = lambda i, j: F.when((i <= LONGEST) & (j <= LONGEST), F.get(needed, (i * (LONGEST + 1) + j).cast("int"))).otherwise(0)
    low, high = F.least("ln", "rn"), F.greatest("ln", "rn")
    short = F.col("ln") + F.col("rn") <= short_sum(least)
    met = l.join(r, ["block", "q", "gram", "k"]).filter((low >= high * (least / (2 - least)) - _EPS) & ((F.col("q") == 1) == short) & (near(F.col("ln"), F.col("rn")) == 0)).select("lx", "rx", "block")
    keyed = lambda d, x: d.repartition(tasks).select("block", F.col("x").alias(x), F.inline(_subsequences(least)("x")))
    by_key = keyed(sides[0], "lx").join(keyed(sides[1], "rx"), ["block", "m", "key"]).filter(near(F.length("lx"), F.length("rx")) == F.col("m")).select("lx", "rx", "block")
    texts = met.unionByName(by_key).select("lx", "rx").distinct().repartition(tasks)
    scored = texts.withColumn("score", _ratio(least)(F.col("lx"), F.col("rx"))).filter(F.col("score") >= least - _EPS)
    empty = sides[0].filter("x = ''").select("block").join(sides[1].filter("x = ''").select("block"), "block").select(F.lit("").alias("lx"), F.lit("").alias("rx"), F.lit(1.0).alias("score")).distinct()
    l, r = sides[0].select(F.col("id").alias("lid"), "block", F.col("x").alias("lx")), sides[1].select(F.col("id").alias("rid"), "block", F.col("x").alias("rx"))  # noqa: E741
    return scored.unionByName(empty).join(l, "lx").join(r, ["block", "rx"]).select("lid", "rid", "score")


def _members(df: DataFrame, id_: str, block: Column, x: Column, classes: DataFrame, of: str) -> DataFrame:
    """(id_, of): each row that takes part with the id of its class."""
    own = df.select(F.col(id_), block.alias("block"), x.alias("x"))
    return own.join(classes.select("block", "x", F.col("id").alias(of)), ["block", "x"]).select(id_, of)


def linked_classes(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: tuple[Column, Column], name: tuple[Column, Column], least: float) -> DataFrame:
    """(part, left_id, right_id, class, score): links between classes of equal names, and who is in which class.

    Rows of part "pair" are pairs of classes, named by their smallest ids, whose names reach the
    ratio; of part "left" and "right" the rows of either side with the id of their class. The pairs of
    rows that ``similarity_join`` gives are those of the classes' members.
    """
    a, b = _classes(left, left_id, block[0], name[0]), _classes(right, right_id, block[1], name[1])
    pairs = class_pairs(a, b, least)
    none = F.lit(None).cast("long")
    l, r = _members(left, left_id, block[0], name[0], a, "class"), _members(right, right_id, block[1], name[1], b, "class")  # noqa: E741
    out = pairs.select(F.lit("pair").alias("part"), F.col("lid").alias(left_id), F.col("rid").alias(right_id), none.alias("class"), "score")
    out = out.unionByName(l.select(F.lit("left").alias("part"), left_id, none.alias(right_id), "class", F.lit(None).cast("double").alias("score")))
    return out.unionByName(r.select(F.lit("right").alias("part"), none.alias(left_id), right_id, "class", F.lit(None).cast("double").alias("score")))


def similarity_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: tuple[Column, Column], name: tuple[Column, Column], least: float) -> DataFrame:
    """(left_id, right_id, score): pairs of a block whose names have a ratio of at least ``least`` (above 0).

    Ids are unique on either side; rows with a null block or name take no part; two empty names
    have a ratio of 1. Copies are paired with copies, so give ``linked_classes`` where names repeat.
    """
    a, b = _classes(left, left_id, block[0], name[0]), _classes(right, right_id, block[1], name[1])
    pairs = class_pairs(a, b, least)
    l, r = _members(left, left_id, block[0], name[0], a, "lid"), _members(right, right_id, block[1], name[1], b, "rid")  # noqa: E741
    return pairs.join(l, "lid").join(r, "rid").select(left_id, right_id, "score")


def clear_best(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: tuple[Column, Column], name: tuple[Column, Column], least: float, margin: float) -> DataFrame:
    """(left_id, right_id, score): of each left row the most similar right row of its block, if it reaches ``least`` and leads the second by ``margin``.

    Only rows within the margin below ``least`` can stand in the way, so pairs below that are never
    formed. Equal names score alike: a class of several right rows has its second beside its first,
    and a left class has one answer for all its rows.
    """
    a, b = _classes(left, left_id, block[0], name[0]), _classes(right, right_id, block[1], name[1])
    pairs = class_pairs(a, b, least - margin)
    by = Window.partitionBy("lid").orderBy(F.desc("score"), "rid")
    ranked = pairs.withColumns({"_n": F.row_number().over(by), "_next": F.lead("score").over(by)}).filter((F.col("_n") == 1) & (F.col("score") >= least))
    second = F.when(F.col("copies") > 1, F.col("score")).otherwise(F.col("_next"))
    top = ranked.join(b.select(F.col("id").alias("rid"), "copies"), "rid").filter(second.isNull() | (F.col("score") - second >= margin))
    return top.join(_members(left, left_id, block[0], name[0], a, "lid"), "lid").select(left_id, F.col("rid").alias(right_id), "score")
