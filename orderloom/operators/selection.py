"""Exact quantiles of groups of any size, by refining brackets, so that a hot group stays many tasks.

A sketch of each group gives, for each wanted rank, two values of the group that the rank lies
between for sure (a sketch of accuracy a errs by at most n / a ranks). One more pass counts the rows
below the bracket and, by value, those inside. While a bracket still holds more rows than
``most``, a sketch of what is inside it narrows it. What is ordered in the end are the distinct values
inside a bracket, some n / a of them; all other rows are only counted, in partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.nulls import col
from orderloom.operators.lineage import cut

#: Bytes of a table of brackets that goes to all tasks; a larger one is joined by a shuffle that adaptive execution can split.
MOST_SENT = 32 << 20


def _sent(df: DataFrame, groups: int, targets: int) -> DataFrame:
    return F.broadcast(df) if groups * targets * 64 <= MOST_SENT else df


def quantiles(df: DataFrame, by: list[str], x: Column | str, shares: list[float], *, accuracy: int = 20_000, most: int = 1 << 20, rounds: int = 4, discrete: bool = False) -> DataFrame:
    """(by, n, q0, q1, ..): for each share the value at that place between the ranks, as ``F.percentile`` gives it; missing values do not count.

    discrete: the smallest value that at least that share of the values does not exceed.

    Groups without a value have n = 0 and NULL. The result does not depend on accuracy, most or rounds.
    """
    keys = {f"_k{i}": k for i, k in enumerate(by)}
    same = [F.col(n).eqNullSafe(F.col(k)) for n, k in keys.items()]
    named = lambda d: d.select(*(F.col(k).alias(n) for n, k in keys.items()), *(c for c in d.columns if c not in by))
    rows = df.select(*by, col(x).cast("double").alias("_x"))
    each = range(len(shares))
    # the two ranks around a share, and the bracket between values that a sketch is sure to have below and above them
    low_rank = lambda n, p: F.greatest(n - F.floor(n - n * F.lit(float(p))) - 1, F.lit(0)) if discrete else F.floor((n - 1) * F.lit(float(p)))
    slack = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p + s)) for p in shares for s in (-slack, slack)]
    sketch = cut(rows.groupBy(*by).agg(F.count("_x").alias("n"), F.percentile_approx("_x", ends, accuracy).alias("_e")))
    groups = sketch.count()
    # in small groups a slack below one rank says nothing: the rank beside is within two places in the sketch
    brackets = sketch.select(*by, "n", F.array(*(F.struct(F.lit(k).alias("k"), low_rank(F.col("n"), p).alias("r"), F.when(F.col("n") >= accuracy, F.get("_e", F.lit(2 * k))).otherwise(float("-inf")).alias("lo"), F.when(F.col("n") >= accuracy, F.get("_e", F.lit(2 * k + 1))).otherwise(float("inf")).alias("hi")) for k, p in zip(each, shares, strict=True))).alias("_b"))
    brackets, inside = _counted(rows, brackets, by, same, named, groups, len(shares))
    for _ in range(rounds):
        if inside <= most:
            break
        brackets = _narrowed(rows, brackets, by, same, named, groups, len(shares), accuracy)
        brackets, inside = _counted(rows, brackets, by, same, named, groups, len(shares))
    met = rows.filter("_x is not null").join(_sent(named(brackets.select(*by, "_b")), groups, len(shares)), same).drop(*keys)
    held = met.select(*by, "_x", F.explode(F.filter("_b", lambda b: (b["lo"] <= F.col("_x")) & (F.col("_x") <= b["hi"]))).alias("_h"))
    values = held.groupBy(*by, F.col("_h.k").alias("_t"), F.col("_h.r").alias("_r"), F.col("_h.below").alias("_w"), "_x").agg(F.count("*").alias("_c"))
    upto = F.col("_w") + F.sum("_c").over(Window.partitionBy(*by, "_t").orderBy("_x"))  # distinct values of one bracket
    told = values.withColumn("_s", upto).groupBy(*by, "_t").agg(F.min(F.when(F.col("_s") > F.col("_r"), F.col("_x"))).alias("_lo"), F.min(F.when(F.col("_s") > F.col("_r") + 1, F.col("_x"))).alias("_hi"))
    wide = told.groupBy(*by).agg(*(F.max(F.when(F.col("_t") == k, F.struct("_lo", "_hi"))).alias(f"_q{k}") for k in each))
    out = sketch.select(*by, "n").join(named(wide), same, "left")
    place = lambda p: F.lit(0.0) if discrete else (F.col("n") - 1) * F.lit(float(p)) - low_rank(F.col("n"), p)
    value = lambda k, p: F.col(f"_q{k}._lo") + place(p) * (F.coalesce(f"_q{k}._hi", f"_q{k}._lo") - F.col(f"_q{k}._lo"))
    return out.select(*by, "n", *(value(k, p).alias(f"q{k}") for k, p in zip(each, shares, strict=True)))


def _counted(rows, brackets, by, same, named, groups, targets):
    """brackets with the number of rows below and inside each, widened to all values where a rank is not inside; and the most that one holds."""
    met = rows.filter("_x is not null").join(_sent(named(brackets.select(*by, "_b")), groups, targets), same).drop(*(f"_k{i}" for i in range(len(by))))
    b = lambda k: F.get("_b", F.lit(k))
    sums = [f(F.count_if(c(k))).alias(f"{n}{k}") for k in range(targets) for n, f, c in (("_u", lambda c: c, lambda k: F.col("_x") < b(k)["lo"]), ("_v", lambda c: c, lambda k: F.col("_x").between(b(k)["lo"], b(k)["hi"])))]
    n = met.groupBy(*by).agg(*sums)
    full = brackets.join(named(n), same, "left").drop(*(f"_k{i}" for i in range(len(by))))

    def again(k: int) -> Column:
        below, inside = F.coalesce(F.col(f"_u{k}"), F.lit(0)), F.coalesce(F.col(f"_v{k}"), F.lit(0))
        good = (below <= b(k)["r"]) & ((below + inside > b(k)["r"] + 1) | (below + inside >= F.col("n")))
        return F.struct(
            F.lit(k).alias("k"), b(k)["r"].alias("r"), F.when(good, b(k)["lo"]).otherwise(float("-inf")).alias("lo"), F.when(good, b(k)["hi"]).otherwise(float("inf")).alias("hi"),
            F.when(good, below).otherwise(F.lit(0)).alias("below"), F.when(good, inside).otherwise(F.col("n")).alias("inside"),
        )

    out = cut(full.select(*by, "n", F.array(*(again(k) for k in range(targets))).alias("_b")))
    most = out.agg(F.max(F.array_max(F.transform("_b", lambda x: x["inside"])))).first()[0] or 0
    return out, most


def _narrowed(rows, brackets, by, same, named, groups, targets, accuracy):
    """brackets narrowed by sketches of the rows inside them."""
    met = rows.filter("_x is not null").join(_sent(named(brackets.select(*by, "_b")), groups, targets), same).drop(*(f"_k{i}" for i in range(len(by))))
    held = met.select(*by, "_x", F.explode(F.filter("_b", lambda b: (b["lo"] <= F.col("_x")) & (F.col("_x") <= b["hi"]))).alias("_h"))
    grid = [i / 200 for i in range(201)]
    sketched = held.groupBy(*by, F.col("_h.k").alias("_t")).agg(F.percentile_approx("_x", grid, accuracy).alias("_g"))
    wide = sketched.groupBy(*by).agg(*(F.max(F.when(F.col("_t") == k, F.col("_g"))).alias(f"_g{k}") for k in range(targets)))
    full = brackets.join(named(wide), same, "left").drop(*(f"_k{i}" for i in range(len(by))))
    b = lambda k: F.get("_b", F.lit(k))

    def again(k: int) -> Column:
        at = (b(k)["r"] - b(k)["below"]) / F.greatest(b(k)["inside"], F.lit(1)) * 200
        lo, hi = F.get(F.col(f"_g{k}"), F.greatest(F.floor(at) - 1, F.lit(0)).cast("int")), F.get(F.col(f"_g{k}"), F.least(F.ceil(at) + 1, F.lit(200)).cast("int"))
        return F.struct(F.lit(k).alias("k"), b(k)["r"].alias("r"), F.coalesce(lo, b(k)["lo"]).alias("lo"), F.coalesce(hi, b(k)["hi"]).alias("hi"))

    return full.select(*by, "n", F.array(*(again(k) for k in range(targets))).alias("_b"))
