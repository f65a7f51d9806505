"""Point-in-time joins: every one has an equality key, and nothing after a cutoff is seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.dedup import best_by
from orderloom.operators.windows import ordinal


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, tolerance: str, tie: str) -> DataFrame:
    """Each left row with the latest right row at or before its time, no older than a tolerance.

    The two are merged into one ordered stream per key, so the cost is one sort, whatever the
    number of right rows in reach; right columns come back prefixed with ``r_``.
    """
    cols = [c for c in right.columns if c != key]
    r = right.select(key, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(*cols).alias("_r"))
    l = left.select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side", F.asc_nulls_last("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    near = F.col(f"_r.{ts}") >= F.col("_t") - F.expr(f"interval {tolerance}")
    return seen.select("_l.*", *(F.when(near, F.col(f"_r.{c}")).alias(f"r_{c}") for c in cols))


def valid_between(left: DataFrame, right: DataFrame, key: list[str], condition: Column, how: str = "inner") -> DataFrame:
    """Equality join on keys with a range condition; name the sides l and r in it."""
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in key]
    return left.alias("l").join(right.alias("r"), [*on, condition], how)


def first_periods(df: DataFrame, by: list[str], period: str, value: str, k: int, through: int | None = None) -> DataFrame:
    """(by, total, n): sum of the first k periods that were played, as known through a period."""
    rows = df if through is None else df.filter(F.col(period) <= through)
    kept = rows.withColumn("_n", ordinal(by, F.col(period))).filter(F.col("_n") <= k)
    return kept.groupBy(*by).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def best_periods(df: DataFrame, by: list[str], period: str, value: str, k: int) -> DataFrame:
    kept = df.withColumn("_n", ordinal(by, F.desc(value), F.col(period))).filter(F.col("_n") <= k)
    return kept.groupBy(*by).agg(F.avg(value).alias("best"))


def latest_within(df: DataFrame, by: list[str], period: str, now: Column, years: int, tie: list[Column]) -> DataFrame:
    """The last row of each key at or before now, no more than some years back."""
    return best_by(df.filter(F.col(period).between(now - years, now)), by, [F.desc(period), *tie])


def previous(df: DataFrame, by: list[str], period: str, columns: list[str], gap: int = 1) -> DataFrame:
    """df with the columns of exactly gap periods before, prefixed ``prev_``."""
    old = df.select(*by, (F.col(period) + gap).alias(period), *(F.col(c).alias(f"prev_{c}") for c in columns))
    return df.join(old, [*by, period], "left")


def as_of_any(left: DataFrame, rights: list[tuple[str, DataFrame, str]], key: str, at: str, ts: str, tie: str, value: str) -> DataFrame:
    """left with ``value`` and ``source`` of the first source that has a row at or before its time and within that source's tolerance."""
    names = []
    for name, right, tolerance in rights:
        left = as_of(left, right.select(key, ts, tie, value), key, at, ts, tolerance, tie).drop(f"r_{ts}", f"r_{tie}").withColumnRenamed(f"r_{value}", f"_v_{name}")
        names.append(name)
    source = F.coalesce(*(F.when(F.col(f"_v_{n}").isNotNull(), F.lit(n)) for n in names))
    return left.withColumns({value: F.coalesce(*(F.col(f"_v_{n}") for n in names)), "source": source}).drop(*(f"_v_{n}" for n in names))
