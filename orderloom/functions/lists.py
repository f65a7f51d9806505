"""Array functions that the engine lacks, without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _blocks(a: Column) -> Column:
    """Sum of each 64 consecutive whole numbers."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(a) - 1, 6), F.lit(0))), lambda i: total(F.slice(a, i * 64 + 1, F.lit(64))))


def running_totals(a: Column) -> Column:
    """Sum of the whole numbers up to each place; sums over blocks keep the work near to linear."""
    far, near = (lambda i: F.shiftright(i, 12)), (lambda i: F.shiftright(i, 6))

    def place(x: Column) -> Column:
        return F.transform(
            x["a"],
            lambda _, i: total(F.slice(x["l"], F.lit(1), far(i))) + total(F.slice(x["b"], far(i) * 64 + 1, near(i) - far(i) * 64)) + total(F.slice(x["a"], near(i) * 64 + 1, i - near(i) * 64 + 1)),
        )

    more = lambda x: bound(F.struct(x["a"].alias("a"), x["b"].alias("b"), _blocks(x["b"]).alias("l")), place)
    return bound(a, lambda x: bound(F.struct(x.alias("a"), _blocks(x).alias("b")), more))


def ordered_distinct(a: Column) -> Column:
    """Distinct elements in the order in which they first stand."""
    return F.array_distinct(a)


def grid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every combination of the columns' present values, for columns of few values (years, sources, settings)."""
    out = df.agg(*(F.collect_set(c).alias(c) for c in columns))
    for c in columns:
        out = out.withColumn(c, F.explode(c))
    return out
