"""Deterministic duplicates: what goes and what stays is always ordered explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that has no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_none(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def unambiguous(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs that are the only one of both their sides."""
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    return pairs.withColumns({"_l": n(left), "_r": n(right)}).filter("_l = 1 and _r = 1").drop("_l", "_r")


def merge_records(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row per key with each column's first present value."""
    return df.groupBy(*keys).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns))


def fill_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a, and those of b whose key a lacks."""
    return a.unionByName(b.join(a.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join that fails while it runs if a side that must be unique is not. validate: "m:1", "1:m" or "1:1"."""
    if validate not in ("m:1", "1:m", "1:1"):
        raise ValueError(f"no validation {validate!r}")

    def unique(df: DataFrame, side: str) -> DataFrame:
        again = F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(1))) > 1
        stop = F.raise_error(F.lit(f"the {side} side repeats a key")).cast("boolean")
        return df.withColumn("_again", again).filter(F.when(F.col("_again"), stop).otherwise(True)).drop("_again")

    a, b = validate.split(":")
    return (unique(left, "left") if a == "1" else left).join(unique(right, "right") if b == "1" else right, on, how)
