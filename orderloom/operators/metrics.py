"""How good an order is: value captured, discounted gain, hits, gates and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.nulls import sdiv
from orderloom.operators.windows import ordinal


def order_metrics(df: DataFrame, by: str, value: str, ours: Column, theirs: Column, tie: str, k: int) -> DataFrame:
    """(by, captured, ndcg, hits, value_of_order) of an order against a baseline; all from three ordinals."""
    v = F.col(value)
    ranked = df.withColumns({"_o": ordinal([by], F.desc_nulls_last(ours), F.col(tie)), "_t": ordinal([by], F.desc_nulls_last(theirs), F.col(tie)), "_b": ordinal([by], F.desc_nulls_last(v), F.col(tie))})
    top = lambda r: F.sum(F.when(F.col(r) <= k, v).otherwise(0.0))
    gain = lambda r: F.sum(F.when(F.col(r) <= k, F.greatest(v, F.lit(0.0)) / F.log2(F.col(r) + 1)).otherwise(0.0))
    slots = lambda r: F.sum((F.lit(1.0) - F.col(r)) * v)
    agg = ranked.groupBy(by).agg(
        top("_o").alias("o"), top("_t").alias("t"), top("_b").alias("b"), gain("_o").alias("g"), gain("_b").alias("gb"),
        F.count_if((F.col("_o") <= k) & (F.col("_b") <= k)).alias("hits"), slots("_o").alias("so"), slots("_b").alias("sb"),
    )
    captured = F.when(F.col("b") > F.col("t"), 100 * (F.col("o") - F.col("t")) / (F.col("b") - F.col("t"))).otherwise(0.0)
    return agg.select(by, captured.alias("captured"), (F.col("g") / F.greatest(F.col("gb"), F.lit(1e-9))).alias("ndcg"), "hits", sdiv("so", "sb").alias("slot_cost"))


def fold_gate(df: DataFrame, gain: str, order: str, least: float, wins: int, latest: int = 2) -> DataFrame:
    """(mean_gain, wins, n, passed): mean gain, number of winning folds, and whether the last ones hold."""
    last = df.withColumn("_r", F.row_number().over(_all(F.desc(order))))
    agg = last.agg(F.avg(gain).alias("mean_gain"), F.count_if(F.col(gain) > 0).alias("wins"), F.count("*").alias("n"), F.min(F.when(F.col("_r") <= latest, F.col(gain))).alias("_l"))
    return agg.withColumn("passed", (F.col("mean_gain") >= least) & (F.col("wins") >= wins) & (F.col("_l") >= 0)).drop("_l")


def _all(*order: Column):
    """One window over folds, of which there are a few dozen."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(*order)
