"""Registration of queries, and the views that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries of one module with the SQL that checks them."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def put(f: Query) -> Query:
            self.queries[name or f.__name__] = f
            if sql:
                self.sql[name or f.__name__] = sql
            return f

        return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; ranks and counts as longs."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType):
            out[f.name] = F.round(f.name, digits) + 0.0
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out) if out else df


def member_values(spark: SparkSession, d: str) -> DataFrame:
    """(cohort, entity, value): each customer's revenue in each order year."""
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    l = table(spark, d, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"])  # noqa: E741
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.year("o_orderdate").alias("cohort"), F.col("o_custkey").alias("entity")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("value"))


#: The same view for SQL.
MEMBERS = """v AS (SELECT year(o_orderdate)::BIGINT AS cohort, o_custkey AS entity, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def supplier_years(spark: SparkSession, d: str) -> DataFrame:
    """(supp, year, qty, revenue, lines) of each supplier and ship year."""
    l = table(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"])  # noqa: E741
    return l.groupBy(F.col("l_suppkey").alias("supp"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 4).alias("revenue"), F.count("*").alias("lines"))


SUPPLIER_YEARS = """s AS (SELECT l_suppkey AS supp, year(l_shipdate)::BIGINT AS year, sum(l_quantity) AS qty, round(sum(l_extendedprice), 4) AS revenue, count(*) AS lines FROM lineitem GROUP BY 1, 2)"""

#: Average rank over the number of present values, as SQL.
def pct_sql(x: str, by: str, source: str = "", desc: bool = False) -> str:
    order = f"{x} DESC NULLS LAST" if desc else f"{x} ASC NULLS LAST"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {order}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"


def rank_sql(x: str, by: str, desc: bool = False) -> str:
    order = f"{x} DESC NULLS LAST" if desc else f"{x} ASC NULLS LAST"
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {order}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"
