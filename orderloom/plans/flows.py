"""Streams with state, and tables that are fetched page by page."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators.lineage import landing
from orderloom.plans.base import Book, rounded
from orderloom.sources import paged
from orderloom.sources.readers import table
from orderloom.streaming import events as streams
from orderloom.streaming import histories

book = Book()
QUERIES, ORACLE = book.queries, book.sql

_EVENTS = "id long, entity long, kind string, ts timestamp, value double"


@book.query("""WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS mark FROM events),
x AS (SELECT event_id AS id, user_id AS entity, event_type AS kind, ts, value, count(*) OVER b AS n_before, coalesce(sum(value) OVER l, 0) AS prev_sum, count(*) OVER l AS prev_n, sum(value) OVER b AS sum_before, row_number() OVER k - 1 AS met_before, first_value(value) OVER k AS first
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), k AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT id, entity, kind, n_before, round(prev_sum, 2) AS prev_sum, prev_n, round(coalesce(sum_before, 0), 2) AS sum_before, met_before, round(CASE WHEN met_before > 0 THEN value - first END, 2) AS gain FROM x, m WHERE ts <= mark""")
def stream_histories(spark, d):
    """R-5, R-6: the ten before, means so far and rematches of each event, kept as state over two landings and a restart."""
    histories.keeps_state(spark)
    e = table(spark, d, "events", ["event_id", "user_id", "event_type", "ts", "value"]).select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")
    low, high, n = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count("*")).first()
    hours = (F.pmod(F.xxhash64("id"), F.lit(12)) * 3_600_000_000).cast("long")  # up to half a day out of order
    part = F.least(F.floor((F.unix_micros("ts") + hours - low) * 2 / max(1, high - low)), F.lit(1))
    path, out, mark = landing(spark, "events"), landing(spark, "out"), landing(spark, "mark")
    for k in range(2):
        e.filter(part == k).write.mode("append").parquet(path)
        s = spark.readStream.schema(_EVENTS).parquet(path)
        made = streams.drain(histories.with_history(s, late="1 day", last=10, shards=max(128, n // 20_000)), out, mark)
    return rounded(made.withColumn("sum_before", F.coalesce(F.col("mean_before") * F.col("n_before"), F.lit(0.0))).drop("ts", "value", "mean_before"), 2)


_ORDERS = "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double"


@book.query("SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders")
def paged_table(spark, d):
    """A table behind order and range paging, as a data source whose tasks ask for their own pages."""
    folder = landing(spark, "pages")
    paged.publish(table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]), folder, ["o_orderkey"], page=250)
    paged.register(spark)
    return rounded(spark.read.format("paged").schema(_ORDERS).options(url=folder, page=250, pages=4).load(), 2)


@book.query("SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= (SELECT count(*) // 2 // 250 * 250 FROM orders) THEN 1 ELSE 2 END::BIGINT AS round FROM orders")
def paged_stream(spark, d):
    """S26, R-3: pages that come later are fetched by a stream that goes on from its checkpoint and asks for nothing twice."""
    folder, out, mark = landing(spark, "pages"), landing(spark, "out"), landing(spark, "mark")
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    half = o.count() // 2 // 250 * 250
    paged.register(spark)

    def take(number: int):
        s = spark.readStream.format("paged").schema("o_orderkey long, o_custkey long").options(url=folder, page=250, pages=4).load()
        return streams.drain(s.withColumn("round", F.lit(number).cast("long")), out, mark)

    keyed = paged.placed(o, ["o_orderkey"])
    paged.publish(keyed.filter(F.col("at") < half).drop("at"), folder, ["o_orderkey"], page=250)
    take(1)
    take(1)
    paged.publish(keyed.filter(F.col("at") >= half).drop("at"), folder, ["o_orderkey"], page=250, first=half)
    return take(2)
