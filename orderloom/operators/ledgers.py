"""Ledgers of any length: chained segments under a tree of hashes.

Lines of an addition are placed in a total order (by ranges, no task sees all) and cut into
segments of ``segment`` lines. A line's hash is that of its place and content; a segment's head is
the chain of its lines' hashes; heads are hashed together, ``FAN`` at a time, level by level, to the
root of the addition; roots chain on from the one before. An addition reads the earlier roots only
(a row for each addition), and every segment is verified by itself: an edited line shows by its
hash, a line that is gone, added or moved by its segment's head, a segment that is gone or a head
that was changed by the root, a root that was changed by the next one.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 256
GENESIS = "0" * 64
_ROOTS = "addition long, lines long, segments long, root string, chained string"


def line_hash(columns: list[str], at: str = "at") -> Column:
    return F.sha2(F.to_json(F.struct(at, *columns), {"ignoreNullFields": "false"}), 256)


def segment_heads(lines: DataFrame) -> DataFrame:
    """(addition, segment, n, head) of lines: addition, segment, at, line_hash."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("at", "line_hash"))), lambda x: x["line_hash"])  # of one segment
    return lines.groupBy("addition", "segment").agg(F.count("*").alias("n"), F.aggregate(own, F.lit(""), lambda acc, h: F.sha2(F.concat(acc, h), 256)).alias("head"))


def tree_roots(heads: DataFrame) -> DataFrame:
    """(addition, root): hashes of FAN children in order, level by level, until each addition has one node."""
    level = heads.select("addition", F.col("segment").alias("node"), F.col("head").alias("hash"))
    most = heads.agg(F.max("segment")).first()[0]
    while most is not None:
        level = level.groupBy("addition", F.expr(f"node div {FAN}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"))
        level = level.select("addition", "node", F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"])), ","), 256).alias("hash"))
        if most < FAN:
            break
        most //= FAN
    return level.select("addition", F.col("hash").alias("root"))


def _chained(before: str, addition: int, lines: int, segments: int, root: str) -> str:
    return hashlib.sha256(f"{before}|{addition}|{lines}|{segments}|{root}".encode()).hexdigest()


def _roots(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(_ROOTS).parquet(f"{path}/roots").orderBy("addition").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def append(df: DataFrame, path: str, order: list[str], columns: list[str], *, segment: int = 4096) -> None:
    """Add rows to the ledger below path (lines, heads and roots); order is total. The root is written last: an addition without one does not count."""
    from orderloom.sources.paged import placed

    spark = df.sparkSession
    before = _roots(spark, path)
    number = len(before)
    rows = placed(df.select(*dict.fromkeys([*order, *columns])), order).withColumn("addition", F.lit(number).cast("long")).withColumn("segment", F.expr(f"at div {segment}"))
    lines = rows.select("addition", "segment", "at", *columns, line_hash(columns).alias("line_hash"))
    here = lambda kind: f"{path}/{kind}/part={number}"
    lines.write.mode("overwrite").parquet(here("lines"))
    segment_heads(spark.read.parquet(here("lines"))).write.mode("overwrite").parquet(here("heads"))
    heads = spark.read.parquet(here("heads"))
    n, segments = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = tree_roots(heads).first()
    root = top["root"] if top else hashlib.sha256(b"").hexdigest()
    row = (number, n, segments, root, _chained(before[-1]["chained"] if before else GENESIS, number, n, segments, root))
    spark.createDataFrame([row], _ROOTS).write.mode("append").parquet(f"{path}/roots")


def read(spark: SparkSession, path: str, kind: str = "lines") -> DataFrame:
    """Lines, heads or roots of a ledger; of lines and heads those whose addition has its root."""
    if kind == "roots":
        return spark.read.schema(_ROOTS).parquet(f"{path}/roots")
    whole = spark.read.parquet(f"{path}/{kind}").drop("part")
    return whole.join(F.broadcast(read(spark, path, "roots").select("addition")), "addition", "left_semi")  # a row for each addition


def faults(lines: DataFrame, heads: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """(fault, addition, segment, at): edited lines, segments whose lines do not give their head, additions whose heads do not give their root, roots off the chain."""
    none = lambda name: F.lit(None).cast("long").alias(name)
    edited = lines.filter(line_hash(columns) != F.col("line_hash")).select(F.lit("line").alias("fault"), "addition", "segment", "at")
    now = segment_heads(lines.withColumn("line_hash", line_hash(columns))).select("addition", "segment", F.col("head").alias("_now"))
    moved = heads.join(now, ["addition", "segment"], "full").filter(~F.col("head").eqNullSafe(F.col("_now"))).select(F.lit("segment").alias("fault"), "addition", "segment", none("at"))
    stored, fresh = roots.select("addition", F.col("root").alias("_was")), tree_roots(heads)
    torn = stored.join(fresh, "addition", "full").filter((F.col("_was") != F.col("root")) | F.col("_was").isNull() | (F.col("root").isNull() & (F.col("_was") != hashlib.sha256(b"").hexdigest()))).select(F.lit("root").alias("fault"), "addition", none("segment"), none("at"))
    bad, last = [], GENESIS
    for i, r in enumerate(roots.orderBy("addition").collect()):  # a row for each addition
        if r["addition"] != i or r["chained"] != _chained(last, r["addition"], r["lines"], r["segments"], r["root"]):
            bad.append((r["addition"],))
        last = r["chained"]
    off = lines.sparkSession.createDataFrame(bad, "addition long").select(F.lit("chain").alias("fault"), "addition", none("segment"), none("at"))
    return edited.unionByName(moved).unionByName(torn).unionByName(off)
