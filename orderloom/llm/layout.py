"""Clustered layout in four dimensions: rows in Z order of (source, lang, length, date), cut into files.

A value's coordinate is the share of rows with a smaller value, in ``2 ** bits`` steps. Values of
all four dimensions are counted, ranged by value and summed partition by partition, so that the
first value of each coordinate is exact; these at most ``4 * 2 ** bits`` values turn rows into
cells without a shuffle. Rows then move once, ranged by (z, doc_id), and a row's position is its
place in its range behind all ranges before it.

How many files a cell's query touches comes from a four-dimensional difference array: each file's
box, dilated by the query's reach on length and date, adds sixteen signed corners; prefix sums
over the ``(2 ** bits + 1) ** 4`` sums give the number for every cell. Files that hold a row inside
the query are counted from distinct pairs of file and cell, of which, rows being in order, there
are at most as many as files and cells together.

What reaches the driver: a count and a sample of a hundred or so short keys for each range (of which
there are as many as ``spark.sql.shuffle.partitions``), the first values, and the corner sums; what is broadcast are the counts by range and the two numbers
of each of the ``16 ** bits`` cells. None of them grows with the rows.

Defined cases: a null source or lang is a value, the least; a null text has length -1; a null
doc_id has a null date, the least, and comes first in its cell; rows equal in z and doc_id take
their positions in an order that is fixed by where they are stored; no rows give no rows; other
columns do not matter.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm import scratch

#: Names of the dimensions, and how far a query reaches in each, in coordinates.
DIMENSIONS = {"source": 0, "lang": 0, "length": 1, "date": 1}
DAYS = 365
_LOW = (1 << 33) - 1  # a row's number in its partition, within monotonically_increasing_id


def values(docs: DataFrame) -> DataFrame:
    """(doc_id, row, source, lang, length, date) of every row of docs; row says where it is stored."""
    length = F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    date = F.crc32(F.col("doc_id").cast("string").cast("binary")) % DAYS
    return docs.select("doc_id", "row", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), length.alias("length"), date.alias("date"))


def _before(ordered: DataFrame, *by: str, amount: Column) -> list[tuple]:
    """(range, by, what all ranges before it add up to), of a table whose column ``at`` numbers rows by range."""
    rows = ordered.groupBy(F.shiftright("at", 33).alias("part"), *by).agg(F.sum(amount).alias("n")).collect()
    out, total = [], {}
    for r in sorted(rows, key=lambda r: r["part"]):
        key = tuple(r[c] for c in by)
        out.append((r["part"], *key, total.get(key, 0)))
        total[key] = total.get(key, 0) + r["n"]
    return out


def _first_values(rows: DataFrame, levels: int) -> list[list[tuple[int, str | int | None]]]:
    """For each dimension the coordinates that occur, each with its first value."""
    spark, none = rows.sparkSession, F.lit(None)
    slots = [x for i, (c, kind) in enumerate((c, rows.schema[c].dataType.simpleString()) for c in DIMENSIONS) for x in (F.lit(i), *((F.col(c), none.cast("long")) if kind == "string" else (none.cast("string"), F.col(c))))]
    counts = rows.select(F.stack(F.lit(len(DIMENSIONS)), *slots).alias("dim", "s", "x")).groupBy("dim", "s", "x").agg(F.count("*").alias("n"))
    order = [F.asc_nulls_first(c) for c in ("dim", "s", "x")]
    ordered = scratch.stash(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "counts")
    before = _before(ordered, "dim", amount=F.col("n"))
    n = sum(r["n"] for r in ordered.filter("dim = 0").groupBy(F.shiftright("at", 33)).agg(F.sum("n").alias("n")).collect())
    known = F.broadcast(spark.createDataFrame(before, "part long, dim int, before long"))
    own = Window.partitionBy("part", "dim").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.col("before") + F.coalesce(F.sum("n").over(own), F.lit(0))
    found = (
        ordered.withColumn("part", F.shiftright("at", 33)).join(known, ["part", "dim"]).withColumn("smaller", smaller)
        .withColumn("coordinate", F.expr(f"(smaller * {levels}) div {max(1, n)}")).groupBy("dim", "coordinate").agg(F.min_by(F.struct("s", "x"), "at").alias("first")).collect()
    )
    out: list[list[tuple[int, str | int | None]]] = [[] for _ in DIMENSIONS]
    for r in sorted(found, key=lambda r: r["coordinate"]):
        out[r["dim"]].append((r["coordinate"], r["first"]["x"] if r["first"]["s"] is None else r["first"]["s"]))
    return out


def _coordinate(name: str, firsts: list[tuple[int, str | int | None]]) -> Column:
    out = F.lit(0)
    for k, first in firsts:
        if first is not None:  # nulls are the least value, whose coordinate is 0
            out = F.when(F.col(name) >= F.lit(first), F.lit(k)).otherwise(out)
    return out.cast("long")


def interleaved(bits: int, names: list[str]) -> Column:
    """Binary digits of the coordinates, highest first, each round from the last name to the first."""
    out = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in reversed(names):
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(F.col(c), b).bitwiseAND(F.lit(1).cast("long")))
    return out


def place(docs: DataFrame, *, file_rows: int = 2000, bits: int = 3) -> DataFrame:
    """(doc_id, row, source_at, lang_at, length_at, date_at, z, position, file) of every row of docs; docs has a column ``row``."""
    spark, names = docs.sparkSession, [f"{c}_at" for c in DIMENSIONS]
    rows = scratch.stash(values(docs), "values")
    firsts = _first_values(rows, 1 << bits)
    cells = rows.select("doc_id", "row", *(_coordinate(c, f).alias(f"{c}_at") for c, f in zip(DIMENSIONS, firsts, strict=True))).withColumn("z", interleaved(bits, names))
    cells = cells.withColumn("tie", F.xxhash64("row"))  # a short key, as the ranges' sample goes to the driver; it parts rows of one doc_id
    order = [F.asc("z"), F.asc_nulls_first("doc_id"), F.asc("tie")]
    ordered = scratch.stash(cells.repartitionByRange(*order).sortWithinPartitions(*order, "row").withColumn("at", F.monotonically_increasing_id()), "ordered")
    known = F.broadcast(spark.createDataFrame(_before(ordered, amount=F.lit(1)), "part long, before long"))
    placed = ordered.withColumn("part", F.shiftright("at", 33)).join(known, "part")
    placed = placed.withColumn("position", F.col("before") + F.col("at").bitwiseAND(F.lit(_LOW)))
    return placed.select("doc_id", "row", *names, "z", "position", F.expr(f"position div {file_rows}").alias("file"))


def _boxes(held: DataFrame) -> DataFrame:
    return held.groupBy("file").agg(*(f(f"{c}_at").alias(f"{c}_{k}") for c in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max))))


def touched(boxes: DataFrame, *, bits: int = 3) -> np.ndarray:
    """For every cell (source, lang, length, date) the number of boxes that meet its query."""
    top = (1 << bits) - 1
    ends = [(F.greatest(F.col(f"{c}_lo") - reach, F.lit(0)), F.least(F.col(f"{c}_hi") + reach, F.lit(top)) + 1) for c, reach in DIMENSIONS.items()]
    corners = [F.struct(*(ends[i][k].alias(f"c{i}") for i, k in enumerate(which)), F.lit((-1) ** sum(which)).alias("sign")) for which in product((0, 1), repeat=len(ends))]
    sums = boxes.select(F.inline(F.array(*corners))).groupBy("c0", "c1", "c2", "c3").agg(F.sum("sign").alias("n")).collect()
    grid = np.zeros((top + 2,) * len(ends), np.int64)
    for *at, n in sums:
        grid[tuple(at)] = n
    for axis in range(grid.ndim):
        grid = np.cumsum(grid, axis=axis)
    return grid[(slice(0, top + 1),) * grid.ndim]


def matching(held: DataFrame, *, bits: int = 3) -> DataFrame:
    """(source_at, lang_at, length_at, date_at, files_matching): files with a row inside a cell's query. held: distinct (file, cell)."""
    top = (1 << bits) - 1
    steps = list(product(*(range(-reach, reach + 1) for reach in DIMENSIONS.values())))
    near = [F.struct(*((F.col(f"{c}_at") + d).alias(f"{c}_at") for c, d in zip(DIMENSIONS, step, strict=True))) for step in steps]
    inside = " and ".join(f"{c}_at between 0 and {top}" for c in DIMENSIONS)
    names = [f"{c}_at" for c in DIMENSIONS]
    return held.select("file", F.inline(F.array(*near))).filter(inside).distinct().groupBy(*names).agg(F.count("*").alias("files_matching"))


def with_query_costs(placed: DataFrame, *, bits: int = 3) -> DataFrame:
    """placed with files_touched, files_matching and file_bounds."""
    spark, names = placed.sparkSession, [f"{c}_at" for c in DIMENSIONS]
    placed = scratch.stash(placed, "placed")
    held = scratch.stash(placed.select("file", *names).distinct(), "held")
    grid = touched(_boxes(held), bits=bits)
    cells = spark.createDataFrame([(*map(int, at), int(n)) for at, n in np.ndenumerate(grid)], ", ".join(f"{c} long" for c in [*names, "files_touched"]))
    costs = F.broadcast(cells.join(matching(held, bits=bits), names))  # at most 16 ** bits rows; a cell with a row matches its own file
    one = Window.partitionBy("file")  # of file_rows rows
    bounds = F.concat_ws(",", *(f(c).over(one) for c in names for f in (F.min, F.max)))
    return placed.withColumn("file_bounds", bounds).join(costs, names)


def report(docs: DataFrame, *, file_rows: int = 2000, bits: int = 3) -> DataFrame:
    """(doc_id, z, position, file, files_touched, files_matching, file_bounds) of every row of docs."""
    placed = place(scratch.numbered(docs.select("doc_id", "text", "source", "lang"), "row"), file_rows=file_rows, bits=bits)
    return with_query_costs(placed, bits=bits).select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


def write(docs: DataFrame, folder: str, *, file_rows: int = 2000, bits: int = 3) -> DataFrame:
    """Write docs clustered, one Parquet file for each file number, and a manifest of boxes; returns the manifest.

    folder: a new path that all executors share.
    """
    row, of, file, position = scratch.unused(docs, "row", "of", "file", "position")
    docs, columns = scratch.numbered(docs, row), scratch.named(docs)
    own = docs.select("doc_id", "text", "source", "lang", F.col(row).alias("row"))
    placed = scratch.stash(place(own, file_rows=file_rows, bits=bits), "placed")
    where = placed.select(F.col("row").alias(of), F.col("file").alias(file), F.col("position").alias(position))
    moved = docs.join(where, F.col(row) == F.col(of)).select(*columns, file, position)
    moved.repartition(F.col(file)).sortWithinPartitions(file, position).drop(position).write.partitionBy(file).parquet(f"{folder}/rows")
    _boxes(placed).join(placed.groupBy("file").agg(F.count("*").alias("rows")), "file").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read(spark, folder: str, **ranges: tuple[int, int]) -> DataFrame:
    """Rows of the files whose boxes meet the given coordinate ranges (by dimension, ends included); others are not opened."""
    wanted = spark.read.parquet(f"{folder}/manifest")
    for c, (lo, hi) in ranges.items():
        wanted = wanted.filter((F.col(f"{c}_lo") <= hi) & (F.col(f"{c}_hi") >= lo))
    rows = spark.read.parquet(f"{folder}/rows")
    file = rows.columns[-1]
    return rows.join(wanted.select(F.col("file").alias(file)), file, "left_semi").drop(file)
