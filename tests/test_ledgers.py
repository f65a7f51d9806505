"""Segmented ledgers: every kind of tampering shows, and where."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderloom.operators import ledgers
from orderloom.operators.lineage import landing

COLUMNS = ["k", "name"]


@pytest.fixture(scope="module")
def ledger(spark):
    path = landing(spark, "ledger")
    df = spark.createDataFrame([(i * 37 % 700, None if i % 9 == 0 else f"n{i}") for i in range(700)], "k long, name string").repartition(5)
    ledgers.append(df.filter("k < 400"), path, ["k"], COLUMNS, segment=10)
    ledgers.append(df.filter("k < 0"), path, ["k"], COLUMNS, segment=10)
    ledgers.append(df.filter("k >= 400"), path, ["k"], COLUMNS, segment=10)
    return [ledgers.read(spark, path, kind).cache() for kind in ("lines", "heads", "roots")]


def found(lines, heads, roots):
    return {tuple(r) for r in ledgers.faults(lines, heads, roots, COLUMNS).collect()}


def test_a_whole_ledger_has_no_faults(ledger):
    lines, heads, roots = ledger
    assert found(*ledger) == set()
    assert (lines.count(), heads.count(), roots.count()) == (700, 70, 3)
    assert [tuple(r) for r in lines.filter("addition = 2 and at in (0, 299)").select("k", "segment").orderBy("k").collect()] == [(400, 0), (699, 29)]


def test_changes_of_lines_show(ledger):
    lines, heads, roots = ledger
    pick = (F.col("addition") == 0) & (F.col("at") == 123)
    assert found(lines.withColumn("name", F.when(pick, "other").otherwise(F.col("name"))), heads, roots) == {("line", 0, 12, 123), ("segment", 0, 12, None)}
    edited = lines.withColumn("name", F.when(pick, "other").otherwise(F.col("name")))
    assert found(edited.withColumn("line_hash", ledgers.line_hash(COLUMNS)), heads, roots) == {("segment", 0, 12, None)}  # with its hash made to fit
    assert found(lines.filter(~pick), heads, roots) == {("segment", 0, 12, None)}
    swapped = lines.withColumn("at", F.when(F.col("addition") == 0, F.when(F.col("at") == 123, 124).when(F.col("at") == 124, 123).otherwise(F.col("at"))).otherwise(F.col("at")))
    assert found(swapped, heads, roots) == {("line", 0, 12, 123), ("line", 0, 12, 124), ("segment", 0, 12, None)}
    twice = lines.unionByName(lines.filter(pick))
    assert found(twice, heads, roots) == {("segment", 0, 12, None)}


def test_changes_of_segments_and_roots_show(ledger):
    lines, heads, roots = ledger
    gone = (F.col("addition") == 2) & (F.col("segment") == 7)
    assert found(lines.filter(~gone), heads.filter(~gone), roots) == {("root", 2, None, None)}
    assert found(lines, heads.filter(~gone), roots) == {("segment", 2, 7, None), ("root", 2, None, None)}
    forged = heads.filter(~gone)
    fitting = roots.join(ledgers.tree_roots(forged).withColumnRenamed("root", "_r"), "addition", "left").withColumn("root", F.coalesce("_r", "root")).drop("_r")
    assert found(lines.filter(~gone), forged, fitting) == {("chain", 2, None, None)}
    assert found(lines.filter("addition <> 1"), heads, roots.filter("addition <> 1")) == {("chain", 2, None, None)}


def test_a_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(ledgers, "FAN", 3)
    heads = spark.createDataFrame([(0, i, 1, f"{i:064d}") for i in range(29)] + [(1, 0, 1, "x")], "addition long, segment long, n long, head string")
    a = {r["addition"]: r["root"] for r in ledgers.tree_roots(heads).collect()}
    b = {r["addition"]: r["root"] for r in ledgers.tree_roots(heads.withColumn("head", F.when(F.col("segment") == 28, "y").otherwise(F.col("head")))).collect()}
    assert len(a) == 2 and a[0] != b[0] and a[1] == b[1]
