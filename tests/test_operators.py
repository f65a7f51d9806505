"""Recipes on small fixtures: ties, gaps, zero divisors, single rows, cutoffs."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderloom.functions import keys, nulls, numbers
from orderloom.operators import dedup, guards, labels, models, pit, rules, sampling, stats, windows
from orderloom.plans import relational
from orderloom.sources import html, readers, sinks
from orderloom.streaming import events


def test_rank_ties(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("a", 5.0), ("b", 3.0), ("b", 3.0), ("b", 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, x double")
    got = [r[0] for r in df.select("i", windows.pct_rank("x", ["g"]).alias("p")).orderBy("i").select("p").collect()]
    want = pd.DataFrame(rows, columns=["g", "x"]).groupby("g")["x"].rank(pct=True).tolist()
    assert [(a is None and math.isnan(b)) or a == pytest.approx(b) for a, b in zip(got, want, strict=True)] == [True] * 8


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1.0, "3.5"), (float("nan"), 0.0, ""), (None, 2.0, "NA")], "x double, d double, c string")
    r = df.agg(F.avg(nulls.nn("x")), F.count(nulls.nn("x"))).first()
    assert tuple(r) == (1.0, 1)
    assert [x[0] for x in df.select(nulls.sdiv("x", "d")).collect()][2] is None
    assert [x[0] for x in df.select(nulls.sdiv(F.lit(1.0), "d")).collect()] == [1.0, None, 0.5]
    assert [x[0] for x in df.select(nulls.patch("d", "c")).collect()] == [3.5, 0.0, None]
    assert df.select(nulls.clip("x", 0, 10)).collect()[2][0] is None
    assert df.select(nulls.row_mean("x", "d"), nulls.row_median("x", "d"), nulls.row_count("x", "d"), nulls.row_std("x", "d")).collect()[2] == (2.0, 2.0, 1, None)


def test_constant_and_single_row_cohorts(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 5.0, 1.0), ("b", 5.0, 3.0)], "g string, x double, y double")
    assert [r[0] for r in df.select(windows.zscore("x", ["g"])).collect()] == [None, None, None]
    assert [r[0] for r in df.filter("g = 'b'").select(windows.zscore("x", ["g"], guard=True)).collect()] == [0.0, 0.0]
    assert all(r["rho"] is None or math.isnan(r["rho"]) for r in stats.spearman(df, "x", "y", ["g"]).collect())


def test_as_of_never_sees_later_rows(spark):
    left = spark.createDataFrame([("k", datetime(2024, 1, 31))], "key string, at timestamp")
    right = spark.createDataFrame([("k", datetime(2024, 1, 5), 1), ("k", datetime(2024, 1, 29), 2), ("k", datetime(2024, 2, 1), 3)], "key string, ts timestamp, v int")
    assert pit.as_of(left, right, "key", "at", "ts", "20 days", "v").first()["r_v"] == 2
    assert pit.as_of(left, right.filter("v <> 2"), "key", "at", "ts", "20 days", "v").first()["r_v"] is None


def test_first_periods_skip_gaps(spark):
    df = spark.createDataFrame([("p", 2001, 1.0), ("p", 2003, 2.0), ("p", 2004, 4.0), ("p", 2009, 8.0)], "e string, y int, v double")
    assert pit.first_periods(df, ["e"], "y", "v", 3).first()["total"] == 7.0
    assert pit.first_periods(df, ["e"], "y", "v", 3, through=2003).first()["total"] == 3.0


def test_global_rank_is_the_average_rank_of_all_rows(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 9.0, 9.0, 9.0, -4.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = pd.Series(values).rank()
    for parts in (1, 3, 64):
        got = {r["x"]: r["rank"] for r in stats.global_rank(df, "x", parts).collect()}
        assert got == {v: r for v, r in zip(values, want, strict=True) if v is not None}
    assert stats.global_rank(df.filter("x > 100"), "x").count() == 0


def test_report_texts(spark):
    df = spark.createDataFrame([(1.25, "a poor man's Ann Lee (raw) / Bo"), (None, "Ann and Bo"), (-2.0, None)], "x double, c string")
    assert [r[0] for r in df.select(keys.signed("x")).collect()][1:] == ["—", "-2.0"]
    assert [r[0] for r in df.select(keys.comparison("c")).collect()] == ["Ann Lee", "Ann", None]


def test_islands(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate("AABC")], "y int, t string").withColumn("e", F.lit("p"))
    assert [r["island"] for r in windows.islands(df, "t", ["e"], F.col("y")).orderBy("y").collect()] == [0, 0, 1, 2]


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(numbers.norm_ppf("p")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


def test_prices(spark):
    df = spark.createDataFrame([(-110.0, -110.0), (-110.0, 100.0), (150.0, None)], "a double, b double")
    got = [r[0] for r in df.select(numbers.fair(numbers.price_probability("a"), numbers.price_probability("b"))).collect()]
    assert got == pytest.approx([0.5, 0.511628, 0.4], abs=1e-6)


def test_names(spark):
    df = spark.createDataFrame([("José Núñez Jr.",), ("Smith, John",)], "n string")
    assert [r[0] for r in df.select(keys.norm_key("n")).collect()] == ["josenunez", "smithjohn"]
    assert df.select(keys.flip_name("n")).collect()[1][0] == "John Smith"


def test_rule_language(spark):
    assert rules.parse("max(rank(a),blend(b:0.5,c:1))").name == "max"
    for bad in ("", "a(", "blend(a:", "1", "a b", "a(b,)"):
        with pytest.raises(ValueError):
            rules.parse(bad)
    df = spark.createDataFrame([(1, 1.0, 4.0), (1, 2.0, 3.0), (1, 3.0, None)], "g int, a double, b double")
    got = rules.apply(df, {"s": "stack(1:a,1:b)"}, ["g"]).orderBy("a").collect()
    assert [r["s"] for r in got] == pytest.approx([1 / 3 + 1, 2 / 3 + 0.5, 1.5])
    with pytest.raises(ValueError):
        rules.apply(df, {"s": "nothing(a)"}, ["g"])


def test_guards(spark):
    with pytest.raises(guards.GuardError):
        guards.ban_columns(["y_war", "age"])
    with pytest.raises(guards.GuardError):
        models.fit_ridge(spark.createDataFrame([(1.0, 2.0)], "y_x double, l double"), ["y_x"], "l")
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 3, 1))], "k int, ts timestamp")
    cutoff = F.lit("2024-02-01").cast("timestamp")
    assert guards.captured_before(df.filter("k = 1"), "ts", cutoff).count() == 1
    with pytest.raises(Exception, match="later than the cutoff"):
        guards.captured_before(df, "ts", cutoff).collect()
    assert tuple(guards.uniqueness(spark.createDataFrame([(1,), (1,), (None,)], "k int"), ["k"]).first()) == (3, 2, 1)
    with pytest.raises(ValueError):
        sinks.with_dictionary(df, {"k": "key"})


def test_causal_scores_do_not_change_with_the_future(spark):
    rows = [(y, float(i), float(i * 2 + y % 3)) for y in range(2000, 2005) for i in range(20)]
    df = spark.createDataFrame(rows, "y int, x double, v double")
    changed = df.withColumn("v", F.when(F.col("y") >= 2003, -F.col("v")).otherwise(F.col("v")))
    a, b = ({(r["y"], r["x"]): r["score"] for r in models.causal_scores(d, ["x"], "v", "y").collect()} for d in (df, changed))
    assert all(a[k] == b[k] for k in a if k[0] <= 2003)
    assert all(a[k] is None for k in a if k[0] == 2000)


def test_resampling_is_seeded(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i % 7)) for i in range(50)], "g int, k int, x double, y double")
    a, b = (sampling.bootstrap(df, "g", "k", "x", "y", 5, seed=3).orderBy("replicate").collect() for _ in range(2))
    assert a == b and len(a) == 5
    shuffled = sampling.permuted(df, ["g"], "k", "x")
    assert sorted(r["x"] for r in shuffled.collect()) == sorted(r["x"] for r in df.collect())


def test_horizon_policies():
    assert [labels.horizon(p, 2) for p in ("full", "match", "match3", "short3", "4")] == [5, 2, 3, 3, 4]
    with pytest.raises(ValueError):
        labels.horizon("none", 2)


def test_merge_and_unambiguous(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("a", 2, 7, 6)], "k string, o int, x int, y int")
    assert tuple(dedup.merge_records(df, ["k"], F.col("o"), ["x", "y"]).first()) == ("a", 7, 5)
    pairs = spark.createDataFrame([(1, 1), (2, 2), (2, 3)], "l int, r int")
    assert [tuple(r) for r in dedup.unambiguous(pairs, "l", "r").collect()] == [(1, 1)]


def test_polyfit(spark):
    df = spark.createDataFrame([(float(i), 1 + 2.0 * i - i * i, 1.0 + i) for i in range(6)], "x double, y double, w double")
    c, sd = stats.polyfit(df, "x", "y", 2, "w")
    assert c == pytest.approx([1, 2, -1], abs=1e-8) and sd == pytest.approx(0, abs=1e-5)


def test_html(spark):
    page = "<title> A &amp; B </title><!--<table>--><tr><td>1</td><th>x &lt; y</th></tr><script>no</script><p>Hi <b>you</b></p><a class=l href=\"u\">z</a>"
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(html.title(F.col("h")), html.rows(F.col("h")), html.links(F.col("h")), html.visible_text(F.col("h"))).first()
    assert r[0] == "A &amp; B" and r[1] == [["1", "x < y"]] and r[2] == ["u"]
    assert "no" not in r[3].split("\n") and "Hi you" in r[3].split("\n")


def test_readers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, float("nan"))], "k int, x double")
    sinks.overwrite(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("x is null").count() == 1
    sinks.append_partitions(df, str(tmp_path / "q"), "k")
    assert spark.read.parquet(str(tmp_path / "q")).filter("k = 1").count() == 1
    (tmp_path / "d_2019.csv").write_text("a,b\n1,\n2,NA\n")
    (tmp_path / "d_2020.csv").write_text("a,b\n3,x\n")
    cells = readers.csv_cells(spark, str(tmp_path / "d_2019.csv"), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in cells] == [("1", ""), ("2", "NA")]
    years = spark.read.schema("a int, b string")
    assert years.csv(str(tmp_path / "d_20*.csv"), header=True).count() == 3
    got = readers.sharded(spark, str(tmp_path / "d_20*.csv"), r"d_(\d{4})\.csv", "csv", "a string, b string")
    assert {r["file_year"] for r in got.collect()} == {2019, 2020}
    (tmp_path / "l.jsonl").write_text('{"k": 1}\nnot json\n{"k": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), "k int").count() == 2
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "c binary")
    assert [r[0] for r in raw.select(readers.decoded(F.col("c"))).collect()] == ["é", "é"]


def test_streams(spark, sf_dir, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in/events.parquet")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).schema
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "ts"))
    stream = events.read_events(spark, str(tmp_path / "ts"), schema, "2024-01-20")
    out = events.drain(events.distinct_events(stream, "event_id", "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert out.count() == batch.filter("ts < '2024-01-20'").count()
    tumbling = events.tumbling(events.read_events(spark, str(tmp_path / "ts"), schema), "1 day", "0 seconds", ["event_type"])
    closed = events.drain(tumbling, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert 0 < closed.count() <= batch.select(F.to_date("ts"), "event_type").distinct().count()


def test_plans_prune_and_stay_native(spark, sf_dir):
    from orderloom.plans.relational import scan_prune_pushdown

    plan = scan_prune_pushdown(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_comment" not in plan and "Python" not in plan


def test_entry_and_queries_without_llm(spark, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_optional", lambda name: None)
    assert e.entry(spark).count() == 7
    assert not any(q.startswith("op") and q[2].isdigit() for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_header_documents_hold_all_events_and_stay_small(spark, monkeypatch, tmp_path):
    e = spark.range(20_500).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.lit("view").alias("event_type"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    read, seen = readers.header_rows, []
    monkeypatch.setattr(readers, "header_rows", lambda doc, wanted: seen.append(doc) or F.array(F.struct((50 * F.size(F.from_json(F.get_json_object(doc, "$.rowSet"), "array<array<string>>"))).cast("long").alias("event_id"))))
    sizes = [r["event_id"] // 50 for r in relational.header_rowset_zip(spark, str(tmp_path)).collect()]
    assert seen and sum(sizes) == 20_500 and max(sizes) <= 1000
    monkeypatch.setattr(readers, "header_rows", read)
    assert sorted(r["event_id"] for r in relational.header_rowset_zip(spark, str(tmp_path)).collect()) == list(range(20_500))


def test_knn_scans_any_number_of_training_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_600, 4)).round(1)  # many equal vectors and distances
    rows = [(i, v, i % 3) for i, v in enumerate(x.tolist())] + [(30_000, None, 1), (30_001, [1.0], 1), (30_002, [None] * 4, 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(3)
    for how in ({}, {"tile": 700, "block": 9}):
        got = {r["id"]: r["score"] for r in models.knn(df, df.filter("id % 1000 = 0"), "v", "y", "id", **how).collect()}
        assert set(got) == set(range(0, 20_600, 1000))
        for i in got:
            d = np.sqrt(((x - x[i]) ** 2).cumsum(axis=1)[:, -1])
            near = [j for j in np.argsort(d, kind="stable") if j != i][:5]
            w = 1 / (d[near] + 1e-9)
            assert got[i] == pytest.approx(float((w * (np.array(near) % 3)).sum() / w.sum()))
