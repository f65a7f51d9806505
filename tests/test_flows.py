"""The paged source against a server that counts its requests, and stateful histories against windows."""

from __future__ import annotations

import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from orderloom.operators.lineage import landing
from orderloom.sources import paged
from orderloom.streaming import events as streams
from orderloom.streaming import histories

SCHEMA = "k long, name string, x double"


@pytest.fixture
def server():
    """Rows by order and range; every fifth request fails; ``asked`` lists the ranges that were answered."""
    rows, asked, n, lock = [], [], [0], threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            order = parse_qs(urlparse(self.path).query)["order"][0]
            start, last = map(int, self.headers["Range"].split("-"))
            with lock:
                n[0] += 1
                fails = n[0] % 5 == 0
                if not fails:
                    asked.append((start, last))
            if fails:
                self.send_error(503)
                return
            body = json.dumps(sorted(rows, key=lambda r: r[order])[start : min(last + 1, self.server.most)]).encode()
            self.send_response(206)
            self.send_header("Content-Range", f"{start}-{last}/{len(rows)}")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.most = 1 << 60
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/t?select=*", rows, asked, s
    s.shutdown()


def rows_of(lo, hi):
    return [{"k": i, "name": None if i % 7 == 0 else f"n{i}é", "x": i / 2} for i in range(lo, hi)]


def test_pages_of_a_server_in_batch(spark, server):
    url, rows, asked, s = server
    rows += rows_of(0, 95)[::-1]
    paged.register(spark)
    df = spark.read.format("paged").schema(SCHEMA).options(url=url, order="k", page=10, pages=3).load()
    assert sorted(map(tuple, df.collect())) == [tuple(r.values()) for r in rows_of(0, 95)]
    assert df.rdd.getNumPartitions() == 4
    pages = [r for r in asked if r != (0, 0)]
    assert set(pages) == {(i, min(i + 9, 94)) for i in range(0, 95, 10)}
    s.most = 40  # from here on the server gives less than it says
    with pytest.raises(Exception, match="0 rows at"):
        df.collect()


def test_a_stream_goes_on_and_asks_for_nothing_twice(spark, server):
    url, rows, asked, _ = server
    paged.register(spark)
    out, mark = landing(spark, "out"), landing(spark, "mark")

    def take():
        del asked[:]
        s = spark.readStream.format("paged").schema(SCHEMA).options(url=url, order="k", page=10, pages=2).load()
        n = streams.drain(s, out, mark).count()
        return n, sorted(r for r in asked if r != (0, 0))

    rows += rows_of(0, 25)
    assert take() == (25, [(0, 9), (10, 19), (20, 24)])
    assert take() == (25, [])
    rows += rows_of(25, 52)
    assert take() == (52, [(25, 29), (30, 39), (40, 49), (50, 51)])
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(52))


def test_published_pages(spark):
    folder = landing(spark, "pages")
    df = spark.createDataFrame([(i * 7 % 101, None if i % 5 == 0 else f"n\n{i}", i / 3) for i in range(101)], SCHEMA).repartition(4)
    paged.publish(df.filter("k < 40"), folder, ["k"], page=20)
    paged.publish(df.filter("k >= 40"), folder, ["k"], page=20, first=40)
    store = paged.FolderStore(folder, 20)
    assert store.count() == 101 and [r["k"] for r in store.rows(15, 47)] == list(range(15, 47))
    paged.register(spark)
    back = spark.read.format("paged").schema(SCHEMA).options(url=folder, page=20, pages=2).load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="fill"):
        paged.publish(df, folder, ["k"], page=20, first=7)
    assert paged.FolderStore(f"{folder}-none", 20).count() == 0


def test_places_in_an_order(spark):
    df = spark.createDataFrame([(i * 31 % 500,) for i in range(500)], "k long").repartition(6)
    assert sorted((r["k"], r["at"]) for r in paged.placed(df, ["k"], 10).collect()) == [(i, i + 10) for i in range(500)]
    assert paged.placed(df.limit(0), ["k"]).count() == 0


def test_streamed_histories_are_those_of_windows(spark):
    histories.keeps_state(spark)
    hour = 3_600_000_000
    rows = [(i, i % 5 if i % 11 else None, f"k{i % 3}", 24 * hour + (i * 37 % 200) * hour // 3 + i % 2, float(i % 13) if i % 6 else None) for i in range(240)]
    e = spark.createDataFrame(rows, "id long, entity long, kind string, us long, value double").select("id", "entity", "kind", F.timestamp_micros("us").alias("ts"), "value")
    path, out, mark = landing(spark, "events"), landing(spark, "out"), landing(spark, "mark")
    cut = F.timestamp_micros(F.lit(54 * hour) + (F.col("id") % 6) * hour)  # the second landing holds events up to five hours before some of the first
    for part in (F.col("ts") < cut, F.col("ts") >= cut):
        e.filter(part).write.mode("append").parquet(path)
        s = spark.readStream.schema("id long, entity long, kind string, ts timestamp, value double").parquet(path)
        got = streams.drain(histories.with_history(s, late="6 hours", last=3), out, mark)
    passed = e.agg(F.date_trunc("millisecond", F.max("ts"))).first()[0]  # the watermark counts in milliseconds
    want = histories.batch(e, last=3).filter(F.col("ts") <= F.lit(passed) - F.expr("interval 6 hours"))
    told = lambda d: sorted(tuple((x is not None, round(x, 9) if isinstance(x, float) else x) for x in r) for r in d.select(*histories.COLUMNS).collect())
    assert told(got) == told(want) and got.count() > 150


def test_files_and_tasks_do_not_grow_with_pages(spark, monkeypatch):
    folder = landing(spark, "pages")
    df = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n "), "id").alias("name"), (F.col("id") / 4).alias("x"))
    paged.publish(df.filter("k < 700"), folder, ["k"], page=5)
    paged.publish(df.filter("k >= 700"), folder, ["k"], page=5, first=700)
    store = paged.FolderStore(folder, 5)
    assert store.count() == 1000 and len(store._folders()) == 13  # of 200 pages
    reading = paged.PagedReader(df.schema, {"url": folder, "page": "5", "pages": "2"})
    monkeypatch.setattr(paged, "MOST_TASKS", 7)
    spans = reading.partitions()
    assert len(spans) <= 7 and [p.start for p in spans[1:]] == [p.stop for p in spans[:-1]] and all(p.start % 5 == 0 for p in spans)
    assert [r for p in spans for r in reading.read(p)] == [(i, f"n {i}", i / 4) for i in range(1000)]


class _Store:
    """State of one key in memory, which counts its calls."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, []

    def getListState(self, name, schema):
        return _Named(self, name)

    getValueState = getListState

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


class _Named:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _at(self):
        self.store.calls += 1
        return self.store.held

    def appendList(self, rows):
        self._at().setdefault(self.name, []).extend(rows)

    def put(self, rows):
        self._at()[self.name] = list(rows)

    update = put

    def get(self):
        return self._at().get(self.name, [])

    def exists(self):
        return self.name in self._at()

    def clear(self):
        self._at().pop(self.name, None)


def test_a_shard_of_many_entities_makes_few_calls(spark):
    """Calls to the state depend on batches alone, and rows are those of windows: kinds and values may be missing, an entity may be hot."""
    us = lambda i: 86_400_000_000 + (i * 7919 % 4000) * 1_000_000
    rows = [(i, 0 if i % 3 == 0 else i % 401, None if i % 5 == 0 else f"k{i % 4}", us(i), float(i % 13) / 7 if i % 6 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, entity long, kind string, us long, value double").toPandas()
    store = _Store()
    h = histories.History(4)
    h.init(store)
    got = []
    for low, high, mark in ((0, 1000, 900), (1000, 4000, 4000)):
        new, store.mark = frame[(frame.us >= us(0) + low * 1_000_000) & (frame.us < us(0) + high * 1_000_000)], (us(0) + mark * 1_000_000) // 1000
        list(h.handleInputRows((0,), iter([new[:100], new[100:]]), store))
        store.timers.clear()
        for made in h.handleExpiredTimer((0,), store, None):
            got += made.astype(object).where(made.notna(), None)[histories.COLUMNS].values.tolist()
    assert store.calls < 30
    want = histories.batch(spark.createDataFrame(rows, "id long, entity long, kind string, us long, value double").withColumn("ts", F.timestamp_micros("us")), last=4)
    told = lambda d: sorted(tuple((x is not None, round(x, 9) if isinstance(x, float) else str(x)) for x in r) for r in d)
    assert told(got) == told([tuple(r) for r in want.select(*histories.COLUMNS).collect()]) and len(got) == 3000
