"""Tables that are given out page by page, as a Spark data source in batch and in streams.

A store holds rows in a fixed order and answers two questions: how many rows there are, and which
stand at ``start .. stop``. Two kinds: a folder of pages that ``publish`` wrote, and an HTTP endpoint
with order and range paging (``order`` as a parameter, ``Range: start-last``, a total behind the slash
of ``Content-Range``), as REST front ends of databases have it.

Batch: the count is asked once, rows are dealt to tasks as ranges of pages, each task asks for its
own pages. Streams: an offset is how many rows have been seen, kept in the query's checkpoint, so a
stopped stream goes on behind the last row it gave out and asks for no page twice but the one it
stopped in. A store that gives fewer rows than it said fails loudly, a failing request is tried
again (a read is idempotent), and nothing is given out twice: Spark commits an offset with its rows.

    paged.register(spark)
    spark.read.format("paged").schema("id long, name string").option("url", url).option("order", "id").load()
"""

from __future__ import annotations

import bisect
import json
import sys
import time
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlencode, urlparse

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers that plan and read need no path to this package

TRIES = 5


#: Pages of a file, and tasks of a read above which a task takes more pages.
FILE_PAGES = 16
MOST_TASKS = 64


class FolderStore:
    """Pages that ``publish`` wrote: ``pages=N`` folders of JSON lines with FILE_PAGES pages each; the last one may be short, and have files of several writes."""

    def __init__(self, url: str, page: int):
        from pyarrow import fs

        self.page, self.size = page, page * FILE_PAGES
        self.fs, self.path = fs.FileSystem.from_uri(url) if urlparse(url).scheme else (fs.LocalFileSystem(), url)
        self.held: tuple[int, list[dict]] = (-1, [])

    def _folders(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(int(f.base_name.removeprefix("pages=")) for f in found if f.base_name.startswith("pages="))

    def _read(self, number: int) -> list[dict]:
        from pyarrow import fs

        out: list[dict] = []
        for f in self.fs.get_file_info(fs.FileSelector(f"{self.path}/pages={number}")):
            if not f.base_name.startswith(("_", ".")):
                with self.fs.open_input_file(f.path) as x:
                    out += [json.loads(line) for line in x.read().decode().split("\n") if line]
        return sorted(out, key=lambda r: r["_at"])

    def count(self) -> int:
        folders = self._folders()
        whole = next((i for i, n in enumerate(folders) if i != n), len(folders))  # folders behind a gap have not landed yet
        return 0 if not whole else (whole - 1) * self.size + len(self._read(whole - 1))

    def rows(self, start: int, stop: int) -> list[dict]:
        out: list[dict] = []
        for n in range(start // self.size, -(-stop // self.size)):
            if self.held[0] != n:
                self.held = (n, self._read(n))  # a task asks for its pages in order, so a file is read once
            have = self.held[1]
            low, high = (bisect.bisect_left(have, at, key=lambda r: r["_at"]) for at in (start, stop))
            out += have[low:high]
        return out


class HttpStore:
    def __init__(self, url: str, order: str):
        self.url = f"{url}{'&' if '?' in url else '?'}{urlencode({'order': order})}"

    def _get(self, start: int, last: int) -> tuple[list[dict], int]:
        for k in range(TRIES):
            try:
                ask = urllib.request.Request(self.url, headers={"Range-Unit": "items", "Range": f"{start}-{last}", "Prefer": "count=exact"})
                with urllib.request.urlopen(ask, timeout=60) as got:
                    return json.loads(got.read() or b"[]"), int(got.headers["Content-Range"].rpartition("/")[2])
            except OSError:
                if k == TRIES - 1:
                    raise
                time.sleep(0.1 * 2**k)
        raise AssertionError

    def count(self) -> int:
        return self._get(0, 0)[1]

    def rows(self, start: int, stop: int) -> list[dict]:
        return self._get(start, stop - 1)[0]


def store_of(options: dict[str, str]):
    url, page = options["url"], int(options.get("page", 1000))
    return HttpStore(url, options["order"]) if url.startswith(("http://", "https://")) else FolderStore(url, page)


class Span(InputPartition):
    """Rows start .. stop of a store."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reading:
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        self.page, self.each = int(options.get("page", 1000)), int(options.get("pages", 16))

    def spans(self, start: int, stop: int) -> list[Span]:
        """Ranges of whole pages (but for the ends), so many pages to a task, or more of them where there would be over MOST_TASKS tasks."""
        more = -(-(stop - start) // (self.page * self.each * MOST_TASKS))
        pages = self.each if more <= 1 else -(-self.each * more // FILE_PAGES) * FILE_PAGES  # whole files, so that each is read by one task
        size, out = self.page * pages, []
        while start < stop:
            end = min(stop, (start // size + 1) * size)
            out.append(Span(start, end))
            start = end
        return out or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        store, names = store_of(self.options), self.schema.fieldNames()
        at = partition.start
        while at < partition.stop:
            end = min(partition.stop, (at // self.page + 1) * self.page)
            rows = store.rows(at, end)
            if len(rows) != end - at:
                raise RuntimeError(f"{self.options['url']}: {len(rows)} rows at {at} .. {end}")
            for r in rows:
                yield tuple(r.get(c) for c in names)
            at = end


class PagedReader(_Reading, DataSourceReader):
    def partitions(self):
        return self.spans(0, store_of(self.options).count())


class PagedStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": store_of(self.options).count()}

    def partitions(self, start: dict, end: dict):
        return self.spans(start["rows"], end["rows"])

    def commit(self, end: dict) -> None:
        pass


class Paged(DataSource):
    """Options: url, order (HTTP), page (rows of a page), pages (of a task, at least)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Paged)


def placed(df: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """df with ``at``, its row's place in an order from ``first`` on: rows are ranged by the order, so no task sees all, and the driver adds up one count for each range."""
    from orderloom.operators.lineage import cut

    low = (1 << 33) - 1  # a row's number in its range
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], first
    for p, n in sizes:
        starts.append((p, total))
        total += n
    known = df.sparkSession.createDataFrame(starts, "_p long, _s long")
    return ranged.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(known), "_p").withColumn("at", F.col("_s") + F.col("_m").bitwiseAND(F.lit(low))).drop("_p", "_s", "_m")


def publish(df: DataFrame, folder: str, order: list[str], *, page: int = 1000, first: int = 0) -> None:
    """Write df, ordered, as pages behind the first ``first`` rows, which fill their pages."""
    if first % page:
        raise ValueError("the rows before must fill their pages")
    rows = placed(df, order, first).withColumnRenamed("at", "_at")
    text = rows.select(F.expr(f"_at div {page * FILE_PAGES}").alias("pages"), F.to_json(F.struct(*rows.columns)).alias("value"))
    text.repartition("pages").write.mode("append").partitionBy("pages").text(folder)
