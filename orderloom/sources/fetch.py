"""Fetching of pages into a shared folder: each address once, politely, with what is missing remembered and what failed not."""

from __future__ import annotations

import hashlib
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators.lineage import ship

MISSING = (404, 410)


def _open(url: str) -> tuple[int, bytes]:
    request = urllib.request.Request(url, headers={"User-Agent": "orderloom"})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310  addresses are the caller's
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


class Store:
    """Files by the hash of their address, in a folder that all executors share (a path, or a URI that Arrow opens)."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file:") if folder.startswith(("/", "file:/")) else folder
        self.remote = "://" in self.folder
        if self.remote:
            from pyarrow import fs

            self.store, self.path = fs.FileSystem.from_uri(self.folder)
        else:
            os.makedirs(self.folder, exist_ok=True)

    def name(self, url: str, missing: bool = False) -> str:
        return hashlib.sha256(url.encode()).hexdigest() + (".missing" if missing else ".page")

    def has(self, name: str) -> bool:
        if self.remote:
            return self.store.get_file_info(f"{self.path}/{name}").is_file
        return os.path.exists(f"{self.folder}/{name}")

    def size(self, name: str) -> int:
        return self.store.get_file_info(f"{self.path}/{name}").size if self.remote else os.path.getsize(f"{self.folder}/{name}")

    def put(self, name: str, data: bytes) -> None:
        """Written beside its place, then renamed, so that a file that is there is whole."""
        hidden = f".{name}.{uuid.uuid4().hex}"
        if self.remote:
            self.store.create_dir(self.path, recursive=True)
            with self.store.open_output_stream(f"{self.path}/{hidden}") as f:
                f.write(data)
            self.store.move(f"{self.path}/{hidden}", f"{self.path}/{name}")
        else:
            with open(f"{self.folder}/{hidden}", "wb") as f:
                f.write(data)
            os.replace(f"{self.folder}/{hidden}", f"{self.folder}/{name}")


def fetch(urls: DataFrame, column: str, folder: str, *, tries: int = 3, pause: float = 1.0, get: Callable[[str], tuple[int, bytes]] = _open) -> DataFrame:
    """(url, state, file, bytes) of every distinct address; state is cached, fetched, missing or failed.

    A host's addresses are one task's, which waits between requests, so no host is asked by two at once.
    An address that is in the folder is not asked again, nor one that was found missing; one that failed
    after its tries is asked again the next time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            rows = [(url, *one(store, url)) for url in batch.column(0).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["url", "state", "file", "bytes"])

    def one(store: Store, url: str) -> tuple[str, str | None, int | None]:
        page, missing = store.name(url), store.name(url, True)
        if store.has(page):
            return "cached", page, store.size(page)
        if store.has(missing):
            return "missing", None, None
        for i in range(tries):
            time.sleep(pause * 2**i if i else pause)
            try:
                status, data = get(url)
            except (OSError, ValueError):
                continue
            if status in MISSING:
                store.put(missing, b"")
                return "missing", None, None
            if status == 200:
                store.put(page, data)
                return "fetched", page, len(data)
        return "failed", None, None

    ship(urls.sparkSession)
    own = urls.filter(F.col(column).isNotNull()).select(F.col(column).alias("url")).distinct()
    host = F.coalesce(F.nullif(F.regexp_extract("url", "://([^/]+)", 1), F.lit("")), F.col("url"))
    return own.withColumn("_host", host).repartition("_host").select("url").mapInArrow(work, "url string, state string, file string, bytes long")
