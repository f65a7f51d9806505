"""Shared scratch tables, their release, and shipping of this package to executors.

Scratch tables go to the folder named by ``spark.checkpoint.dir``; a local temporary folder
is used only where that setting is absent and the master is local (laptops). Lazy results read
them, so they stay while the program runs and go when it ends; what is made inside ``owned`` goes
when the same owner begins again, and nothing else goes with it.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[tuple[str, str], list[str]] = {}  # by application and owner
_owner = [""]
_shipped: set[str] = set()
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI or path, without a trailing slash."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="orderloom-"))
    return _local[0]


def token() -> str:
    return uuid.uuid4().hex[:12]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered so that it can be deleted."""
    path = f"{shared_dir(spark)}/{name}-{token()}"
    key = spark.sparkContext.applicationId, _owner[-1]
    if key not in _made:
        _made[key] = []
        atexit.register(_release, spark, key)
    _made[key].append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = fresh(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def save_file(folder: str, name: str, data: bytes) -> str:
    """Write a file whole, then give it its name. folder: a path or URI that all executors share."""
    url = urlparse(folder)
    hidden = f".{name}.{uuid.uuid4().hex}"
    if url.scheme in ("", "file"):
        os.makedirs(url.path, exist_ok=True)
        with open(f"{url.path}/{hidden}", "wb") as f:
            f.write(data)
        os.replace(f"{url.path}/{hidden}", f"{url.path}/{name}")
    else:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{hidden}") as f:
            f.write(data)
        store.move(f"{path}/{hidden}", f"{path}/{name}")
    return name


def load_file(folder: str, name: str) -> bytes:
    """A file that ``save_file`` wrote; FileNotFoundError if it is gone."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        with open(f"{url.path}/{name}", "rb") as f:
            return f.read()
    store, path = _store(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores behind it as long as a column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame) -> list[Column]:
    """The columns of df by their names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def positional(df: DataFrame) -> DataFrame:
    """df with columns named by position: functions over Arrow batches are given columns by name, which names with dots break."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a row id that reading it again does not change: file and row number of a table in files.

    Anything else is written to the shared folder first.
    """
    try:
        return df.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return numbered(stash(df, "rows"), name)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live DataFrame refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _release(spark: SparkSession, key: tuple[str, str]) -> None:
    try:
        for path in _made.pop(key, []):
            drop(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the program: its folder is not ours to reach any more
        return


@contextlib.contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Scratch tables made inside belong to owner; those that it made before are deleted now, so their readers must be done."""
    _release(spark, (spark.sparkContext.applicationId, owner))
    sweep(spark)
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that workers need no shared Python path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="orderloom-ship-"), "orderloom_ship.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)
