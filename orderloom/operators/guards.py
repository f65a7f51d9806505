"""Guards against leaks and silent damage: each returns a small table or raises."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.nulls import corr


class GuardError(ValueError):
    """A guard that failed."""


def ban_columns(columns: list[str], prefixes: tuple[str, ...] = ("y_",), names: tuple[str, ...] = ()) -> None:
    if bad := [c for c in columns if c.startswith(prefixes) or c in names]:
        raise GuardError(f"outcome columns among the features: {bad}")


def free_text(df: DataFrame, allowed: tuple[str, ...]) -> None:
    if bad := [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in allowed]:
        raise GuardError(f"text columns would ship: {bad}")


def forward_only(train: DataFrame, test: DataFrame, period: str) -> DataFrame:
    """(last_train, first_test, ok)."""
    a, b = train.agg(F.max(period).alias("last_train")), test.agg(F.min(period).alias("first_test"))
    return a.join(b, F.lit(True)).withColumn("ok", F.col("last_train") < F.col("first_test"))


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, keys, nulls): equal rows and keys and no nulls in a sound table."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    each = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("nulls"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a digest that the order of rows does not change."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))), 1, 8), 16, 10).cast("long")).alias("digest"))


def chain(df: DataFrame, order: list[str], columns: list[str], genesis: str = "0" * 64) -> DataFrame:
    """df with the hash of each row's content and of the row before; order is total.

    A ledger is short (one line per evaluation) and its order is global.
    """
    line = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    return df.withColumn("line_hash", line).withColumn("prev_hash", F.coalesce(F.lag("line_hash").over(w), F.lit(genesis)))


def broken_links(df: DataFrame, order: list[str], columns: list[str], genesis: str = "0" * 64) -> DataFrame:
    """Rows of a chained table whose stored hashes do not follow from their content."""
    again = chain(df.withColumnsRenamed({"line_hash": "_line", "prev_hash": "_prev"}), order, columns, genesis)
    return again.filter((F.col("_line") != F.col("line_hash")) | (F.col("_prev") != F.col("prev_hash"))).drop("_line", "_prev")


def captured_before(df: DataFrame, ts: str, cutoff) -> DataFrame:
    """df; reading it fails at the first row that was captured after the cutoff."""
    return df.filter(F.when(F.col(ts) >= cutoff, F.raise_error(F.lit("a capture is later than the cutoff")).cast("boolean")).otherwise(True))


def collisions(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, overlap, rho, median_ratio, action) of same-named columns of two tables."""
    from orderloom.operators.selection import quantiles
    from orderloom.operators.windows import ranked

    ls = [F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("double").alias("x"), F.col(f"b.{c}").cast("double").alias("y")) for c in columns]
    # two whole sources: neither may pass through the driver to be sent to all tasks
    long = a.alias("a").join(b.hint("merge").alias("b"), key).select(F.explode(F.array(*ls)).alias("e")).select("e.*").filter("x is not null and y is not null")
    agg = ranked(long, ["column"], {"rx": "x", "ry": "y"}).groupBy("column").agg(F.count("*").alias("overlap"), corr("rx", "ry").alias("rho"))
    middle = quantiles(long, ["column"], F.try_divide("y", "x"), [0.5]).select(F.col("column").alias("_column"), F.col("q0").alias("median_ratio"))  # all rows stand under a few columns
    agg = agg.join(middle, F.col("column") == F.col("_column"), "left").drop("_column")
    same = (F.col("rho") > 0.98) & F.col("median_ratio").between(0.95, 1.05)
    return agg.withColumn("action", F.when(same, "merge").when(F.col("rho") > 0.9, "rescale").otherwise("keep apart"))


def blind(df: DataFrame, key: str, inputs: list[str]) -> tuple[DataFrame, list[str]]:
    """(the key and the declared inputs that are there, names of the outcome columns that were stripped)."""
    kept = [c for c in inputs if c in df.columns and c != key]
    ban_columns(kept)
    return df.select(key, *kept), [c for c in df.columns if c.startswith("y_")]


def blind_score(predictions: DataFrame, answers: DataFrame, key: str, score: str, outcome: str, baseline: str, least: int = 10) -> DataFrame:
    """(n, ic, baseline_ic) and nothing of any row; too few matches raise while it runs."""
    from orderloom.operators.windows import ranked

    rows = answers.select(key, F.col(outcome).cast("double").alias("_y"), (-F.col(baseline).cast("double")).alias("_b")).join(predictions.select(key, F.col(score).cast("double").alias("_s")), key).filter("_s is not null and _b is not null")
    rows = ranked(rows.withColumn("_all", F.lit(1)), ["_all"], {"ry": F.coalesce("_y", F.lit(0.0)), "rs": "_s", "rb": "_b"})
    out = rows.agg(F.count("*").alias("n"), corr("rs", "ry").alias("ic"), corr("rb", "ry").alias("baseline_ic"))
    few = F.raise_error(F.lit("too few predictions were matched")).cast("bigint")
    return out.withColumn("n", F.when(F.col("n") < least, few).otherwise(F.col("n")))


def train_priors(df: DataFrame, train, columns: list[str]) -> dict[str, float]:
    """Means of the training rows alone, for use as priors."""
    got = df.filter(train).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).first()
    return {c: got[c] if got[c] is not None else 0.0 for c in columns}


def tripwire(folder: str, forbidden: tuple[str, ...], allowed: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(file, text) of source files, other than the allowed ones, that name what they must not."""
    from pathlib import Path

    files = [p for p in sorted(Path(folder).rglob("*.py")) if p.name not in allowed]
    return [(p.name, word) for p in files for word in forbidden if word in p.read_text(encoding="utf-8")]


def file_hashes(spark, folder: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of all files below a folder; no file is read on the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(locked: DataFrame, now: DataFrame) -> DataFrame:
    """(file, change): files that were added, removed or altered since their hashes were locked."""
    a, b = locked.select("file", F.col("sha256").alias("_a")), now.select("file", F.col("sha256").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "altered")
    return a.join(b, "file", "full").select("file", change.alias("change")).filter("change is not null")


def append_to_ledger(df: DataFrame, path: str, order: list[str], columns: list[str]) -> None:
    """Add rows to a JSON ledger whose hashes chain on from its last line; a ledger is short and its order is total."""
    spark = df.sparkSession
    try:
        last = spark.read.json(path).orderBy(F.desc("seq")).select("seq", "line_hash").first()
    except Exception as e:  # the first time there is no ledger
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        last = None
    start, genesis = (last["seq"] + 1, last["line_hash"]) if last else (0, "0" * 64)
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    numbered = df.withColumn("seq", F.row_number().over(w) - 1 + start)
    out, prev = [], genesis
    for r in numbered.orderBy("seq").toLocalIterator():  # each hash holds the one before, so the chain is sequential by nature
        text = "|".join([prev, str(r["seq"]), *("" if r[c] is None else str(r[c]) for c in columns)])
        prev_hash, prev = prev, hashlib.sha256(text.encode()).hexdigest()
        out.append({**{c: r[c] for c in columns}, "seq": r["seq"], "prev_hash": prev_hash, "line_hash": prev})
    if out:
        kinds = {c: df.schema[c].dataType.simpleString() for c in columns}
        spark.createDataFrame(out, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "seq long, prev_hash string, line_hash string"])).coalesce(1).write.mode("append").json(path)


def broken_ledger(ledger: DataFrame, columns: list[str], genesis: str = "0" * 64) -> DataFrame:
    """(seq): lines that do not follow from their content and the line before; edits and removals show."""
    w = Window.partitionBy(F.lit(1)).orderBy("seq")  # a ledger is short
    before = F.coalesce(F.lag("line_hash").over(w), F.lit(genesis))
    own = F.sha2(F.concat_ws("|", "prev_hash", "seq", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    return ledger.withColumns({"_before": before, "_own": own}).filter((F.col("_before") != F.col("prev_hash")) | (F.col("_own") != F.col("line_hash"))).select("seq")
