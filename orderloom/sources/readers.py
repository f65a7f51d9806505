"""Readers with declared schemas; NaN becomes NULL at the door."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.nulls import nn


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table, its columns pruned at the scan and its doubles free of NaN."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: nn(c) for c in doubles}) if doubles else df


def csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, encoding: str = "UTF-8", columns: list[str] | None = None, index: bool = False) -> DataFrame:
    """Headered or positional CSV, plain or gzipped, with or without a byte order mark.

    columns: only these are parsed. index: the first column is a row number without a name, which goes.
    """
    schema = f"`_index` string, {schema}" if index else schema
    df = spark.read.schema(schema).option("encoding", encoding).csv(path, header=header)
    df = df.drop("_index") if index else df
    return df.select(*columns) if columns else df


def csv_cells(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as text; empty cells stay empty, they are not missing."""
    df = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("nullValue", "\0").csv(path, header=True)
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def sharded(spark: SparkSession, glob: str, pattern: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Files of many years as one table with the year of each file's name. pattern: one group."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.format(kind).load(glob)
    return df.withColumn("file_year", F.regexp_extract(F.input_file_name(), pattern, 1).try_cast("int"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are none are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def header_rows(doc: Column, wanted: dict[str, str]) -> Column:
    """array<struct> of a document ``{"headers": [..], "rowSet": [[..], ..]}``; columns by header name."""
    headers = F.from_json(F.get_json_object(doc, "$.headers"), "array<string>")
    rows = F.from_json(F.get_json_object(doc, "$.rowSet"), "array<array<string>>")
    pick = lambda p, r, h: F.get(r, F.array_position(p["headers"], h).cast("int") - 1)
    read = lambda p: F.transform(p["rows"], lambda r: F.struct(*(pick(p, r, h).try_cast(t).alias(h.lower()) for h, t in wanted.items())))
    # the parts are bound once, or else every cell would parse its whole document again
    return F.get(F.transform(F.array(F.struct(headers.alias("headers"), rows.alias("rows"))), read), F.lit(0))


#: What the Western code page has where Latin-1 has controls; five places are empty.
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
WESTERN = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, or else the Western code page."""
    western = F.translate(F.decode(content, "ISO-8859-1"), CONTROLS, WESTERN)
    return F.coalesce(F.try_validate_utf8(content.cast("string")), western)


def jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in ranges of one column."""
    return spark.read.options(**options).jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def before_cutoff(listing: DataFrame, ts: str, cutoff: Column, status: str = "status", back: str | None = None) -> DataFrame:
    """Captures that answered and were taken before a cutoff, and not longer ago than ``back`` (an interval)."""
    df = listing.filter((F.col(status) == 200) & (F.col(ts) < cutoff))
    return df if back is None else df.filter(F.col(ts) >= cutoff - F.expr(f"interval {back}"))


def numeric(df: DataFrame, prefix: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Number columns whose name starts so, and the kept ones."""
    kinds = (T.NumericType,)
    return df.select(*(f.name for f in df.schema if f.name in keep or (f.name.startswith(prefix) and isinstance(f.dataType, kinds))))


def feature_files(spark: SparkSession, paths: list[str], keys: list[str], least: float, prefix: str = "") -> DataFrame:
    """Feature tables joined on their keys: numbers only, one row a key, columns present in at least a share of rows and not constant.

    Coverage is counted by one aggregate over each table.
    """
    out: DataFrame | None = None
    for path in paths:
        df = numeric(spark.read.parquet(path), prefix, tuple(keys)).dropDuplicates(keys)
        names = [c for c in df.columns if c not in keys]
        seen = df.agg(F.count(F.lit(1)).alias("_n"), *(F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in names)).first()
        kept = [c for c in names if seen["_n"] and seen[c]["n"] >= least * seen["_n"] and seen[c]["lo"] != seen[c]["hi"]]
        df = df.select(*keys, *kept)
        out = df if out is None else out.join(df, keys, "full")
    return out
