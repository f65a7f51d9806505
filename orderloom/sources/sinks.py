"""Writers: overwrite, append by partition, one-row documents, provenance beside data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.nulls import nn


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL on the way out."""
    number = lambda f: isinstance(f.dataType, (T.DoubleType, T.FloatType))
    return df.select(*((nn(f.name) if number(f) else F.col(f.name)).alias(f.name, metadata=f.metadata) for f in df.schema))


def overwrite(df: DataFrame, path: str) -> None:
    clean(df).write.mode("overwrite").parquet(path)


def append_partitions(df: DataFrame, path: str, by: str) -> None:
    """Add data by partition, one writer for each, compressed hard."""
    clean(df).repartition(by).write.mode("append").partitionBy(by).option("compression", "zstd").parquet(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    clean(df).write.mode(mode).option("header", True).csv(path)


def ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def jdbc(df: DataFrame, url: str, name: str, mode: str = "append", batch: int = 500, **options: str) -> None:
    clean(df).write.options(batchsize=str(batch), **options).mode(mode).jdbc(url, name)


def with_dictionary(df: DataFrame, meaning: dict[str, str]) -> DataFrame:
    """df with a comment on each column; every column must have one, and every comment a column."""
    if missing := set(df.columns) ^ set(meaning):
        raise ValueError(f"columns and dictionary differ: {sorted(missing)}")
    return df.select(*(F.col(c).alias(c, metadata={"comment": meaning[c]}) for c in df.columns))


def provenance(df: DataFrame, keys: list[str], source: str, ts: str) -> DataFrame:
    """Side table: where each row came from and when it was captured."""
    return df.select(*keys, F.col(source).alias("source"), F.col(ts).alias("captured"), F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("row_hash"))


def document(df: DataFrame, path: str, most_rows: int = 10_000) -> None:
    """A report as one JSON document, an array of its rows; a table larger than a report is refused."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"a document holds {most_rows} rows at most")
    df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("value")).write.mode("overwrite").text(path)


def documents(df: DataFrame, path: str, document: Column) -> None:
    """A table as JSON documents, each an array of the rows of one value of ``document``, sorted; a line holds a document.

    document is to bound a document's size, as a range of a unique key does; rows where it is NULL make one document.
    """
    made = df.groupBy(document.alias("_d")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("value"))
    made.select("value").write.mode("overwrite").text(path)


# -- versions of a table -------------------------------------------------------------------


def _files(df_or_spark, path: str):
    spark = df_or_spark if hasattr(df_or_spark, "sparkContext") else df_or_spark.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return spark, jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _point(spark, jvm, files, path: str, version: int) -> None:
    """Write the pointer beside its place, then rename it, so that readers see the old one or the new one."""
    new, place = jvm.org.apache.hadoop.fs.Path(f"{path}/.current.new"), jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    out = files.create(new, True)
    out.write(bytearray(str(version).encode()))
    out.close()
    files.delete(place, False)
    files.rename(new, place)


def versions(spark, path: str) -> list[int]:
    """Versions that are whole, oldest first."""
    spark, jvm, files = _files(spark, path)
    hadoop = jvm.org.apache.hadoop.fs.Path
    found = files.globStatus(hadoop(f"{path}/v=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)


def snapshot(df: DataFrame, path: str) -> int:
    """Write df as the next version of a table and make it the current one."""
    spark, jvm, files = _files(df, path)
    number = max(versions(spark, path), default=0) + 1
    clean(df).write.mode("overwrite").parquet(f"{path}/v={number}")
    _point(spark, jvm, files, path, number)
    return number


def current(spark, path: str) -> DataFrame:
    spark, jvm, files = _files(spark, path)
    version = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/v={version}")


def restore(spark, path: str, version: int) -> None:
    if version not in versions(spark, path):
        raise ValueError(f"no version {version}")
    spark, jvm, files = _files(spark, path)
    _point(spark, jvm, files, path, version)


def prune(spark, path: str, keep: int) -> list[int]:
    """Delete all but the last few versions and the current one; the numbers of those deleted."""
    spark, jvm, files = _files(spark, path)
    now = int(spark.read.text(f"{path}/current").first()[0])
    gone = [v for v in versions(spark, path)[: -keep or None] if v != now]
    for v in gone:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}"), True)
    return gone


# -- databases -----------------------------------------------------------------------------


def ddl(df: DataFrame, name: str, keys: list[str], indexes: tuple[tuple[str, ...], ...] = (), readers: str | None = None) -> list[str]:
    """Statements that make a table for df: columns, primary key, indexes, and row security that lets a role read."""
    kinds = {"string": "text", "double": "double precision", "float": "real", "bigint": "bigint", "int": "integer", "boolean": "boolean", "date": "date", "timestamp": "timestamptz"}
    columns = [f'"{f.name}" {kinds.get(f.dataType.simpleString(), "text")}{" not null" if f.name in keys else ""}' for f in df.schema]
    quoted = lambda names: ", ".join(f'"{n}"' for n in names)
    out = [f'create table if not exists "{name}" ({", ".join(columns)}, primary key ({quoted(keys)}))']
    out += [f'create index if not exists "{name}_{"_".join(c)}" on "{name}" ({quoted(c)})' for c in indexes]
    if readers:
        out += [f'alter table "{name}" enable row level security', f'create policy "{name}_read" on "{name}" for select to {readers} using (true)']
    return out


def execute(spark, url: str, statements: list[str], **properties: str) -> None:
    """Run statements in one transaction over the driver's connection."""
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        for s in statements:
            statement = connection.createStatement()
            statement.execute(s)
            statement.close()
        connection.commit()
    finally:
        connection.close()


def jdbc_replace(df: DataFrame, url: str, name: str, condition: str, batch: int = 500, **options: str) -> None:
    """Rows of a table that meet a condition give way to df."""
    execute(df.sparkSession, url, [f"delete from {name} where {condition}"], **options)
    jdbc(df, url, name, "append", batch, **options)
