"""Five stages over documents: toxicity, near-dedup, substring dedup, secret scans, packing.

Each stage function takes (spark, docs, sf_dir); docs is a table that is already written. Stages
return the columns of documents, but for the last, which returns one row per packed piece.
Scratch tables of the stage before are deleted when the next one begins; those of other work stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import packing, scratch, secrets, simhash, substring, toxicity
from orderloom.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the scorer learns from the labelled ones outside fold 0."""
    with scratch.owned(spark, "pipeline"):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return toxicity.keep(docs, model, below=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least doc_id, of each component of SimHash links."""
    with scratch.owned(spark, "pipeline"):
        return simhash.one_each(docs, words=4, radius=4)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier elsewhere; other texts stay as they are."""
    with scratch.owned(spark, "pipeline"):
        return substring.strip_repeats(docs, window=20)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    with scratch.owned(spark, "pipeline"):
        return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens at most."""
    with scratch.owned(spark, "pipeline"):
        return packing.pack_documents(docs, vocabulary_path(), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: The first stage trains a model, so no SQL gives run()'s rows; tests hold a brute-force version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held: list[str] = []
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = scratch.fresh(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        for old in held:
            scratch.drop(spark, old)
        held = [path]
    return docs
