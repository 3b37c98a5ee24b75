"""Stored indexes: chunks, vectors, postings and their statistics as tables of one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import bm25

TABLES = ("chunks", "vectors", "postings")


def save(folder: str, chunks: DataFrame, tokens: Column, vectors: DataFrame | None = None, overwrite: bool = False) -> None:
    """Writes chunks (doc_id, text, ...), their postings and, if given, vectors (doc_id, vector). Replacing is asked for, never adding."""
    mode = "overwrite" if overwrite else "errorifexists"
    chunks.write.mode(mode).parquet(f"{folder}/chunks")
    bm25.postings(chunks, tokens).write.mode(mode).partitionBy().parquet(f"{folder}/postings")
    if vectors is not None:
        vectors.write.mode(mode).parquet(f"{folder}/vectors")


def exists(spark: SparkSession, folder: str, table: str = "chunks") -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    if table not in TABLES:
        raise ValueError(f"no table {table}")
    return spark.read.parquet(f"{folder}/{table}")


def stale(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """Documents of the postings that the chunks lack: an index of another corpus."""
    return postings.select("doc_id").distinct().join(chunks.select("doc_id"), "doc_id", "left_anti")


def misnamed(sentences: DataFrame) -> DataFrame:
    """Rows whose doc_id is not source#chunk_id."""
    return sentences.filter(~F.col("doc_id").eqNullSafe(F.concat("source", F.lit("#"), F.col("chunk_id").cast("string"))))
