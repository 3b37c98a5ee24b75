"""A corpus pipeline over the training-data operators: quality, near duplicates, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents, n_chars brought up to
date where texts change; the last adds the tokens of each text. Extra columns of docs are dropped, missing labels keep all
texts that are not empty, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontam, ngram_join, pii, quality
from tidemill.llm.common import settle, table
from tidemill.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    rows = docs.select(COLUMNS)
    model = quality.train(rows, table(spark, sf_dir, "labels"))
    return quality.score(rows, model).filter("keep").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links, that of the smallest id; rows that are equal in id and text become one.

    Rows without an id and texts without words stay.
    """
    rows = docs.select(COLUMNS)
    found = ngram_join.jaccard_components(rows).filter("doc_id IS NOT NULL AND n_shingles > 0")
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("row") == F.col("component_row"))
    key = ["doc_id", "row"]
    kept = rows.withColumn("row", F.xxhash64("text")).join(found.filter(~first).select(key).distinct(), key, "left_anti")
    many = settle(found.filter(first).groupBy(key).count().filter("count > 1").select(key))
    if many.isEmpty():
        return kept.select(COLUMNS)
    repeated = kept.join(many, key, "left_semi").groupBy(key).agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return kept.join(many, key, "left_anti").select(COLUMNS).union(repeated.select(COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.scan(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    rows = docs.select(COLUMNS)
    clean = pii.redact(rows, settle(pii.find(rows)))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their number of tokens and the digests of ids and decoded text."""
    coded = bpe.encode(docs.select(COLUMNS), tokenizer_path())
    return bpe.digests(coded, keep=COLUMNS[1:])


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: No SQL for the classifier, the bootstrapping and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each cut off from the last by a checkpoint in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else settle(docs), sf_dir)
    return docs
