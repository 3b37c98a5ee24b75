"""Prepared data sets and training files with the hashes of what was written."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import bm25, training

from . import records

PARTITIONS = ("train", "validation", "test")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, system = _path(spark, name)
    return system.exists(path)


def digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the names and hashes of a written folder's part files, in order; each file is hashed where it lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    sums = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("h")).orderBy("name").collect()
    return hashlib.sha256("\n".join(f"{h}  {n}" for n, h in sums).encode()).hexdigest()


def _manifest(spark: SparkSession, facts: dict, target: str) -> dict:
    rows = spark.createDataFrame([(json.dumps(facts, ensure_ascii=False, sort_keys=True),)], "value string")
    rows.coalesce(1).write.mode("errorifexists").text(target)
    return facts


def write_prepared(tasks: DataFrame, sentences: DataFrame, rejected: DataFrame, folder: str, tokens: Column | None = None, **more) -> dict:
    """Writes tasks, tasks by partition, the corpus and, given its tokens, its postings, and last a manifest with counts and hashes.

    Refuses a folder that has postings if none are asked for, since they would be of another corpus, and parts that are there already.
    tasks: as datasets.prepare gives them; more: further facts for the manifest.
    """
    spark = tasks.sparkSession
    if tokens is None and exists(spark, f"{folder}/postings"):
        raise FileExistsError(f"{folder}/postings would be of another corpus")
    records.write_jsonl(tasks, f"{folder}/tasks")
    for part in PARTITIONS:
        records.write_jsonl(tasks.filter(F.col("partition") == part), f"{folder}/tasks_{part}")
    records.write_jsonl(sentences, f"{folder}/corpus")
    parts = ["tasks", *(f"tasks_{p}" for p in PARTITIONS), "corpus"]
    indexed = 0
    if tokens is not None:
        bm25.postings(sentences, tokens).write.mode("errorifexists").parquet(f"{folder}/postings")
        indexed = spark.read.parquet(f"{folder}/postings").select("doc_id").distinct().count()
        parts.append("postings")
    counts = {r[0]: r[1] for r in tasks.groupBy("partition").count().collect()}
    facts = {
        "tasks": sum(counts.values()),
        "partition_counts": {p: counts.get(p, 0) for p in PARTITIONS},
        "corpus_records": sentences.count(),
        "bm25_records": indexed,
        "skipped_rows": rejected.count(),
        "files": {p: digest(spark, f"{folder}/{p}") for p in parts},
    }
    return _manifest(spark, facts | more, f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest").first()[0])


def changed(spark: SparkSession, folder: str) -> list[str]:
    """The parts of a prepared folder that are not what its manifest says."""
    return [p for p, h in read_manifest(spark, folder)["files"].items() if not exists(spark, f"{folder}/{p}") or digest(spark, f"{folder}/{p}") != h]


def write_training(episodes: DataFrame, source: str, target: str, report: str | None = None, repeat: int = 1, form: str = "messages", overwrite: bool = False, **gate) -> dict:
    """Gates episodes, writes their training rows as JSON lines, and reports what was kept and dropped, with hashes of source and target.

    source is the folder that the episodes came from; target and report must be others, and new unless overwrite is said.
    """
    spark = episodes.sparkSession
    if len({source.rstrip("/"), target.rstrip("/"), (report or "").rstrip("/")}) < 3:
        raise ValueError("source, target and report must differ")
    there = [p for p in (target, report) if p and exists(spark, p)]
    if there and not overwrite:
        raise FileExistsError(f"refusing to overwrite {', '.join(there)}")
    gated = training.gate(episodes, **gate)
    rows = training.messages(gated, repeat, form)
    records.write_jsonl(rows, target, overwrite=overwrite)
    counts: dict[str, dict[str, int]] = {}
    for r in training.report(gated, repeat).collect():  # sections and reasons
        counts.setdefault(r.section, {})[r["name"]] = r.n
    written = spark.read.text(target).count()
    if written != sum(counts.get("examples", {}).values()):
        raise RuntimeError("the rows written are not those of the report")
    facts = {"counts": counts, "examples_written": written, "source_sha256": digest(spark, source), "target_sha256": digest(spark, target)}
    facts["report_sha256"] = hashlib.sha256(json.dumps(facts, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    if report:
        if overwrite and exists(spark, report):
            path, system = _path(spark, report)
            system.delete(path, True)
        _manifest(spark, facts, report)
    return facts
