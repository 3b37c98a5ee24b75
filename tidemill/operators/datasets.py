"""Dataset preparation: question rows to tasks and sentences, deduplication, components and partitions."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import compose_each, fold_each, partition_name, slug


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder that the session names; a run on one machine may do without naming one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemill-"))
    return df.checkpoint()


def document_id(title: Column, sentences: Column, dataset: str = "documents", folded: Column | None = None) -> Column:
    """Data set, slug of the title and ten hex digits of title and sentences. folded: the title's case-folded NFKC (functions.text.fold_title)
    where titles are more than ASCII."""
    digest = F.substring(F.sha1(F.concat(title, F.lit("\n"), F.array_join(sentences, "\n"))), 1, 10)
    return F.concat(F.lit(f"{dataset}/"), slug(title if folded is None else folded), F.lit("-"), digest)


def document_key(title: Column, dataset: str = "documents", folded: Column | None = None) -> Column:
    """The same for every document of a title, whatever its spaces and case."""
    plain = F.trim(F.regexp_replace(F.lower(title), r"\s+", " ")) if folded is None else folded
    return F.concat(F.lit(f"{dataset}-title/"), slug(plain), F.lit("-"), F.substring(F.sha2(plain, 256), 1, 16))


def convert(rows: DataFrame, dataset: str = "documents", compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks, sentences and rejected rows (id, reason) of question rows. compat: titles become NFKC and their slugs are case-folded.

    rows: id, question, answer, type, supporting_facts struct<title array, sent_id array>, context struct<title array, sentences
    array<array>>. Titles and sentences are trimmed, blank sentences have no row. A row is rejected when its arrays differ in
    length, a document is empty or a supporting fact is not in its context.
    """
    c, s = F.col("context"), F.col("supporting_facts")
    if compat:
        rows = rows.withColumn("_titles", compose_each(c["title"])).withColumn("_folded", fold_each(c["title"]))
        rows = rows.withColumn("_support", compose_each(s["title"]))
        titles, folded, support = F.col("_titles"), F.col("_folded"), F.col("_support")
    else:
        support = s["title"]
        titles, folded = c["title"], F.transform(c["title"], lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    zipped = F.arrays_zip(titles.alias("title"), c["sentences"].alias("sentences"), folded.alias("folded"))
    clean = F.transform(zipped, lambda d: F.struct(F.trim(d["title"]).alias("title"), F.transform(d["sentences"], lambda x: F.trim(x)).alias("sentences"), d["folded"].alias("folded")))
    docs = F.transform(clean, lambda d: F.struct(d["title"].alias("title"), d["sentences"].alias("sentences"), document_id(d["title"], d["sentences"], dataset, d["folded"]).alias("source"), document_key(d["title"], dataset, d["folded"]).alias("key")))

    def places(f: Column) -> Column:
        n = f["sent_id"]
        has = lambda d: (d["title"] == F.trim(f["title"])) & (n >= 0) & (F.coalesce(F.try_element_at(d["sentences"], n + 1), F.lit("")) != "")
        return F.transform(F.slice(F.filter(docs, has), -1, 1), lambda d: F.concat(d["source"], F.lit("#"), n.cast("string")))

    found = F.transform(F.arrays_zip(support.alias("title"), s["sent_id"].alias("sent_id")), places)
    reason = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "missing_id")
        .when(F.coalesce(F.trim("question"), F.lit("")) == "", "missing_question")
        .when(F.coalesce(F.trim("answer"), F.lit("")) == "", "missing_answer")
        .when(F.size(c["title"]) != F.size(c["sentences"]), "context_length")
        .when(F.exists(clean, lambda d: (F.coalesce(d["title"], F.lit("")) == "") | (F.size(d["sentences"]) < 1)), "empty_document")
        .when(F.size(s["title"]) != F.size(s["sent_id"]), "support_length")
        .when(F.exists(found, lambda x: F.size(x) < 1), "unknown_support")
    )
    df = rows.withColumn("reason", reason)
    good = df.filter("reason IS NULL").withColumn("docs", docs)
    gold = F.array_distinct(F.flatten(found))
    tasks = good.select(F.concat(F.lit(f"{dataset}_"), "id").alias("task_id"), F.trim("question").alias("question"), F.lit("multihop").alias("task_type"), F.array(F.trim("answer")).alias("gold_answers"), gold.alias("gold_evidence_ids"), F.array_distinct(F.transform("docs", lambda d: d["key"])).alias("document_keys"), F.col("type").alias("question_type"))
    each = good.select(F.inline("docs")).select("title", "source", F.posexplode("sentences").alias("chunk_id", "text")).filter("text <> ''")
    sentences = each.select(F.concat("source", F.lit("#"), "chunk_id").alias("doc_id"), "source", "chunk_id", "title", F.concat_ws("\n", "title", "text").alias("text"))
    return tasks, sentences.distinct(), df.filter("reason IS NOT NULL").select("id", "reason")


def collisions(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one payload."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.count_distinct(F.struct(*rest)).alias("n")).filter("n > 1")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, and how many have them."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unique(df: DataFrame, *key: str) -> DataFrame:
    """One row a key (of all columns, if none is named); equal rows collapse. Look at collisions() first if payloads may differ."""
    return df.dropDuplicates(list(key) or df.columns)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """left's nodes and the smallest left node that shared right nodes connect it to.

    Labels go to the least of each right node's and each left node's neighbourhood in turn, by aggregates, and jump to their
    label's label, until none changes.
    """
    e = checkpoint(edges.select(F.col(left).alias("l"), F.col(right).alias("r")).distinct())
    labels = e.select("l").distinct().withColumn("c", F.col("l"))
    while True:
        by_right = e.join(labels, "l").groupBy("r").agg(F.min("c").alias("c"))
        by_left = e.join(by_right, "r").groupBy("l").agg(F.min("c").alias("c"))
        jump = by_left.select(F.col("l").alias("c"), F.col("c").alias("cc"))
        after = checkpoint(by_left.join(jump, "c", "left").select("l", F.least("c", F.coalesce("cc", "c")).alias("c")))
        moved = after.join(labels.select("l", F.col("c").alias("was")), "l").filter("c <> was").limit(1).count()
        labels = after
        if not moved:
            return labels.select(F.col("l").alias(left), F.col("c").alias("component"))


def disjoint_partitions(task_documents: DataFrame) -> DataFrame:
    """task_id, component and partition: tasks that share documents, through any chain, fall into the same partition.

    A component's bucket is that of its sorted document keys, joined by |; a task whose document_key is null has none and the
    bucket of the empty text. A component's keys meet in one row, as the digest is of their whole list.
    """
    none = task_documents.groupBy("task_id").agg(F.count("document_key").alias("n")).filter("n = 0").select("task_id", F.col("task_id").alias("component"))
    linked = task_documents.filter("document_key IS NOT NULL")
    found = checkpoint(components(linked, "task_id", "document_key"))
    keys = linked.join(found, "task_id").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("document_key")), "|").alias("key"))
    named = keys.select("component", partition_name(F.col("key")).alias("partition"))
    return found.join(named, "component").select("task_id", "component", "partition").union(none.select("task_id", "component", partition_name(F.lit("")).alias("partition")))


def single_partition(tasks: DataFrame, partition: str) -> DataFrame:
    """tasks, all in one partition."""
    if partition not in ("train", "validation", "test"):
        raise ValueError("partition is train, validation or test")
    return tasks.withColumn("partition", F.lit(partition))


def prepare(rows: DataFrame, dataset: str = "documents", partition: str | None = None, skip_invalid: bool = False, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Partitioned tasks, the sentence corpus and rejected rows. Without skip_invalid a rejected row is an error, as are two tasks of one id
    and two sentences of one id that differ; partition puts all tasks into one instead of by documents."""
    tasks, sentences, rejected = (checkpoint(x) for x in convert(rows, dataset, compat))
    if not skip_invalid and (bad := rejected.first()) is not None:
        raise ValueError(f"invalid row {bad['id']}: {bad['reason']}")
    if (twice := tasks.groupBy("task_id").count().filter("count > 1").first()) is not None:
        raise ValueError(f"duplicate task id: {twice[0]}")
    if (clash := collisions(sentences, "doc_id").first()) is not None:
        raise ValueError(f"corpus collision for {clash[0]}")
    if partition is not None:
        return single_partition(tasks, partition), unique(sentences, "doc_id"), rejected
    parts = disjoint_partitions(tasks.select("task_id", F.explode_outer("document_keys").alias("document_key"))).select("task_id", "partition")
    return tasks.join(parts, "task_id"), unique(sentences, "doc_id"), rejected


def refine_qrels(qrels: DataFrame, chunks: DataFrame, picked: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id and relevance of chunks for qrels of whole sources (query_id, source).

    A source's only chunk is taken as it is; of several, those that a judge picked (query_id, source, chunk_id) and that exist, else the
    first. Sources without chunks are left out. chunks: source, chunk_id.
    """
    sizes = chunks.groupBy("source").agg(F.count_distinct("chunk_id").alias("n"), F.min("chunk_id").alias("first"))
    asked = qrels.select("query_id", "source").distinct().join(sizes, "source")
    if picked is None:
        chosen = asked.select("query_id", "source", F.col("first").alias("chunk_id"))
    else:
        real = picked.select("query_id", "source", "chunk_id").distinct().join(chunks.select("source", "chunk_id").distinct(), ["source", "chunk_id"])
        many = asked.filter("n > 1").join(real, ["query_id", "source"], "left").select("query_id", "source", F.coalesce("chunk_id", "first").alias("chunk_id"))
        chosen = asked.filter("n = 1").select("query_id", "source", F.col("first").alias("chunk_id")).union(many)
    return chosen.select("query_id", F.concat("source", F.lit("#"), F.col("chunk_id").cast("string")).alias("doc_id"), F.lit(1).alias("relevance"))


def text_stats(df: DataFrame, size: str, key: str) -> DataFrame:
    """One row: n, distinct keys, and the least, greatest and mean size."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"), F.min(size).alias("least"), F.max(size).alias("most"), F.avg(size).alias("mean"))


def gaps(log: DataFrame, by: str, seq: str) -> DataFrame:
    """Rows whose sequence number does not follow that before it, which must start at 0."""
    before = F.lag(seq).over(Window.partitionBy(by).orderBy(seq))
    return log.withColumn("expected", F.coalesce(before + 1, F.lit(0))).filter(F.col(seq) != F.col("expected"))
