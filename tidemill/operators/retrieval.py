"""Dense search, rank fusion, thresholds, reranking and parent expansion over hits.

A hit list is a DataFrame with query_id, rank (from 1) and a document's columns; order lives in rank alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries whose vectors a task compares at once, and corpus rows of one comparison: some 16 MB of scores.
BLOCK, ROWS = 1024, 2048
#: Corpus rows of a slice, which one block of queries meets in one task: some 50 MB at 64 dimensions.
SLICE = 200_000


def ranked(df: DataFrame, *order: Column, k: int | None = None, by: str = "query_id", rank: str = "rank") -> DataFrame:
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.filter(F.col(rank) <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2", query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "vector") -> DataFrame:
    """query_id, doc_id, score and rank of each query's k nearest rows; exact.

    metric l2: squared distance, ascending; cosine: descending, vectors of zero norm left out on either side. Ties go to the smaller
    doc_id. Ids are whole numbers or text. Up to BLOCK queries go along with the plan and meet the corpus as it is scanned. More are dealt
    into blocks, and each block meets each slice of the corpus in one task. A task keeps k candidates a query, and one window merges
    them, so no task sees a query's whole list. This is the stated query set against all rows, in blocks.
    """
    spark = corpus.sparkSession
    kinds = ["string" if df.schema[key].dataType.typeName() == "string" else "long" for df, key in ((queries, query_id), (corpus, doc_id))]
    packed = lambda df, key, kind: df.filter(F.col(vector).isNotNull()).select(F.col(key).cast(kind).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    asked, rows = packed(queries, query_id, kinds[0]), packed(corpus, doc_id, kinds[1])
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    arrow = pa.schema([(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(("query_id", "doc_id"), kinds, strict=True)] + [("score", pa.float64())])
    if metric == "cosine":
        live = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) > 1e-12
        asked, rows = asked.filter(live), rows.filter(live)
    n = asked.count()
    blocks = max(1, -(-n // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int"))
    if blocks == 1:  # at most BLOCK vectors: they go along with the plan
        held = asked.select("id", "v").collect()
        ids, q = np.array([r[0] for r in held]), np.array([r[1] for r in held], np.float64)
        sent = spark.sparkContext.broadcast((ids, q))

        def scan(batches):
            best = Best(*sent.value, k, metric)
            for batch in batches:
                best.add(_ids(batch.column(0)), _matrix(batch.column(1)))
            yield from best.rows(arrow)

        found = rows.mapInArrow(scan, schema) if n else spark.createDataFrame([], schema)
    else:
        # a slice of the corpus goes to each block of queries; both sides are dealt by (block, slice)
        slices = max(1, spark.sparkContext.defaultParallelism, -(-rows.count() // SLICE))
        cell = lambda df: df.withColumn("cell", F.col("block").cast("long") * slices + F.col("slice")).select("cell", "id", "v")
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        right = cell(rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).withColumn("block", each))
        left = cell(asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))

        def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            best = Best(_ids(mine.column("id")), _matrix(mine.column("v").combine_chunks()), k, metric)
            for batch in theirs.to_batches(max_chunksize=ROWS):
                best.add(_ids(batch.column("id")), _matrix(batch.column("v")))
            return pa.Table.from_batches(list(best.rows(arrow)), schema=arrow)

        found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(meet, schema)
    key = F.round(F.col("score"), 9)
    return ranked(found, key.asc() if metric == "l2" else key.desc(), F.col("doc_id"), k=k)


def _ids(column) -> np.ndarray:
    return np.array(column.to_pylist(), str) if pa.types.is_string(column.type) else column.to_numpy()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


class Best:
    """The k best rows so far for each of some queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str):
        self.ids, self.q, self.k, self.metric = ids, vectors, k, metric
        self.held_id, self.held = None, np.empty((len(ids), 0))

    def add(self, docs: np.ndarray, v: np.ndarray) -> None:
        for lo in range(0, len(docs), ROWS):
            self._add(docs[lo : lo + ROWS], v[lo : lo + ROWS])

    def _add(self, docs: np.ndarray, v: np.ndarray) -> None:
        q = self.q
        if self.metric == "cosine":
            score = -(q @ v.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1))
        else:
            score = np.maximum((q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None], 0)
        ids, score = np.broadcast_to(docs, score.shape), np.round(score, 12)
        if score.shape[1] > self.k:  # those that are not beyond the k-th score, ties included
            edge = np.partition(score, self.k - 1, axis=1)[:, self.k - 1]
            if self.held.shape[1] >= self.k:
                edge = np.minimum(edge, self.held[:, self.k - 1])
            few = np.flatnonzero((np.round(score, 9) <= np.round(edge, 9)[:, None]).any(axis=0))
            ids, score = ids[:, few], score[:, few]
        ids = ids if self.held_id is None else np.concatenate([self.held_id, ids], axis=1)
        score = np.concatenate([self.held, score], axis=1)
        order = np.lexsort((ids, np.round(score, 9)))[:, : self.k]
        self.held_id, self.held = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)

    def rows(self, schema: pa.Schema):
        n = self.held.shape[1]
        if n:
            sign = 1.0 if self.metric == "l2" else -1.0
            columns = [np.repeat(self.ids, n), self.held_id.ravel(), self.held.ravel() * sign]
            yield pa.RecordBatch.from_arrays([pa.array(c.tolist(), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def within(hits: DataFrame, most: float, strict: bool = False, k: int | None = None, score: str = "score") -> DataFrame:
    """Hits at a distance of at most `most`, ranked anew; a query without any keeps all of its hits, or none if strict."""
    ok = F.col(score) <= most
    out = hits.filter(ok) if strict else hits.withColumn("_any", F.max(ok).over(Window.partitionBy("query_id"))).filter(ok | ~F.col("_any")).drop("_any")
    return ranked(out.withColumnRenamed("rank", "_was"), F.col("_was"), k=k).drop("_was")


def fuse(branches: list[DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion: query_id, doc_id, score and rank. A document twice in a branch counts twice; ties go to the earlier branch, then rank."""
    every = None
    for i, b in enumerate(branches):
        part = b.select("query_id", "doc_id", (1.0 / (k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("branch"), "rank").alias("first"))
        every = part if every is None else every.unionByName(part)
    out = every.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.min("first").alias("first"))
    return ranked(out, F.round("score", 12).desc(), F.col("first"), k=top).drop("first")


def pool_size(top: int, candidates: int | None = None, branch: int | None = None) -> int:
    """How many hits to ask a branch for: at least what is returned and what is reranked (20 where nothing is), and at least the branch's own wish."""
    return max(max(top, candidates) if candidates is not None else max(top, 20), branch or 0)


def pooled(branches: list[DataFrame], score: Column, text: Column, query: Column, top: int, candidates: int = 15, k: int = 60) -> DataFrame:
    """Branches fused, the first `candidates` reranked by score, and the best of them returned, never more than there are candidates."""
    return rerank(fuse(branches, k, candidates), score, text, query, min(top, candidates))


def rerank(hits: DataFrame, score: Column, text: Column, query: Column, top: int) -> DataFrame:
    """Hits by score, those without text last, stable; a query that is blank, or without any text, keeps its order and has no scores."""
    by_query = Window.partitionBy("query_id")
    blank = F.trim(F.coalesce(query, F.lit(""))) == ""
    has = F.trim(F.coalesce(text, F.lit(""))) != ""
    df = hits.withColumn("_plain", blank | ~F.max(has).over(by_query)).withColumn("rerank_score", F.when(~F.col("_plain") & has, score))
    order = [F.when(~F.col("_plain"), F.col("rerank_score")).desc_nulls_last(), F.col("_was")]
    return ranked(df.withColumnRenamed("rank", "_was"), *order, k=top).drop("_was", "_plain")


def parent_id(source: Column, heading: Column, chunk_id: Column, window: int = 3) -> Column:
    section = F.trim(heading)
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(source, F.lit("::"), section)).otherwise(F.concat(source, F.lit("#p"), F.floor(chunk_id / window).cast("string")))


def expand(hits: DataFrame, chunks: DataFrame, cap: int | None = None, joiner: str = "\n\n") -> DataFrame:
    """Each hit's parent: query_id, rank, parent_id, text and child_chunk_ids, once a parent, in hit order.

    hits: query_id, rank, parent_id, chunk_id; chunks: parent_id, chunk_id, text. With a cap, the children are those in a
    frame of cap around the hit, moved inward at the ends; places among siblings are found before the join.
    """
    first = ranked(hits.withColumnRenamed("rank", "_was"), F.col("_was"), by="query_id").drop("_was")
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank"))).filter("_n = 1").drop("_n")
    siblings = Window.partitionBy("parent_id")
    placed = chunks.select("parent_id", "chunk_id", "text").withColumns({"i": F.row_number().over(siblings.orderBy("chunk_id")) - 1, "n": F.count("*").over(siblings)})
    at = placed.groupBy("parent_id", F.col("chunk_id").alias("hit")).agg(F.min("i").alias("at"))
    joined = first.select("query_id", "rank", "parent_id", F.col("chunk_id").alias("hit")).join(at, ["parent_id", "hit"], "left").join(placed, "parent_id")
    if cap is not None and cap > 0:
        middle = F.coalesce("at", F.floor(F.col("n") / 2))
        lo = F.greatest(F.lit(0), F.least(middle - cap // 2, F.col("n") - cap))
        joined = joined.filter((F.col("i") >= lo) & (F.col("i") < lo + cap))
    rows = F.array_sort(F.collect_list(F.struct("i", "chunk_id", F.trim("text").alias("text"))))
    out = joined.groupBy("query_id", "rank", "parent_id").agg(rows.alias("c"))
    text = F.array_join(F.filter(F.col("c")["text"], lambda t: t != ""), joiner)
    return ranked(out.withColumnRenamed("rank", "_was"), F.col("_was")).select("query_id", "rank", "parent_id", text.alias("text"), F.col("c")["chunk_id"].alias("child_chunk_ids"))


def window_ablation(chunks: DataFrame, needle: str, windows: list[int], doc: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """window, coverage and tokens: for each window size, the share of aligned groups of a document's chunks whose text has the needle, and their mean
    number of tokens. chunks: doc, chunk_id, text, tokens."""
    rows = chunks.withColumn("window", F.explode(F.array(*map(F.lit, windows))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n")
    groups = rows.groupBy("window", doc, F.floor(F.col("chunk_id") / F.col("window")).alias("_g")).agg(joined.alias("text"), F.sum(tokens).alias("tokens"))
    return groups.groupBy("window").agg(F.avg(F.contains("text", F.lit(needle)).cast("double")).alias("coverage"), F.avg("tokens").alias("tokens"))
