"""BM25 over an inverted index kept as tables: postings, vocabulary and one row of corpus statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .datasets import checkpoint
from .retrieval import ranked
from .training import numbered

# Fixed values of the formula.
K1, B, EPSILON = 1.5, 0.75, 0.25

def postings(docs: DataFrame, tokens: Column, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, tok, tf and dl of each distinct token of each document that has tokens; null tokens are left out.

    A row has all its tokens, so they are counted within Arrow batches and nothing is shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("t"))

    def run(batches):
        for batch in batches:
            lists, flat = batch.column(1), batch.column(1).flatten()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            if flat.null_count:
                row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
                size = np.bincount(row, minlength=len(size))
            words = flat.dictionary_encode()
            kinds = max(1, len(words.dictionary))
            seen, n = np.unique(row * kinds + words.indices.to_numpy(), return_counts=True)
            at = seen // kinds
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), words.dictionary.take(pa.array(seen % kinds)), pa.array(n), pa.array(size[at])], names=["doc_id", "tok", "tf", "dl"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tok string, tf long, dl long")


def vocabulary(index: DataFrame, n: int) -> DataFrame:
    """tok, df and idf of an index of n documents."""
    return weights(index.groupBy("tok").agg(F.count("*").alias("df")), n)


def frequencies(index: DataFrame) -> tuple[DataFrame, int, int]:
    """tok and df of each word, in a checkpoint, and the numbers of documents and tokens, from one pass over the index."""
    words = checkpoint(index.groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.sum(F.col("tf") / F.col("dl")).alias("docs")))
    n, tokens = words.agg(F.round(F.sum("docs")).cast("long"), F.sum("tf").cast("long")).first()
    return words.select("tok", "df"), n or 0, tokens or 0


def sizes(index: DataFrame) -> DataFrame:
    """n_docs, n_tokens and avgdl: one row. A document's tf add up to its dl, so tf / dl counts it once without a shuffle by document."""
    n, tokens = F.round(F.sum(F.col("tf") / F.col("dl"))).cast("long"), F.sum("tf")
    return index.agg(n.alias("n_docs"), tokens.cast("long").alias("n_tokens"), (tokens / n).alias("avgdl"))


def statistics(index: DataFrame) -> DataFrame:
    """n_docs, n_tokens, avgdl, n_terms and average_idf: one row. The index is read once, for the words' frequencies."""
    words, n, tokens = frequencies(index)
    raw = words.select((F.log(F.lit(float(n or 0)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    return raw.agg(F.lit(n).alias("n_docs"), F.lit(tokens).cast("long").alias("n_tokens"), F.lit(tokens / n if n else None).cast("double").alias("avgdl"), F.count("*").alias("n_terms"), F.avg("raw").alias("average_idf"))


def search(queries: DataFrame, query_tokens: Column, docs: DataFrame, doc_tokens: Column, k: int = 10, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """query_id, doc_id, score and rank of the k best documents, ties by doc_id.

    A query with tokens always has k hits if there are k documents: those without a common token score 0 and go by doc_id. Only postings
    of words that some query asks for are kept, in a checkpoint, as several steps read them.
    """
    index = postings(docs, doc_tokens, doc_id)
    asked = queries.select(F.col(query_id).alias("query_id"), query_tokens.alias("t")).filter(F.size("t") > 0)
    terms = checkpoint(asked.select("query_id", F.explode("t").alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("times")))
    df, n, tokens = frequencies(index)
    if not n:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    words = terms.select("tok").distinct()
    weighed = terms.join(weights(df, n), "tok")
    tf, dl = F.col("tf"), F.col("dl")
    gain = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(tokens / n)))
    mine = index.join(words, "tok", "left_semi")
    scored = checkpoint(weighed.join(mine, "tok").groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score")))
    found = scored.groupBy("query_id").agg(F.sum((F.col("score") >= 0).cast("int")).alias("good"))
    need = asked.select("query_id").distinct().join(found, "query_id", "left").filter(F.coalesce("good", F.lit(0)) < k)
    if not need.isEmpty():
        scored = scored.unionByName(_padding(need.select("query_id"), scored, docs.filter(F.size(doc_tokens) > 0).select(F.col(doc_id).alias("doc_id")), k))
    return ranked(scored, F.round("score", 9).desc(), F.col("doc_id"), k=k)


def weights(df: DataFrame, n: int) -> DataFrame:
    """tok, df and idf of a table of document frequencies; a negative idf is EPSILON times the mean idf."""
    raw = df.select("tok", "df", (F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.coalesce(F.avg("raw"), F.lit(0.0))).first()[0]
    return raw.select("tok", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def _padding(short: DataFrame, scored: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """For each query the first k documents by id that it has not matched, at score 0.

    A query lacks the first documents in order but for those that it matched: the i-th smallest id that it has not matched is at a place of
    the order not beyond i plus its matches before it. Documents are numbered; a query's matches among them give the free places by
    arithmetic, so what is made is k rows a query.
    """
    places = checkpoint(numbered(docs.distinct(), "doc_id"))
    taken = scored.join(short, "query_id", "left_semi").join(places, "doc_id").select("query_id", "ord")
    # the g-th match of a query at place p leaves p - g free places before it; free place i stands behind the matches with p - g <= i
    w = Window.partitionBy("query_id").orderBy("ord")
    before = taken.withColumn("free", F.col("ord") - F.row_number().over(w) + 1).filter(F.col("free") <= k - 1)
    shifts = before.groupBy("query_id", "free").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.collect_list(F.struct("free", "n")).alias("s"))  # at most k entries
    wanted = short.join(shifts, "query_id", "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    moved = F.aggregate(F.coalesce("s", F.array().cast("array<struct<free:bigint,n:bigint>>")), F.lit(0).cast("long"), lambda a, x: a + F.when(x["free"] <= F.col("i"), x["n"]).otherwise(0))
    return wanted.select("query_id", (F.col("i") + moved).alias("ord")).join(places, "ord").select("query_id", "doc_id", F.lit(0.0).alias("score"))
