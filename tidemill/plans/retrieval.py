"""From files to an index, and from questions to grounded prompts, a batch of each at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import citation
from tidemill.operators import bm25, chunking, enrich, retrieval


def build_records(docs: DataFrame, size: int = 700, overlap: int = 120, group: int = 3, enriched: bool = True, pages: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Chunks of docs (source, text) with heading, block type and parent, and with pages (source, page, start) their first and last page.

    entries (source, modality, chunk_id, text, image_path, time_sec) are records already, as pictures and film frames are.
    """
    chunks = chunking.chunk_text(docs, "text", "source", size, overlap)
    if not enriched:
        return chunks
    stripped = docs.select("source", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    out = enrich.heading_paths(chunks, enrich.headings(stripped, "source"), "source")
    if pages is not None:
        out = enrich.assign_pages(out.withColumn("stop", F.col("end")), pages, "source").drop("stop")
    out = out.withColumns({"block_type": enrich.block_type(F.col("text")), "modality": F.lit("text")})
    if entries is not None:
        named = entries.withColumns({"chunk_id": F.coalesce(F.col("chunk_id").cast("int"), F.lit(0)), "modality": F.coalesce("modality", F.lit("text"))})
        out = out.unionByName(named.select(*[c for c in ("source", "modality", "chunk_id", "text", "image_path", "time_sec") if c in named.columns]), allowMissingColumns=True)
    return out.withColumn("parent_id", retrieval.parent_id(F.col("source"), F.col("heading"), F.col("chunk_id"), group))


def text_records(records: DataFrame) -> DataFrame:
    """Records of text that is not blank."""
    return records.filter((F.coalesce("modality", F.lit("text")) == "text") & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def image_records(records: DataFrame) -> DataFrame:
    """Records of pictures that have a path."""
    return records.filter((F.col("modality") == "image") & (F.coalesce("image_path", F.lit("")) != ""))


def direct(questions: DataFrame) -> DataFrame:
    """Each question (query_id, text) as its own only hit, for answers without retrieval."""
    return questions.select("query_id", F.lit(1).alias("rank"), F.lit("direct_query").alias("source"), F.lit(-1).alias("chunk_id"), F.lit(0).alias("start"), F.length("text").alias("end"), "text", F.lit("text").alias("modality"))


def hybrid(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, tokens: Callable[[Column], Column], pool: int = 20, k: int = 60, top: int = 4, most: float | None = None) -> DataFrame:
    """Fused hits of dense and lexical search.

    questions: query_id, text, vector; chunks: doc_id, text; vectors: doc_id, vector.
    """
    dense = retrieval.nearest(questions, vectors, pool)
    if most is not None:
        dense = retrieval.within(dense, most)
    lexical = bm25.search(questions, tokens(F.col("text")), chunks, tokens(F.col("text")), pool)
    return retrieval.fuse([dense, lexical], k, top)


#: Titles of a prompt's sections. Fixed values.
QUESTION, CONTEXT, TOOLS = "User question", "Retrieved context", "Verified tool outputs"
ACTIONS, MEMORY = "Confirmed actions (operation status only, not factual evidence)", "About the user (personal background, not evidence)"


def contexts(hits: DataFrame) -> DataFrame:
    """query_id and context: passages under their labels in order of rank.

    hits: query_id, rank, source, chunk_id, text and, where known, page_start, page_end, modality, image_path, time_sec.
    """
    has = lambda c, kind: F.col(c) if c in hits.columns else F.lit(None).cast(kind)
    modality = F.coalesce(has("modality", "string"), F.lit("text"))
    label = citation(F.col("source"), F.col("chunk_id"), has("page_start", "int"), has("page_end", "int"), modality, has("time_sec", "double"))
    path = F.coalesce(F.concat(F.lit(", image_path="), has("image_path", "string")), F.lit(""))
    passage = F.concat(F.lit("["), label, F.lit("]\n"), F.trim(F.coalesce("text", F.lit(""))), F.lit("\n(modality="), modality, path, F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("rank", passage.alias("p"))))
    return hits.groupBy("query_id").agg(F.trim(F.array_join(F.transform(rows, lambda x: x["p"]), "\n\n")).alias("context"))


SOURCE_FIELDS = {"source": "string", "chunk_id": "int", "modality": "string", "start": "int", "end": "int", "time_sec": "double", "image_path": "string"}


def sources(hits: DataFrame) -> DataFrame:
    """query_id and sources: label and place of each hit, in order of rank, as an answer names them."""
    has = lambda c, kind: F.col(c) if c in hits.columns else F.lit(None).cast(kind)
    modality = F.coalesce(has("modality", "string"), F.lit("text"))
    label = citation(F.col("source"), F.col("chunk_id"), has("page_start", "int"), has("page_end", "int"), modality, has("time_sec", "double"))
    fields = [(modality if c == "modality" else has(c, k)).cast(k).alias(c) for c, k in SOURCE_FIELDS.items()]
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(label.alias("citation"), *fields).alias("s"))))
    return hits.groupBy("query_id").agg(F.transform(rows, lambda x: x["s"]).alias("sources"))


def serialise(answers: DataFrame) -> DataFrame:
    """query_id and json of answers: answer, sources, recalled_memories, memory_ops and route, as far as they are there; no lists are empty lists."""
    has = lambda c: c in answers.columns
    fields = [F.coalesce("answer", F.lit("")).alias("answer")]
    fields += [F.coalesce(c, F.array().cast(answers.schema[c].dataType)).alias(c) for c in ("memory_ops", "recalled_memories") if has(c)]
    if has("use_docs"):
        fields.append(F.struct(F.col("query").alias("rewritten_query"), "use_docs", "use_memory", "write_memory").alias("route"))
    if has("sources"):
        fields.append(F.coalesce("sources", F.array().cast(answers.schema["sources"].dataType)).alias("sources"))
    return answers.select("query_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def prompts(questions: DataFrame, context: DataFrame, closing: str | None = None, **more: DataFrame) -> DataFrame:
    """query_id and prompt of questions (query_id, text): question and context, then what there is of tools, actions and memory.

    context and the others: query_id and a column by their own name (context, tools, actions, memory). closing: what is asked last.
    """
    df = questions.join(context, "query_id", "left")
    parts = [F.concat(F.lit(f"{QUESTION}:\n"), F.col("text")), F.concat(F.lit(f"{CONTEXT}:\n"), F.coalesce("context", F.lit("")))]
    for name, title in (("tools", TOOLS), ("actions", ACTIONS), ("memory", MEMORY)):
        if name in more:
            df = df.join(more[name], "query_id", "left")
            said = F.trim(F.coalesce(name, F.lit("")))
            parts.append(F.when(said != "", F.concat(F.lit(f"{title}:\n"), said)))
    return df.select("query_id", F.concat_ws("\n\n", *parts, F.lit(closing) if closing else F.lit(None).cast("string")).alias("prompt"))
