"""One configuration, and the retriever, turn agent and tool agent that it makes of an index and injected models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import bm25, episodes, memory, messages, retrieval

from . import agent

Step = Callable[[DataFrame], DataFrame]
Say = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Config:
    top_k: int = 4
    max_distance: float = 0.8
    rerank_candidates: int | None = None
    vector_k: int = 20
    bm25_k: int = 20
    rrf_k: int = 60
    parents: bool = True
    max_parent_chunks: int = 6
    recall_k: int = 5
    max_steps: int = 6
    max_tool_calls: int = 8


def retriever(config: Config, chunks: DataFrame | None, vectors: DataFrame | None, embed: Callable[[Column], Column], tokens: Callable[[Column], Column] | None = None, score: Callable[[Column, Column], Column] | None = None) -> Step:
    """A function of (query_id, query) that gives query_id, rank, source, chunk_id and text.

    Dense hits within max_distance, or all where none is; fused with lexical ones if tokens are given; reranked if a score of (query, text)
    is; and their parents' text if config says so. chunks: doc_id, source, chunk_id, text and parent_id; without an index nothing is found.
    """

    def nothing(asked: DataFrame) -> DataFrame:
        return asked.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit("").alias("source"), F.lit(0).alias("chunk_id"), F.lit("").alias("text"))

    if chunks is None or vectors is None:
        return nothing
    rerank = score is not None
    pool = retrieval.pool_size(config.top_k, config.rerank_candidates or 20 if rerank else None)

    def find(asked: DataFrame) -> DataFrame:
        queries = asked.select("query_id", F.col("query").alias("text"), embed(F.col("query")).alias("vector"))
        hits = retrieval.within(retrieval.nearest(queries, vectors, max(pool, config.vector_k)), config.max_distance)
        if tokens is not None:
            lexical = bm25.search(queries, tokens(F.col("text")), chunks, tokens(F.col("text")), max(pool, config.bm25_k))
            hits = retrieval.fuse([hits, lexical], config.rrf_k, pool)
        found = hits.filter(F.col("rank") <= pool).select("query_id", "doc_id", "rank").join(chunks, "doc_id")
        if rerank:
            found = retrieval.rerank(found.join(asked.select("query_id", "query"), "query_id"), score(F.col("query"), F.col("text")), F.col("text"), F.col("query"), config.top_k)
        found = found.filter(F.col("rank") <= config.top_k)
        if config.parents:
            whole = retrieval.expand(found.select("query_id", "rank", "parent_id", "chunk_id"), chunks, config.max_parent_chunks)
            first = found.groupBy("query_id", "parent_id").agg(F.min_by(F.struct("source", "chunk_id"), "rank").alias("h"))
            return whole.join(first, ["query_id", "parent_id"]).select("query_id", "rank", "h.source", "h.chunk_id", "text")
        return found.select("query_id", "rank", "source", "chunk_id", "text")

    return find


def recaller(config: Config, facts: DataFrame, embed: Callable[[Column], Column]) -> Step:
    """A function of (query_id, query) that gives the active facts near to it: query_id, rank, fact_object and content."""

    def find(asked: DataFrame) -> DataFrame:
        hits = memory.recall(asked.select("query_id", embed(F.col("query")).alias("vector")), facts, config.recall_k)
        return memory.recalled(hits, facts).select("query_id", "rank", "fact_object", "content")

    return find


def finalizer(say: Say, most: int = 24_000) -> Callable[[Column, Column], Column]:
    """An answer of a question and its tool events (array<struct<step_index, tool, args, ok, observation>>) by a model that sees no more."""

    def answer(question: Column, events: Column) -> Column:
        user = F.concat(F.lit("Question:\n"), question, F.lit("\n\nTool observations:\n"), messages.tiered(events, most), F.lit("\n\nReturn only the answer span."))
        return F.trim(F.coalesce(say(F.lit("Answer from the tool observations alone."), user), F.lit("")))

    return answer


def turn_agent(config: Config, say: Say, retrieve: Step, recall: Step, generate: Step) -> Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]:
    """A function of turns (query_id, message) that gives their answers and the facts they teach."""
    learn = lambda turns: memory.extract(turns, say)
    return lambda turns: agent.turn(turns, say, recall, retrieve, generate, learn)


def tool_agent(config: Config, say: Say, retrieve: Step, recall: Step, more: list[agent.Tool] = ()) -> Callable[[DataFrame], DataFrame]:
    """A function of tasks (task_id, question) that runs them with documents, memory and arithmetic, and answers from what the tools found."""

    def read(calls: DataFrame) -> DataFrame:
        asked = calls.select(F.col("task_id").alias("query_id"), F.get_json_object("args", "$.query").alias("query"))
        found = memory.block(recall(asked)).withColumnRenamed("query_id", "task_id")
        return calls.select("task_id").join(found, "task_id", "left").select("task_id", F.coalesce("memory", F.lit("no relevant memories found")).alias("content"))

    registry = agent.Registry().register(agent.retriever(retrieve)).register(agent.calculator())
    registry.register(agent.Tool("read_memory", "Recalls facts about the user.", {"query": ("str", True, "what to recall"), "k": ("int", False, "how many")}, read))
    for t in more:
        registry.register(t)
    system = F.lit("Decide the next single action. Return only JSON: tool and args, or plan, or final_answer.\n" + registry.render())

    def decide(live: DataFrame) -> DataFrame:
        steps = F.to_json(F.transform("log", lambda s: F.struct(*[s[k].alias(k) for k in ("step_index", "tool", "args", "observation")])))
        user = F.concat(F.lit("User request:\n"), F.col("question"), F.lit("\n\nPlan:\n"), F.array_join("plan", "\n"), F.lit("\n\nSteps:\n"), steps)
        return live.withColumn("raw", say(system, user))

    def run(tasks: DataFrame) -> DataFrame:
        ends = agent.converse(tasks, decide, registry, config.max_steps, config.max_tool_calls)
        events = F.filter("log", lambda s: s["tool"].isNotNull())
        return ends.withColumn("answer", finalizer(say)(F.col("question"), events))

    return run


def final_only() -> Step:
    """A policy that answers at once: a baseline without tools."""
    return lambda live: live.withColumns({"tool": F.lit(None).cast("string"), "query": F.lit(None).cast("string"), "final": F.lit(True), "parse_error": F.lit(False)})


RETRIEVE = episodes.RETRIEVE
