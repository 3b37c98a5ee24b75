"""Runs of frozen tasks (see operators.benchmark): a single pass by route and a loop by script, over the tasks' own documents and facts.

Besides the tasks: documents (task_id, place, doc_id, match_terms, text), facts (task_id, id, fact_object, fact_content, state), and for the
loop a script (task_id, step, raw). A task may have write_fact, the content that learning from it gives, and route, a struct of use_docs,
use_memory and write_memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import normalise_compat
from tidemill.operators import benchmark, episodes, verification

from . import agent


def _listed(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("x"))))
    return df.groupBy("task_id").agg(F.transform(rows, lambda r: r["x"]).alias(name))


def _found(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """task_id and docs of queries (task_id, query), in order of their match."""
    hits = verification.recording_search(asked.withColumn("query_id", F.col("task_id")), documents.select("task_id", "place", "doc_id", "match_terms"))
    return _listed(hits, "rank", "doc_id", "docs")


def _recalled(asked: DataFrame, facts: DataFrame, k: int = 5) -> DataFrame:
    hits = verification.audit_search(asked.withColumn("query_id", F.col("task_id")), facts, k)
    return _listed(hits.join(facts.select("task_id", "id", "fact_content"), ["task_id", "id"]), "rank", "fact_content", "memories")


def _memory_after(tasks: DataFrame, facts: DataFrame, wrote: Column) -> DataFrame:
    """task_id and memory_after: the active facts, and what was learnt if nothing like it was there."""
    held = _listed(facts.filter("state = 'ACTIVE'"), "id", "fact_content", "held")
    same = facts.filter("state = 'ACTIVE'").select("task_id", normalise_compat(F.col("fact_content")).alias("_k")).distinct()
    learnt = tasks.filter(wrote & F.col("write_fact").isNotNull()).select("task_id", F.col("write_fact").alias("new"), normalise_compat(F.col("write_fact")).alias("_k")).join(same, ["task_id", "_k"], "left_anti").select("task_id", "new")
    none = F.array().cast("array<string>")
    return tasks.select("task_id").join(held, "task_id", "left").join(learnt, "task_id", "left").select("task_id", F.concat(F.coalesce("held", none), F.when(F.col("new").isNotNull(), F.array("new")).otherwise(none)).alias("memory_after"))


def baseline(tasks: DataFrame, documents: DataFrame, facts: DataFrame) -> DataFrame:
    """A run of each enabled task by its route: memory is read, then documents, then memory written, once each."""
    on = tasks.filter(F.coalesce("enabled", F.lit(True)))
    r, none = F.col("route"), F.array().cast("array<string>")
    asked = lambda flag: on.filter(flag).select("task_id", F.col("question").alias("query"))
    docs, memories = _found(asked(r["use_docs"]), documents), _recalled(asked(r["use_memory"]), facts)
    df = on.select("task_id", agent.route_tools(r["use_docs"], r["use_memory"], r["write_memory"]).alias("called"))
    df = df.join(docs, "task_id", "left").join(memories, "task_id", "left").join(_memory_after(on, facts, r["write_memory"]), "task_id")
    runs = df.withColumns({"docs": F.coalesce("docs", none), "memories": F.coalesce("memories", none), "calculations": none, "artifacts": none, "tool_calls": F.size("called"), "steps": F.lit(1), "stop_reason": F.lit("single_pass"), "agent": F.lit("baseline")})
    runs = runs.withColumns({c: F.lit(0) for c in ("failed_tool_calls", "parse_failures")} | {c: F.lit(1) for c in ("decision_calls", "generation_calls")})
    return benchmark.oracle_answers(on, runs)


def _tools(documents: DataFrame, facts: DataFrame) -> agent.Registry:
    def retrieve(calls: DataFrame) -> DataFrame:
        asked = calls.select("task_id", F.trim(F.coalesce(F.get_json_object("args", "$.query"), F.lit(""))).alias("query"))
        out = asked.join(_found(asked.filter("query <> ''"), documents), "task_id", "left")
        ids = F.coalesce("docs", F.array().cast("array<string>"))
        ok = F.col("query") != ""
        return out.select("task_id", ok.alias("ok"), F.array_join(ids, "\n").alias("content"), F.when(~ok, "empty query").alias("error"), ids.alias("evidence"))

    def read(calls: DataFrame) -> DataFrame:
        asked = calls.select("task_id", F.trim(F.coalesce(F.get_json_object("args", "$.query"), F.lit(""))).alias("query"))
        out = asked.join(_recalled(asked.filter("query <> ''"), facts), "task_id", "left")
        ok = F.col("query") != ""
        return out.select("task_id", ok.alias("ok"), F.coalesce(F.array_join("memories", "\n"), F.lit("no relevant memories found")).alias("content"), F.when(~ok, "empty query").alias("error"))

    def write(calls: DataFrame) -> DataFrame:
        return calls.select("task_id", F.lit(True).alias("ok"), F.lit("memory merged").alias("content"))

    query = {"query": ("str", True, "a query that stands alone"), "k": ("int", False, "how many")}
    registry = agent.Registry()
    registry.register(agent.Tool(episodes.RETRIEVE, "Searches the documents.", query, retrieve))
    registry.register(agent.Tool("read_memory", "Recalls facts about the user.", query, read))
    registry.register(agent.Tool("write_memory", "Learns facts from a text.", {"text": ("str", False, "what to learn from")}, write))
    return registry.register(agent.calculator())


def loop(tasks: DataFrame, script: DataFrame, documents: DataFrame, facts: DataFrame, more: list[agent.Tool] = (), max_steps: int = 8, max_tool_calls: int = 8) -> DataFrame:
    """A run of each enabled task by its script; more: tools beside those for documents, memory and arithmetic."""
    on = tasks.filter(F.coalesce("enabled", F.lit(True)))
    registry = _tools(documents, facts)
    for t in more:
        registry.register(t)
    ends = agent.converse(on.select("task_id", "question"), agent.from_script(script), registry, max_steps, max_tool_calls)
    log, none = F.col("log"), F.array().cast("array<string>")
    done = lambda *names: F.transform(F.filter(log, lambda s: s["ok"] & F.coalesce(s["tool"].isin(*names), F.lit(False))), lambda s: s["observation"])
    facts_of = F.filter(F.flatten(F.transform(done("read_memory"), lambda o: F.split(o, "\n"))), lambda x: x != "no relevant memories found")
    kept = F.filter(log, lambda s: s["ok"] & s["tool"].isNotNull() & (s["tool"] != "write_memory"))
    df = ends.select(
        "task_id",
        agent.called(log).alias("called"),
        F.col("evidence").alias("docs"),
        F.array_distinct(facts_of).alias("memories"),
        done("calculator").alias("calculations"),
        F.transform(kept, lambda s: s["observation"]).alias("artifacts"),
        F.exists(log, lambda s: s["ok"] & F.coalesce(s["tool"] == "write_memory", F.lit(False))).alias("wrote"),
        F.size(F.filter(log, lambda s: s["tool"].isNotNull() & ~s["ok"])).alias("failed_tool_calls"),
        F.size(F.filter(log, lambda s: F.coalesce(s["error"] == agent.SAYS["invalid"][1], F.lit(False)))).alias("parse_failures"),
        F.size(log).alias("steps"),
        F.size(agent.called(log)).alias("tool_calls"),
        F.size(log).alias("decision_calls"),
        F.lit(1).alias("generation_calls"),
        "stop_reason",
        F.lit("loop").alias("agent"),
    )
    after = _memory_after(on.join(df.select("task_id", "wrote"), "task_id"), facts, F.col("wrote"))
    runs = df.drop("wrote").join(after, "task_id").withColumn("docs", F.coalesce("docs", none))
    return benchmark.oracle_answers(on, runs)
