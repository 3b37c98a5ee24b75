"""Frozen agent tasks as tables: their validation, the evidence gate, the score of a run and summaries by cohort.

A task is a row of task_id, cohort, enabled, skip_reason, question, category, required_docs, required_memory, required_calculations,
required_artifacts, no_documents, memory_after, memory_after_count, tool_counts (map), tool_sequence, failed_tool_calls, parse_failures
and answer struct<kind, value, values, forbidden, patterns, gold>; what a task does not ask is null or empty. A run is a row of task_id,
agent, answer, called, docs, memories, calculations, artifacts (texts), memory_after, failed_tool_calls, parse_failures, steps, tool_calls,
decision_calls, generation_calls and stop_reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import within

from . import evaluation, verification

# Fixed values.
COHORTS = ["shared_core", "extended_tools", "robustness", "reserved"]
BASELINE_TOOLS = ["retrieve_docs", "read_memory", "write_memory"]
LOOP_TOOLS = [*BASELINE_TOOLS, "calculator", "glob_files", "grep_text", "read_file"]
REFUSAL = "无法根据现有工具结果回答。"


def rejects(tasks: DataFrame, documents: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """task_id and reason of tasks that are not fit for use; documents: task_id, doc_id; files: task_id, path, content.

    Ids are filled and their own, cohorts known; a task that is not enabled is reserved and says why; an enabled one has a question, a route,
    a script, counts of tools that are not below 0 and an answer rule of a known kind with a gold answer; document ids are filled and
    distinct in a task, paths stay inside.
    """
    has = lambda c: F.col(c) if c in tasks.columns else F.lit(None).cast("string")
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    twice = tasks.groupBy(F.col("task_id").alias("_id")).agg(F.count("*").alias("_n"))
    on = F.coalesce("enabled", F.lit(True))
    counts, rule = F.col("tool_counts"), F.col("answer")
    # reasons are fixed values
    checks = [
        (blank(F.col("task_id")) | (F.col("_n") > 1), "missing or duplicate id"),
        (~F.coalesce(F.col("cohort").isin(*COHORTS), F.lit(False)), "invalid cohort"),
        (~on & ((F.col("cohort") != "reserved") | blank(has("skip_reason"))), "disabled tasks must be reserved with skip_reason"),
        (on & blank(F.col("question")), "question is required"),
        (on & F.lit("route" in tasks.columns) & has("route").isNull(), "baseline_route is required"),
        (on & F.lit("script" in tasks.columns) & (F.coalesce(F.size("script") if "script" in tasks.columns else F.lit(1), F.lit(0)) < 1), "loop_script is required"),
        (on & (counts.isNull() | F.exists(F.map_values(counts), lambda n: n.isNull() | (n < 0))), "expected.tool_counts must contain non-negative integers"),
        (on & ~F.coalesce(rule["kind"].isin(*evaluation.KINDS), F.lit(False)), "unsupported answer rule"),
        (on & blank(rule["gold"]), "expected.answer.gold is required"),
    ]
    reason = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        reason = F.when(F.coalesce(bad, F.lit(False)), why).otherwise(reason)
    out = tasks.join(twice, F.col("task_id").eqNullSafe(F.col("_id"))).select("task_id", reason.alias("reason"))
    out = out.filter("reason IS NOT NULL").distinct()
    if documents is not None:
        per = documents.groupBy("task_id", "doc_id").agg(F.count("*").alias("n"))
        out = out.union(per.filter((F.col("n") > 1) | blank(F.col("doc_id"))).select("task_id", F.lit("document ids must be non-empty and unique")).distinct())
    if files is not None:
        outside = blank(F.col("path")) | F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..") | F.col("content").isNull()
        out = out.union(files.filter(outside).select("task_id", F.lit("invalid workspace fixture path/content")).distinct())
    return out


def _all_within(required: Column, texts: Column) -> Column:
    """Whether each required string stands in one of the texts, both made alike."""
    return F.forall(within(texts, required), lambda x: x)


def _joined(texts: Column) -> Column:
    return F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "\n")


def evidence(tasks_and_runs: DataFrame) -> DataFrame:
    """With columns docs_ok, memory_ok, calculations_ok, artifacts_ok and evidence: whether a run has what its task requires."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(c, none)
    parts = {
        "docs_ok": F.size(F.array_except(listed("required_docs"), listed("docs"))) == 0,
        "memory_ok": _all_within(F.col("required_memory"), F.col("memories")),
        "calculations_ok": verification.decimals_within(listed("calculations"), listed("required_calculations")),
        "artifacts_ok": _all_within(F.col("required_artifacts"), F.array(_joined(F.col("artifacts")))),
    }
    clear = ~F.coalesce("no_documents", F.lit(False)) | (F.size(listed("docs")) == 0)
    df = tasks_and_runs.withColumns(parts)
    return df.withColumn("evidence", F.col("docs_ok") & F.col("memory_ok") & F.col("calculations_ok") & F.col("artifacts_ok") & clear)


def oracle_answers(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """runs with the gold answer where the evidence is complete, else a refusal: a test of orchestration, not of answers."""
    df = evidence(runs.drop("answer").join(tasks.select("task_id", F.col("answer.gold").alias("_gold"), "required_docs", "required_memory", "required_calculations", "required_artifacts", "no_documents"), "task_id"))
    return df.select(*[c for c in runs.columns if c != "answer"], F.when(F.col("evidence"), F.col("_gold")).otherwise(REFUSAL).alias("answer"))


def score(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """A record of each run: its judgements, tool precision, recall and exactness, state of memory, recovery, capability and success."""
    none, rule = F.array().cast("array<string>"), F.col("rule")
    df = evidence(runs.withColumnsRenamed({"memory_after": "actual_memory", "failed_tool_calls": "failed", "parse_failures": "unparsed"}).join(tasks.withColumnRenamed("answer", "rule"), "task_id"))
    df = df.withColumn("answer_ok", evaluation.judge(F.col("answer"), rule["kind"], F.coalesce(rule["value"], rule["gold"]), F.coalesce(rule["values"], none), F.coalesce(rule["forbidden"], none), F.coalesce(rule["patterns"], none)))
    wanted = F.map_filter("tool_counts", lambda k, n: n > 0)
    called = F.coalesce("called", none)
    times = lambda k: F.size(F.filter(called, lambda c: c == k))
    common = F.aggregate(F.map_entries(wanted), F.lit(0), lambda a, e: a + F.least(times(e["key"]), e["value"].cast("int")))
    total = F.aggregate(F.map_values(wanted), F.lit(0), lambda a, n: a + n.cast("int"))
    none_at_all = (total == 0) & (F.size(called) == 0)
    share = lambda n: F.when(none_at_all, 1.0).otherwise(F.coalesce(F.try_divide(common, n), F.lit(0.0)))
    known = F.when(F.col("agent") == "baseline", F.array(*map(F.lit, BASELINE_TOOLS))).otherwise(F.array(*map(F.lit, LOOP_TOOLS)))
    same = lambda want, got: want.isNull() | (want == got)
    held = _all_within(F.col("memory_after"), F.col("actual_memory")) & same(F.col("memory_after_count"), F.size(F.coalesce("actual_memory", none)))
    df = df.withColumns(
        {
            "tool_precision": share(F.size(called)),
            "tool_recall": share(total),
            "tool_exact": (common == total) & (F.size(called) == total),
            "sequence_exact": F.when(F.col("tool_sequence").isNotNull(), called == F.col("tool_sequence")),
            "state_ok": held,
            "state_case": (F.size(F.coalesce("memory_after", none)) > 0) | F.col("memory_after_count").isNotNull(),
            "recovery_ok": same(F.col("failed_tool_calls"), F.col("failed")) & same(F.col("parse_failures"), F.col("unparsed")),
            "recovery_case": F.col("failed_tool_calls").isNotNull() | F.col("parse_failures").isNotNull(),
            "capability": verification.capability(F.map_keys(wanted), known),
            "refusal_case": rule["kind"] == "refusal",
        }
    )
    success = F.col("answer_ok") & F.col("tool_exact") & F.coalesce("sequence_exact", F.lit(True)) & F.col("evidence") & F.col("state_ok") & F.col("recovery_ok")
    names = ["task_id", "agent", "cohort", "answer_ok", "evidence", "tool_precision", "tool_recall", "tool_exact", "sequence_exact", "state_ok", "state_case", "recovery_ok", "recovery_case", "capability", "refusal_case"]
    return df.select(*names, success.alias("success"), "tool_calls", F.col("failed").alias("failed_tool_calls"), "steps", F.col("unparsed").alias("parse_failures"), "decision_calls", "stop_reason")


def summarise(records: DataFrame, *by: str) -> DataFrame:
    """by and the means over tasks; a mean over no case (sequences, states, refusals, recoveries) is null, any other mean of none 0."""
    mean = lambda c, n: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(n)
    of = lambda c, case, n: F.avg(F.when(case, F.col(c).cast("double"))).alias(n)
    number = lambda case, n: F.coalesce(F.sum(case.cast("int")), F.lit(0)).alias(n)
    sequence, state, recovery, refusal = F.col("sequence_exact").isNotNull(), F.col("state_case"), F.col("recovery_case"), F.col("refusal_case")
    return records.groupBy(*by).agg(
        F.count("*").alias("n_tasks"),
        mean("success", "task_success"),
        mean("answer_ok", "answer_accuracy"),
        mean("evidence", "evidence_accuracy"),
        mean("tool_precision", "tool_call_precision"),
        mean("tool_recall", "tool_call_recall"),
        mean("tool_exact", "tool_multiset_exact_match"),
        of("sequence_exact", sequence, "tool_sequence_exact_match"),
        number(sequence, "n_tool_sequence_tasks"),
        mean("capability", "capability_coverage"),
        of("state_ok", state, "memory_state_accuracy"),
        number(state, "n_memory_state_tasks"),
        of("answer_ok", refusal, "refusal_accuracy"),
        number(refusal, "n_refusal_tasks"),
        mean("tool_calls", "avg_tool_calls"),
        mean("failed_tool_calls", "avg_failed_tool_calls"),
        mean("steps", "avg_steps"),
        mean("decision_calls", "avg_decision_calls"),
        F.coalesce(F.try_divide(F.sum("parse_failures"), F.sum("steps")), F.lit(0.0)).alias("parse_failure_rate"),
        of("recovery_ok", recovery, "recovery_accuracy"),
        number(recovery, "n_recovery_tasks"),
    )


DELTAS = ["task_success", "answer_accuracy", "evidence_accuracy", "tool_call_precision", "tool_call_recall", "tool_multiset_exact_match", "avg_tool_calls", "avg_steps", "parse_failure_rate"]


def delta(records: DataFrame, cohort: str = "shared_core") -> DataFrame:
    """metric and delta: what the loop gains over the baseline on the main cohort; no row unless both have run."""
    by = summarise(records.filter(F.col("cohort") == cohort), "agent")
    each = by.select("agent", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in DELTAS])))
    got = lambda agent: F.max(F.when(F.col("agent") == agent, F.col("value")))
    return each.groupBy("metric").agg((got("loop") - got("baseline")).alias("delta")).filter("delta IS NOT NULL")


def stop_counts(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by, "stop_reason").agg(F.count("*").alias("n"))
