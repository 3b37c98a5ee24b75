"""Agent episodes as tables of steps: rewards, duplicates, behaviour audits and selection.

A step is a row of task_id, step (from 0), tool (null for none), final (boolean), call_key (what was called, as text),
parse_error (boolean), ok (boolean), evidence (array of ids that it brought).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
REWARDS = {"task_success": 1.0, "evidence_coverage": 0.30, "valid_action_format": 0.0, "tool_call_cost": -0.02, "invalid_action": -0.10, "duplicate_call": -0.10, "premature_final_answer": -0.30, "budget_exhausted": -0.30}
RETRIEVE = "retrieve_docs"


def _order(upto: int = 0):
    w = Window.partitionBy("task_id").orderBy("step")
    return w.rowsBetween(Window.unboundedPreceding, upto)


def rescore(steps: DataFrame, tools: list[str], max_steps: int, rewards: dict[str, float] = REWARDS) -> DataFrame:
    """steps with one column a reward component and `reward`; gold (array) and correct (boolean) stand in steps.

    A call that its episode made before is a duplicate and costs no call; a failed call costs a call and is invalid; a
    final answer earns coverage and, complete and right, success; the last allowed step, unless final, exhausts the budget.
    """
    same = Window.partitionBy("task_id", "call_key").orderBy("step")
    allowed = F.coalesce(F.col("tool").isin(*tools), F.lit(False)) & ~F.col("parse_error")
    final = F.col("final") & ~F.col("parse_error")
    df = steps.withColumn("_call", allowed & ~final)
    df = df.withColumn("_dup", F.col("_call") & (F.sum(F.col("_call").cast("int")).over(same) > 1))
    df = df.withColumn("_seen", F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_call") & ~F.col("_dup") & F.col("ok"), F.col("evidence")).otherwise(F.array().cast("array<string>"))).over(_order()))))
    gold = F.array_distinct("gold")
    share = F.when(F.size(gold) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(gold, F.col("_seen"))), F.size(gold)))
    r = {k: F.lit(v) for k, v in rewards.items()}
    pay = lambda cond, what: F.when(cond, what).otherwise(0.0)
    new = {
        "task_success": pay(final & F.col("correct") & (share >= 1.0), r["task_success"]),
        "evidence_coverage": pay(final & (F.size(gold) > 0), r["evidence_coverage"] * share),
        "valid_action_format": pay(~F.col("parse_error"), r["valid_action_format"]),
        "tool_call_cost": pay(F.col("_call") & ~F.col("_dup"), r["tool_call_cost"]),
        "invalid_action": pay((~final & ~F.col("_call")) | (F.col("_call") & ~F.col("_dup") & ~F.col("ok")), r["invalid_action"]),
        "duplicate_call": pay(F.col("_dup"), r["duplicate_call"]),
        "premature_final_answer": pay(final & (F.size(gold) > 0) & (share < 1.0), r["premature_final_answer"]),
        "budget_exhausted": pay(~final & (F.col("step") + 1 >= max_steps), r["budget_exhausted"]),
    }
    total = F.lit(0.0)
    for k in new:
        total = total + F.col(k)
    df = df.withColumns(new).withColumn("reward", total)
    return df.withColumn("seen", F.array_sort("_seen")).drop("_call", "_dup", "_seen")


def duplicates(steps: DataFrame) -> DataFrame:
    """steps with is_duplicate, and run: how many equal calls in a row end here (islands by the difference of two numberings)."""
    again = F.row_number().over(Window.partitionBy("task_id", "call_key").orderBy("step"))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("step"))
    df = steps.withColumns({"is_duplicate": (again > 1), "_island": place - again})
    return df.withColumn("run", F.row_number().over(Window.partitionBy("task_id", "call_key", "_island").orderBy("step"))).drop("_island")


def history(turns: DataFrame, n: int = 6, by: str = "conv_id", order: str = "turn", said: Column | None = None) -> DataFrame:
    """turns with the n before each, joined by newlines."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-n, -1)
    line = said if said is not None else F.concat_ws(": ", "role", "text")
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n"))


def aggregate(rollouts: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: episode counts, means and rates of endpoint quality and controller behaviour.

    rollouts: task_id, total_reward, joint_success, stop_reason, finalizer_error, answer; steps with the reward components.
    """
    of = steps.agg(F.count("*").alias("n_decisions"), F.sum((F.coalesce("tool", F.lit("")) != "").cast("int")).alias("n_tool_calls"), F.sum((F.col("parse_error") | (F.col("invalid_action") < 0)).cast("int")).alias("bad"), F.sum((F.col("duplicate_call") < 0).cast("int")).alias("dup")).first()
    calls, n = F.lit(of["n_tool_calls"] or 0), F.count("*")
    joint = F.sum((F.col("joint_success") >= 1).cast("int"))
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return rollouts.agg(
        n.alias("n_tasks"),
        F.lit(of["n_decisions"]).alias("n_decisions"),
        calls.cast("long").alias("n_tool_calls"),
        F.coalesce(joint, F.lit(0)).alias("n_joint_successes"),
        F.coalesce(F.avg("total_reward"), F.lit(0.0)).alias("mean_return"),
        F.lit((of["bad"] or 0) / max(of["n_decisions"], 1)).alias("invalid_action_rate"),
        F.lit((of["dup"] or 0) / max(of["n_decisions"], 1)).alias("duplicate_call_rate"),
        (calls / F.greatest(n, F.lit(1))).alias("mean_tool_calls"),
        F.try_divide(calls, F.when(joint > 0, joint)).alias("calls_per_joint_success"),
        rate(F.col("stop_reason") == "budget").alias("budget_stop_rate"),
        rate(F.coalesce("finalizer_error", F.lit("")) != "").alias("finalizer_error_rate"),
        rate(F.trim("answer") == "INSUFFICIENT_EVIDENCE").alias("abstain_rate"),
    )


def retrieval_buckets(steps: DataFrame) -> DataFrame:
    """bucket (0 to 3, 4+), episodes and proportion by retrieval attempts an episode."""
    calls = steps.groupBy("task_id").agg(F.sum((F.coalesce("tool", F.lit("")) == RETRIEVE).cast("int")).alias("n"))
    by = calls.groupBy(F.when(F.col("n") < 4, F.col("n").cast("string")).otherwise("4+").alias("bucket")).agg(F.count("*").alias("episodes"))
    total = calls.count()
    return by.withColumn("proportion", F.col("episodes") / F.lit(max(total, 1)))


def actions(steps: DataFrame) -> DataFrame:
    """action and its count: tools, final_answer, invalid_json_action, unsupported_tool:x."""
    tool = F.coalesce("tool", F.lit(""))
    name = F.when(F.col("parse_error"), "invalid_json_action").when(~tool.isin("", RETRIEVE), F.concat(F.lit("unsupported_tool:"), tool)).when(tool == RETRIEVE, tool).otherwise("final_answer")
    return steps.groupBy(name.alias("action")).agg(F.count("*").alias("n"))


def _retrieves() -> Column:
    return F.coalesce("tool", F.lit("")) == RETRIEVE


def recovery(steps: DataFrame, joint: DataFrame | None = None) -> DataFrame:
    """kind (empty, failed, duplicate), exposures, later actions, recoveries and their rate: what follows a retrieval that brought nothing.

    Recovered: a later successful retrieval of the episode brings an id that was not seen by then. With joint (task_id, joint_success)
    also how many of the recovered episodes end in success, and that rate. Rates are null without exposures.
    """
    none = F.array().cast("array<string>")
    df = steps.withColumn("_seen", F.array_distinct(F.flatten(F.collect_list(F.when(_retrieves(), F.col("evidence")).otherwise(none)).over(_order(-1)))))
    later = Window.partitionBy("task_id").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("_next", F.array_distinct(F.flatten(F.collect_list(F.when(_retrieves() & F.col("ok"), F.col("evidence")).otherwise(none)).over(later))))
    df = df.withColumn("_more", F.count("*").over(later) > 0).filter(_retrieves())
    kind = F.when(F.col("duplicate_call") < 0, "duplicate").when(~F.col("ok"), "failed").when(F.size("evidence") == 0, "empty")
    hit = F.size(F.array_except("_next", "_seen")) > 0
    df = df.withColumn("kind", kind).filter("kind IS NOT NULL")
    total = lambda c: F.sum(c.cast("int"))
    made = [F.count("*").alias("exposures"), total(F.col("_more")).alias("later_actions"), total(hit).alias("recovered")]
    if joint is None:
        return df.groupBy("kind").agg(*made).withColumn("rate", F.try_divide("recovered", "exposures"))
    df = df.join(joint.select("task_id", F.col("joint_success").alias("_joint")), "task_id", "left")
    out = df.groupBy("kind").agg(*made, total(hit & F.coalesce(F.col("_joint") >= 1, F.lit(False))).alias("recovered_joint"))
    return out.withColumns({"rate": F.try_divide("recovered", "exposures"), "joint_rate": F.try_divide("recovered_joint", "exposures")})


def features(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """task_id and what an episode counts for a paired comparison of behaviour: episode, decisions, retrieval, premature, budget, json_invalid,
    unsupported, duplicate, and whether it made 0, 1, 2, 3 or more retrievals. steps: scored; ends: task_id, stop_reason."""
    tool = F.coalesce("tool", F.lit(""))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    by = steps.groupBy("task_id").agg(
        F.count("*").alias("decisions"),
        count(tool == RETRIEVE).alias("retrieval"),
        F.max((F.col("premature_final_answer") < 0).cast("int")).alias("premature"),
        count(F.col("parse_error")).alias("json_invalid"),
        count(~tool.isin("", RETRIEVE)).alias("unsupported"),
        count(F.col("duplicate_call") < 0).alias("duplicate"),
    )
    n = F.col("retrieval")
    calls = {f"retrieval{i}": (n == i).cast("int") for i in range(4)} | {"retrieval4plus": (n >= 4).cast("int")}
    return by.join(ends.select("task_id", (F.coalesce(F.col("stop_reason"), F.lit("")) == "budget").cast("int").alias("budget")), "task_id").withColumns({"episode": F.lit(1), **calls})


#: Name, numerator and denominator of the measures of a paired comparison of behaviour. Fixed values.
PAIRED = [
    ("MeanRetrievalCalls", "retrieval", "episode"),
    ("PrematureStopRate", "premature", "episode"),
    ("BudgetExhaustionRate", "budget", "episode"),
    ("JSONInvalidRate", "json_invalid", "decisions"),
    ("UnsupportedToolActionRate", "unsupported", "decisions"),
    ("DuplicateCallRatePerDecision", "duplicate", "decisions"),
    ("Retrieval0Rate", "retrieval0", "episode"),
    ("Retrieval1Rate", "retrieval1", "episode"),
    ("Retrieval2Rate", "retrieval2", "episode"),
    ("Retrieval3Rate", "retrieval3", "episode"),
    ("Retrieval4PlusRate", "retrieval4plus", "episode"),
]


def paired(base: DataFrame, other: DataFrame) -> DataFrame:
    """task_id, metric, base_n, base_d, other_n and other_d of two runs' features, for comparison.ratios and comparison.bootstrap."""
    both = base.alias("b").join(other.alias("o"), "task_id")
    of = lambda side, c, name: F.col(f"{side}.{c}").cast("double").alias(name)
    each = [F.struct(F.lit(m).alias("metric"), of("b", n, "base_n"), of("b", d, "base_d"), of("o", n, "other_n"), of("o", d, "other_d")) for m, n, d in PAIRED]
    return both.select("task_id", F.inline(F.array(*each)))


def behaviour(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """One row of counts and rates over all episodes; rates are null where nothing could have happened."""
    f = features(steps, ends)
    total = lambda c: F.sum(c)
    share = lambda a, b: F.try_divide(total(a), F.when(total(b) > 0, total(b)))
    stops = ends.select("task_id", (F.coalesce(F.col("stop_reason"), F.lit("")) == "final_answer").cast("int").alias("explicit"))
    return f.join(stops, "task_id").agg(
        F.count("*").alias("n_episodes"),
        F.coalesce(total("decisions"), F.lit(0)).alias("n_decisions"),
        share("retrieval", "episode").alias("mean_retrieval_calls"),
        share("json_invalid", "decisions").alias("json_invalid_rate"),
        F.coalesce(total("unsupported"), F.lit(0)).alias("unsupported_tool_action_count"),
        share("unsupported", "decisions").alias("unsupported_tool_action_rate"),
        share("premature", "episode").alias("premature_stop_rate"),
        share("duplicate", "decisions").alias("duplicate_call_rate_per_decision"),
        share("duplicate", "retrieval").alias("duplicate_call_rate_per_retrieval_attempt"),
        share("budget", "episode").alias("budget_exhaustion_rate"),
        share("explicit", "episode").alias("explicit_stop_rate"),
    )


def after_two(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """One row: episodes whose first decision after two retrievals found the evidence incomplete, and how many of them stop, go on, go on and
    complete it or succeed, or do something invalid. steps: with gold; ends: task_id, complete, joint_success."""
    df = steps.withColumn("_calls", F.coalesce(F.sum(_retrieves().cast("int")).over(_order(-1)), F.lit(0)))
    df = df.withColumn("_seen", F.flatten(F.collect_list("evidence").over(_order(-1)))).filter("_calls = 2")
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy("task_id").orderBy("step"))).filter("_n = 1")
    first = first.filter((F.size("gold") > 0) & (F.size(F.array_except("gold", "_seen")) > 0)).join(ends.select("task_id", "complete", "joint_success"), "task_id", "left")
    stop, go = F.col("final") & ~F.col("parse_error"), _retrieves() & ~F.col("parse_error")
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0))
    return first.agg(
        F.count("*").alias("opportunities"),
        n(stop).alias("stops"),
        n(~stop & go).alias("continues"),
        n(~stop & go & (F.col("complete") >= 1)).alias("then_complete"),
        n(~stop & go & (F.col("joint_success") >= 1)).alias("then_joint"),
        n(~stop & ~go).alias("invalid"),
    )


def candidate_actions(steps: DataFrame, by: list[str]) -> DataFrame:
    """by and a map of actions to how often a candidate took each."""
    tool = F.coalesce("tool", F.lit(""))
    name = F.when(F.col("parse_error"), "invalid_json_action").when(tool != "", tool).otherwise("final_answer")
    counts = steps.groupBy(*by, name.alias("action")).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("action_counts"))


def accumulate(items: DataFrame, key: list[str], order: list[str], by: str = "task_id") -> DataFrame:
    """items without those whose key their episode has had before, by order: what successful tools brought, each once."""
    w = Window.partitionBy(by, *key).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stopping(steps: DataFrame) -> DataFrame:
    """calls (1 to 4), complete (evidence so far), opportunities, stops, continues, invalid and stop_rate.

    An opportunity is an episode's first decision after that many retrieval attempts. steps: with gold.
    """
    is_call = (F.coalesce("tool", F.lit("")) == RETRIEVE).cast("int")
    df = steps.withColumn("calls", F.coalesce(F.sum(is_call).over(_order(-1)), F.lit(0)))
    df = df.withColumn("_seen", F.flatten(F.collect_list("evidence").over(_order(-1))))
    df = df.withColumn("complete", F.size(F.array_except("gold", "_seen")) == 0).filter("calls BETWEEN 1 AND 4")
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy("task_id", "calls").orderBy("step"))).filter("_n = 1")
    stop, go = F.col("final") & ~F.col("parse_error"), F.coalesce("tool", F.lit("")) == RETRIEVE
    out = first.groupBy("calls", "complete").agg(F.count("*").alias("opportunities"), F.sum(stop.cast("int")).alias("stops"), F.sum((go & ~stop).cast("int")).alias("continues"), F.sum((~stop & ~go).cast("int")).alias("invalid"))
    return out.withColumn("stop_rate", F.try_divide("stops", "opportunities"))


QUALITY = ["clean", "complete_evidence", "joint_success", "answer_em", "sentence_recall", "document_recall", "answer_f1", "explicit_stop", "neg_calls", "neg_decisions"]


def best_of(candidates: DataFrame, by: str = "task_id", index: str = "candidate", keys: list[str] = QUALITY) -> DataFrame:
    """The candidate of each task with the greatest tuple of keys; ties go to the lowest index."""
    return candidates.groupBy(by).agg(F.max_by(index, F.struct(*keys, (-F.col(index)).alias("_i"))).alias("selected"))


def early_stop(candidates: DataFrame, good: Column, by: str = "task_id", index: str = "candidate") -> DataFrame:
    """Candidates up to a task's first good one, all where there is none."""
    first = F.min(F.when(good, F.col(index))).over(Window.partitionBy(by))
    return candidates.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col(index) <= F.col("_first"))).drop("_first")
