"""Training-side row transforms: gates, examples, advantages, losses and truncation."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .datasets import checkpoint


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that holds, else null."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(name)).otherwise(out)
    return out


FINAL = "final_answer"


def gate(episodes: DataFrame, least_success: float = 1.0, least_evidence: float = 1.0, clean_transitions: bool = True) -> DataFrame:
    """episodes with reject_reason, null for those to train on.

    episodes: task_id, decisions array<struct<raw, action, parse_error>>, transitions array<struct<step, action, duplicate, invalid, ok>>,
    success, evidence. An action is a tool's name or `final_answer`, null if it is no object and empty if it names neither. The earliest
    bad step decides, and within a step the order of its checks; a final answer needs no tool event.
    Decisions may also have system_prompt and user_prompt, transitions reward struct<invalid_action, duplicate_call>, where a number
    below 0 marks a bad step, and episodes verified, whether there is a verification at all; reasons that need them are not given without them.
    """
    d, t = F.col("decisions"), F.col("transitions")
    said = episodes.schema["decisions"].dataType.elementType.names
    rewarded = "reward" in episodes.schema["transitions"].dataType.elementType.names
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)

    def step_reason(x: Column, i: Column) -> Column:
        decided = F.try_element_at(d, i + 1)
        out = (
            F.when(x.isNull() | decided.isNull(), "invalid_transition")
            .when(~x["step"].eqNullSafe(i), "transition_step_mismatch")
            .when(x["action"].isNull() | ~x["action"].eqNullSafe(decided["action"]), "transition_action_mismatch")
        )
        invalid, duplicate = x["invalid"], x["duplicate"]
        if rewarded:
            r = [x["reward"][k].cast("double") for k in ("invalid_action", "duplicate_call")]
            out = out.when(x["reward"].isNull(), "missing_reward_breakdown").when(~number(r[0]) | ~number(r[1]), "invalid_reward_breakdown")
            invalid, duplicate = F.coalesce(invalid, F.lit(False)) | (r[0] < 0), F.coalesce(duplicate, F.lit(False)) | (r[1] < 0)
        return (
            out.when(invalid, "invalid_action_transition")
            .when(duplicate, "duplicate_call_transition")
            .when(x["action"] == FINAL, F.lit(None).cast("string"))
            .when(x["action"] == "", "invalid_transition_action")
            .when(x["ok"].isNull(), "missing_tool_event")
            .when(~x["ok"], "unsuccessful_tool_event")
        )

    blank = lambda c: c.isNull() | (F.trim(c) == "")
    incomplete = lambda x: functools.reduce(operator.or_, [blank(x[k]) for k in ("system_prompt", "user_prompt", "raw") if k in said], x["action"].isNull())
    bad_step = F.try_element_at(F.filter(F.transform(t, step_reason), lambda r: r.isNotNull()), F.lit(1))
    before = first_reason(
        [
            ("invalid_episode", F.col("task_id").isNull()),
            ("missing_decisions", F.coalesce(F.size(d), F.lit(0)) < 1),
            ("parse_error", F.exists(d, lambda x: x.isNull() | F.coalesce(x["parse_error"], F.lit(False)))),
            ("incomplete_decision", F.exists(d, incomplete)),
            *([("missing_transitions", t.isNull()), ("transition_count_mismatch", F.size(t) != F.size(d))] if clean_transitions else []),
        ]
    )
    after = first_reason(
        [
            *([("missing_verification", ~F.coalesce("verified", F.lit(False)))] if "verified" in episodes.columns else []),
            ("missing_success_metric", F.col("success").isNull() | F.isnan("success")),
            ("below_success_threshold", F.col("success") < least_success),
            ("missing_evidence_metric", F.col("evidence").isNull() | F.isnan("evidence")),
            ("below_evidence_threshold", F.col("evidence") < least_evidence),
        ]
    )
    return episodes.withColumn("reject_reason", F.coalesce(before, bad_step, after) if clean_transitions else F.coalesce(before, after))


def tool_event(history: Column, step: Column, tool: Column, args: Column) -> Column:
    """The last event of array<struct<step_index, tool, args, ...>> with this step, tool and arguments (as canonical text), else null."""
    same = lambda e: e["step_index"].eqNullSafe(step) & e["tool"].eqNullSafe(tool) & e["args"].eqNullSafe(args)
    return F.try_element_at(F.filter(history, same), F.lit(-1))


def clean(rollout_error: Column, stop_reason: Column, parse_errors: Column, rewards: Column) -> Column:
    """Whether an episode ended by its final answer without a finalizer's error, a parse error, or a negative invalid_action or duplicate_call.

    parse_errors: array<boolean>; rewards: array<struct<invalid_action, duplicate_call>>, nulls are 0.
    """
    quiet = F.coalesce(rollout_error, F.lit("")) == ""
    parsed = ~F.exists(parse_errors, lambda x: F.coalesce(x, F.lit(False)))
    paid = F.forall(rewards, lambda r: (F.coalesce(r["invalid_action"], F.lit(0.0)) >= 0) & (F.coalesce(r["duplicate_call"], F.lit(0.0)) >= 0))
    return quiet & F.coalesce(stop_reason == FINAL, F.lit(False)) & parsed & paid


def examples(episodes: DataFrame, repeat_before_final: int = 1) -> DataFrame:
    """task_id, step, replica and action of each decision; a tool call right before a final answer is repeated."""
    return _decisions(episodes, repeat_before_final).select("task_id", "step", "replica", F.col("d")["action"].alias("action"))


def _decisions(episodes: DataFrame, repeat: int) -> DataFrame:
    rows = episodes.withColumn("_all", F.col("decisions")).select(*[c for c in episodes.columns if c != "decisions"], "_all", F.posexplode("decisions").alias("step", "d"))
    final = lambda x: F.coalesce(x["action"] == FINAL, F.lit(False))
    before = ~final(F.col("d")) & (F.coalesce(F.col("d")["action"], F.lit("")) != "") & final(F.try_element_at(F.col("_all"), F.col("step") + 2))
    times = F.when(before, F.lit(repeat)).otherwise(1)
    return rows.withColumn("replica", F.explode(F.sequence(F.lit(0), times - 1))).drop("_all")


def messages(episodes: DataFrame, repeat_before_final: int = 1, form: str = "messages") -> DataFrame:
    """Training rows of kept episodes: task_id, step, replica, policy_version, action and messages, or prompt and response.

    episodes: as gate() has them, with system_prompt and user_prompt in decisions and policy_version. Gold answers are never read.
    """
    if form not in ("messages", "prompt_response"):
        raise ValueError("form is messages or prompt_response")
    d = F.col("d")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    asked = [turn("system", d["system_prompt"]), turn("user", d["user_prompt"])]
    body = [F.array(*asked, turn("assistant", d["raw"])).alias("messages")] if form == "messages" else [F.array(*asked).alias("prompt"), d["raw"].alias("response")]
    rows = _decisions(episodes.filter("reject_reason IS NULL"), repeat_before_final)
    return rows.select("task_id", "step", "replica", F.coalesce("policy_version", F.lit("unknown")).alias("policy_version"), d["action"].alias("action"), *body)


def report(gated: DataFrame, repeat_before_final: int = 1) -> DataFrame:
    """section, name and n: episodes seen, kept and filtered, decisions, examples, rejections by reason, kept episodes by policy, and
    decisions and examples by kind of action (tool, final_answer, other). One pass over episodes and one over kept decisions."""
    policy = F.coalesce("policy_version", F.lit("unknown")) if "policy_version" in gated.columns else F.lit("unknown")
    kept = F.col("reject_reason").isNull()
    of = lambda section, name, n=F.lit(1): F.struct(F.lit(section).alias("section"), name.alias("name"), n.cast("long").alias("n"))
    each = gated.select(
        F.inline(
            F.array_compact(
                F.array(
                    of("episodes", F.lit("seen")),
                    of("episodes", F.when(kept, "kept").otherwise("filtered")),
                    of("decisions", F.lit("seen"), F.greatest(F.coalesce(F.size("decisions"), F.lit(0)), F.lit(0))),
                    F.when(~kept, of("filter", F.col("reject_reason"))),
                    F.when(kept, of("policy", policy)),
                )
            )
        )
    )
    a = F.col("d")["action"]
    kind = F.when(a == FINAL, FINAL).when(F.coalesce(a, F.lit("")) != "", "tool").otherwise("other")
    rows = _decisions(gated.filter(kept).select("task_id", "decisions"), repeat_before_final)
    acted = rows.select(F.inline(F.array_compact(F.array(F.when(F.col("replica") == 0, of("base_action", kind)), of("output_action", kind), of("examples", F.when(F.col("replica") == 0, "base").otherwise("augmented"))))))
    return each.union(acted).groupBy("section", "name").agg(F.sum("n").alias("n"))


def advantages(rewards: DataFrame, by: str = "group_id", reward: str = "reward", epsilon: float = 1e-4, strict: bool = False) -> DataFrame:
    """rewards with advantage: distance from the group's mean in population deviations; 0 where those are below epsilon.

    strict: a group of fewer than two rewards, or with one that is not finite, fails the query.
    """
    if epsilon <= 0:
        raise ValueError("epsilon > 0")
    w = Window.partitionBy(by)
    mean, std = F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    out = F.when(std < epsilon, 0.0).otherwise((F.col(reward) - mean) / (std + epsilon))
    if strict:
        odd = F.col(reward).isNull() | F.isnan(reward) | (F.abs(reward) == math.inf)
        out = F.when(F.count("*").over(w) < 2, F.raise_error(F.lit("a group needs two rewards")).cast("double")).when(odd, F.raise_error(F.lit("rewards must be finite")).cast("double")).otherwise(out)
    return rewards.withColumn("advantage", out)


def component_means(parts: DataFrame, episodes: DataFrame, episode: str = "task_id") -> DataFrame:
    """key and mean over all episodes of an episode's sum of each key's finite values; a key that an episode lacks is 0.

    parts: episode, key, value of each step; episodes: episode.
    """
    n = episodes.select(episode).distinct().count()
    x = F.col("value").cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)
    return parts.groupBy("key").agg((F.sum(finite) / F.lit(max(n, 1))).alias("mean")).filter("mean IS NOT NULL")


def clipped_loss(tokens: DataFrame, epsilon: float = 0.2, beta: float = 0.04) -> DataFrame:
    """loss, mean_kl, mean_ratio, clip_fraction and n over tokens (logp, old_logp, ref_logp, advantage): one row."""
    ratio = F.exp(F.least(F.greatest(F.col("logp") - F.col("old_logp"), F.lit(-20.0)), F.lit(20.0)))
    clipped = F.least(F.greatest(ratio, F.lit(1 - epsilon)), F.lit(1 + epsilon))
    gap = F.least(F.greatest(F.col("ref_logp") - F.col("logp"), F.lit(-20.0)), F.lit(20.0))
    kl = F.exp(gap) - gap - 1
    a = F.col("advantage")
    return tokens.agg(
        F.avg(-F.least(ratio * a, clipped * a) + beta * kl).alias("loss"),
        F.avg(kl).alias("mean_kl"),
        F.avg(ratio).alias("mean_ratio"),
        F.avg((F.abs(ratio - 1) > epsilon).cast("double")).alias("clip_fraction"),
        F.count("*").alias("n"),
    )


def truncate(prompt: Column, answer: Column, most: int, head: int = 256, multiple: int = 8, pad: int = 0, strict: bool = False) -> Column:
    """struct<input_ids, labels>: the prompt's head and tail around what does not fit, -100 over the prompt and the padding.

    An answer that leaves no room is cut; if strict, it fails the query.
    """
    if strict:
        answer = F.when(F.size(answer) >= most, F.raise_error(F.lit("an answer leaves no room for its prompt")).cast("array<int>")).otherwise(answer)
    room = F.greatest(F.lit(0), F.lit(most) - F.size(answer))
    first = F.least(F.lit(head), room)
    tail = room - first
    cut = F.when(F.size(prompt) <= room, prompt).otherwise(F.concat(F.slice(prompt, F.lit(1), first), F.when(tail > 0, F.slice(prompt, -F.greatest(tail, F.lit(1)), F.greatest(tail, F.lit(1)))).otherwise(F.array().cast("array<int>"))))
    whole = F.slice(F.concat(cut, answer), F.lit(1), F.lit(most))
    fill = F.pmod(-F.size(whole), F.lit(multiple))
    ids = F.concat(whole, F.array_repeat(F.lit(pad), fill))
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(cut)), F.slice(answer, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.size(cut))), F.array_repeat(F.lit(-100), fill))
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))


def valid_chat(messages: Column) -> Column:
    """Whether the last of array<struct<role, content>> is the only assistant's, at least one is a user's, and all have content."""
    last = F.try_element_at(messages, F.lit(-1))["role"] == "assistant"
    one = F.size(F.filter(messages, lambda m: m["role"] == "assistant")) == 1
    full = F.forall(messages, lambda m: m["role"].isin("system", "user", "assistant") & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    return F.coalesce(last & one & F.exists(messages, lambda m: m["role"] == "user") & full, F.lit(False))


def wrapped_window(tasks: DataFrame, updates: int, size: int, n: int, index: str = "ord") -> DataFrame:
    """update, slot and the task of each slot: `size` tasks an update, in order, from the first again after the last."""
    spark = tasks.sparkSession
    slots = spark.range(updates).withColumnRenamed("id", "update").select("update", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    return slots.withColumn(index, F.pmod(F.col("update") * size + F.col("slot"), F.lit(n))).join(tasks, index)


def shuffled(tasks: DataFrame, seed: int, most: int | None = None, key: str = "task_id") -> DataFrame:
    """tasks with ord from 0: their order by a hash of seed and key, the same on every run and cluster, and at most so many.

    Ranks are found by range partitions and their offsets, not in one task.
    """
    mixed = tasks.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    return numbered(mixed, "_h", key, most=most).drop("_h")


def numbered(df: DataFrame, *order: str, name: str = "ord", most: int | None = None) -> DataFrame:
    """df with its place from 0 in a stated order: rows are dealt by ranges, counted, and numbered within each."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    rows = checkpoint(rows)
    sizes = {r[0]: r[1] for r in rows.groupBy("_part").count().collect()}  # one row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    at = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part")) if before else F.lit(0)
    w = Window.partitionBy("_part").orderBy(*order)
    out = rows.withColumn(name, (at + F.row_number().over(w) - 1).cast("long")).drop("_part")
    return out if most is None else out.filter(F.col(name) < most)
