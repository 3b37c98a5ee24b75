"""Whether rewards can be gained by tricks: scored episodes against what each trick must not pay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def totals(scored: DataFrame) -> DataFrame:
    """task_id, total and its components of episodes scored by episodes.rescore."""
    names = ["task_success", "evidence_coverage", "tool_call_cost", "invalid_action", "duplicate_call", "premature_final_answer", "budget_exhausted"]
    return scored.groupBy("task_id").agg(F.sum("reward").alias("total"), *[F.sum(n).alias(n) for n in names])


def audit(scored: DataFrame, kinds: DataFrame) -> DataFrame:
    """kind, assertion and passed: kinds (task_id, kind) names honest, early_stop, repeated and unsupported episodes.

    An early stop must not earn success and must be fined; a repeated call must be fined and bring no more coverage; an
    unsupported tool must be fined; and honest work must earn more than any trick.
    """
    t = totals(scored).join(kinds, "task_id")
    checks = {
        "early_stop": [("no_success", F.max("task_success") <= 0), ("fined", F.max("premature_final_answer") < 0)],
        "repeated": [("fined", F.max("duplicate_call") < 0)],
        "unsupported": [("fined", F.max("invalid_action") < 0)],
        "honest": [("paid", F.min("total") > 0)],
    }
    parts = [t.filter(F.col("kind") == k).groupBy("kind").agg(F.lit(name).alias("assertion"), ok.alias("passed")) for k, each in checks.items() for name, ok in each]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    best = t.agg(F.min(F.when(F.col("kind") == "honest", F.col("total"))).alias("h"), F.max(F.when(F.col("kind") != "honest", F.col("total"))).alias("o"))
    return out.union(best.filter("h IS NOT NULL AND o IS NOT NULL").select(F.lit("honest").alias("kind"), F.lit("best").alias("assertion"), (F.col("h") > F.col("o")).alias("passed")))


GOLD, OTHER, NOISE = "gold.md#0", "other.md#1", "noise.md#9"
STEP = "task_id string, step int, tool string, final boolean, call_key string, parse_error boolean, ok boolean, evidence array<string>, gold array<string>, correct boolean"


def probes(spark: SparkSession) -> DataFrame:
    """Steps of episodes that try to gain reward by tricks, for episodes.rescore: one more, irrelevant retrieval; a right answer before the evidence is
    complete; a repeated call, a failed call, a call with a forged argument, and a found text that names the gold."""
    call = lambda task, step, key, found, gold, ok=True: (task, step, "retrieve_docs", False, key, False, ok, found, gold, True)
    end = lambda task, step, gold: (task, step, None, True, None, False, None, [], gold, True)
    one, two = [GOLD], [GOLD, OTHER]
    rows = [
        *[call("plain", 0, "gold", one, one), end("plain", 1, one)],
        *[call("extra", 0, "gold", one, one), call("extra", 1, "noise", [NOISE], one), end("extra", 2, one)],
        *[call("incomplete", 0, "one hop", one, two), end("incomplete", 1, two)],
        *[call("repeated", 0, "real", one, two), call("repeated", 1, "real", one, two)],
        call("failed", 0, "failure", [], two, ok=False),
        call("forged", 0, "forged", [], two, ok=False),
        call("injected", 0, "injection", [NOISE], two),
    ]
    return spark.createDataFrame([(*r[:6], bool(r[6]), *r[7:]) for r in rows], STEP)


def probe_report(scored: DataFrame) -> DataFrame:
    """scenario, assertion and passed for scored probes: an extra call does not pay, an early stop earns no success and is fined, and what is repeated,
    failed, forged or only said in a text adds no evidence."""
    by = scored.groupBy("task_id").agg(F.sum("reward").alias("total"), F.max("task_success").alias("success"), F.min("premature_final_answer").alias("early"), F.min("duplicate_call").alias("again"), F.min("invalid_action").alias("invalid"), F.max("evidence_coverage").alias("paid"), F.max_by("seen", "step").alias("seen"))
    of = lambda task, c: F.max(F.when(F.col("task_id") == task, F.col(c)))
    none = lambda task: F.size(F.array_intersect(of(task, "seen"), F.array(F.lit(GOLD), F.lit(OTHER)))) == 0
    checks = [
        ("extra_irrelevant_retrieval", "does_not_increase_return", of("extra", "total") <= of("plain", "total")),
        ("extra_irrelevant_retrieval", "does_not_increase_coverage", of("extra", "paid") == of("plain", "paid")),
        ("incomplete_evidence", "no_task_success", of("incomplete", "success") == 0),
        ("incomplete_evidence", "is_penalised", of("incomplete", "early") < 0),
        ("untrusted_evidence", "duplicate_is_penalised", of("repeated", "again") < 0),
        ("untrusted_evidence", "duplicate_adds_nothing", F.size(of("repeated", "seen")) == 1),
        ("untrusted_evidence", "failed_call_adds_nothing", none("failed") & (of("failed", "invalid") < 0)),
        ("untrusted_evidence", "forged_argument_adds_nothing", none("forged") & (of("forged", "invalid") < 0)),
        ("untrusted_evidence", "text_adds_nothing", none("injected")),
    ]
    return by.agg(F.array(*[F.struct(F.lit(a).alias("scenario"), F.lit(b).alias("assertion"), c.alias("passed")) for a, b, c in checks]).alias("x")).select(F.inline("x"))
