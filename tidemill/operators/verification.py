"""Verification of answers and evidence, retrieval baselines, evidence gates and summaries by cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as X

from .retrieval import ranked

METRICS = [
    "answer_em", "answer_f1", "sentence_precision", "sentence_recall", "sentence_f1", "sentence_em", "complete_sentence_evidence",
    "document_precision", "document_recall", "document_f1", "document_em", "complete_document_evidence", "joint_em", "joint_f1", "joint_success",
]


def verify(tasks: DataFrame) -> DataFrame:
    """tasks (answer, gold_answers, evidence, gold_evidence) with the fifteen METRICS.

    Documents are what stands before an evidence id's #number. Joint scores multiply precision and recall of answer and sentences.
    """
    docs = lambda c: F.array_distinct(F.transform(F.col(c), X.document_of))
    df = tasks.withColumns(
        {
            "_a": X.answer_scores(F.col("answer"), F.col("gold_answers")),
            "answer_em": X.exact_match(F.col("answer"), F.col("gold_answers")),
            "_s": X.set_scores(F.col("evidence"), F.col("gold_evidence")),
            "_d": X.set_scores(docs("evidence"), docs("gold_evidence")),
        }
    )
    full = lambda c: F.when(F.col(f"{c}.recall") >= 1.0, 1.0).otherwise(0.0)
    p, r = F.col("_a.precision") * F.col("_s.precision"), F.col("_a.recall") * F.col("_s.recall")
    out = {"answer_f1": F.col("_a.f1")}
    for name, c in (("sentence", "_s"), ("document", "_d")):
        out |= {f"{name}_{m}": F.col(f"{c}.{m}") for m in ("precision", "recall", "f1", "em")} | {f"complete_{name}_evidence": full(c)}
    out |= {"joint_em": F.col("answer_em") * F.col("_s.em"), "joint_f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "joint_success": F.col("answer_em") * full("_s")}
    return df.withColumns(out).drop("_a", "_s", "_d")


def mean_metrics(verified: DataFrame) -> DataFrame:
    return verified.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])


def retrieval_baseline(hits: DataFrame, tasks: DataFrame, ks: list[int]) -> DataFrame:
    """k and macro means of sentence and document recall and completeness over tasks (task_id, gold_evidence); hits: task_id, evidence_id, rank."""
    listed = hits.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence_id"))), lambda x: x["evidence_id"]).alias("found"))
    df = tasks.join(listed, "task_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    df = df.withColumn("k", F.explode(F.array(*map(F.lit, sorted(set(ks))))))
    top, gold = F.slice(F.array_distinct("found"), F.lit(1), F.col("k")), F.array_distinct("gold_evidence")
    share = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(b)), F.lit(0.0))
    documents = lambda c: F.array_distinct(F.transform(c, X.document_of))
    df = df.withColumns({"s": share(top, gold), "d": share(documents(top), documents(gold))})
    whole = lambda c: F.avg((F.col(c) >= 1.0).cast("double"))
    return df.groupBy("k").agg(F.avg("s").alias("sentence_recall"), whole("s").alias("complete_sentences"), F.avg("d").alias("document_recall"), whole("d").alias("complete_documents"), F.count("*").alias("n"))


def success(kind: Column, answer: Column, evidence: Column, gold: Column, expected: Column, needles: Column, k: int) -> Column:
    """By task type: multihop has all of its gold, which must not be empty, in the first k ids; calc hits its number; memory has all needles."""
    top = F.slice(F.array_distinct(evidence), 1, k)
    answer = F.coalesce(answer, F.lit(""))
    return (
        F.when(kind == "multihop", (F.size(gold) > 0) & (F.size(F.array_except(gold, top)) == 0))
        .when(kind == "calc", X.numeric_hit(answer, expected))
        .when(kind == "memory", (F.size(needles) > 0) & F.forall(needles, lambda n: F.contains(answer, n)))
        .otherwise(F.lit(False))
    )


def evidence_gate(read: Column, required_files: Column, values: Column, required_values: Column) -> Column:
    """Whether all required files were read and each required decimal stands among the values at least as often."""
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    enough = F.forall(required_values, lambda x: times(values, x) >= times(required_values, x))
    return (F.size(F.array_except(required_files, read)) == 0) & enough


def by_cohort(records: DataFrame, cohort: str = "cohort") -> DataFrame:
    """cohort (null is all), n, success, and means over the rows that have the measure: answer, retrieval, tool precision and recall."""
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return records.groupingSets([[F.col(cohort)], []], cohort).agg(F.count("*").alias("n"), mean("success"), mean("answer_ok"), mean("coverage"), mean("tool_precision"), mean("tool_recall"))


def stop_counts(records: DataFrame, cohort: str = "cohort") -> DataFrame:
    return records.groupBy(cohort, "stop_reason").agg(F.count("*").alias("n"))


def capability(expected: Column, available: Column) -> Column:
    """Share of the expected tools that are available; 1 where none is expected."""
    e = F.array_distinct(expected)
    return F.when(F.size(e) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(e, available)), F.size(e)))


def decimals_within(actual: Column, required: Column) -> Column:
    """Whether each decimal of a list (as text) stands in another at least as often; false where one is no decimal."""
    number = lambda a: F.transform(a, lambda x: x.try_cast("decimal(38,10)"))
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    have, want = number(actual), number(required)
    known = ~F.exists(have, lambda x: x.isNull()) & ~F.exists(want, lambda x: x.isNull())
    return F.coalesce(known & F.forall(want, lambda x: times(have, x) >= times(want, x)), F.lit(False))


def evaluation_summary(records: DataFrame, by: str | None = None) -> DataFrame:
    """Means over evaluated tasks: task_success, coverage (of those that have gold), tool precision and recall, model calls, tool calls, steps,
    and the rate of parse failures; 0 of none."""
    names = ["coverage", "tool_precision", "tool_recall", "llm_calls", "tool_calls", "steps", "parse_fail_rate"]
    mean = lambda c, n: F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(n)
    cols = [mean(F.col("success"), "task_success"), *[mean(F.col(n), n) for n in names]]
    return records.groupBy(by).agg(*cols) if by else records.agg(*cols)


def weighted_losses(steps: DataFrame) -> DataFrame:
    """One row: loss by tokens, plain mean and tokens of steps (loss, tokens)."""
    return steps.agg(F.try_divide(F.sum(F.col("loss") * F.col("tokens")), F.sum("tokens")).alias("weighted"), F.avg("loss").alias("plain"), F.sum("tokens").alias("tokens"))


def update_report(episodes: DataFrame) -> DataFrame:
    """update, groups, groups without variance, mean reward and deviation of episodes (update, group_id, reward)."""
    groups = episodes.groupBy("update", "group_id").agg(F.avg("reward").alias("m"), F.stddev_pop("reward").alias("s"), F.count("*").alias("n"))
    return groups.groupBy("update").agg(F.count("*").alias("groups"), F.sum((F.col("s") < 1e-4).cast("int")).alias("flat_groups"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean_reward"), F.avg("s").alias("mean_deviation"))


def update_stops(episodes: DataFrame) -> DataFrame:
    """update, stop_reason and n of episodes (update, stop_reason)."""
    return episodes.groupBy("update", "stop_reason").agg(F.count("*").alias("n"))


def match_count_search(queries: DataFrame, docs: DataFrame, tokens, k: int) -> DataFrame:
    """Documents by how many of a query's distinct tokens they have, then doc_id; only those with one. An equi-join on tokens."""
    words = lambda df, i: df.select(i, F.explode(F.array_distinct(tokens(F.col("text")))).alias("tok"))
    scored = words(queries, "query_id").join(words(docs, "doc_id"), "tok").groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))
    return ranked(scored, F.col("score").desc(), F.col("doc_id"), k=k)


def recording_search(asked: DataFrame, documents: DataFrame, by: str = "task_id") -> DataFrame:
    """by, query_id, doc_id, score and rank of a task's documents by how many of their match terms stand within the query, then by place; only
    those with one. asked: by, query_id, query; documents: by, place, doc_id, match_terms (array). A task has a handful of documents."""
    pairs = asked.select(by, "query_id", "query").join(documents.select(by, "place", "doc_id", "match_terms"), by)
    found = pairs.withColumn("score", F.size(F.filter(X.within(F.array("query"), F.col("match_terms")), lambda x: x))).filter("score > 0")
    return ranked(found, F.col("score").desc(), F.col("place"), by="query_id").select(by, "query_id", "doc_id", "score", "rank")


def letters_overlap(query: Column, content: Column) -> Column:
    """1 and the number of distinct letters that both share, as NFKC without white space and case."""
    chars = lambda c: F.array_distinct(F.filter(F.split(X.normalise_compat(c), ""), lambda x: x != ""))
    return F.size(F.array_intersect(chars(query), chars(content))) + 1


def audit_search(queries: DataFrame, facts: DataFrame, k: int = 5, by: str = "task_id") -> DataFrame:
    """A task's active facts by letters_overlap, then id: by, query_id, id, score, rank. Facts of a frozen task are few."""
    pairs = queries.select(by, "query_id", "query").join(facts.filter("state = 'ACTIVE'").select(by, "id", "fact_content"), by)
    scored = pairs.withColumn("score", letters_overlap(F.col("query"), F.col("fact_content")))
    return ranked(scored, F.col("score").desc(), F.col("id"), k=k).select(F.col(by), "query_id", "id", "score", "rank")
