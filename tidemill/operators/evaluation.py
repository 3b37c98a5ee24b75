"""Metrics of rankings, answers, tool calls and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import compose, normalise_compat, within


def positives(qrels: DataFrame) -> DataFrame:
    return qrels.filter(F.coalesce("relevance", F.lit(1.0)) > 0).select("query_id", "doc_id").distinct()


def evaluable(queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with a positive, and those without."""
    gold = positives(qrels).select("query_id").distinct()
    return queries.join(gold, "query_id", "left_semi"), queries.join(gold, "query_id", "left_anti")


def rank_metrics(hits: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, k, recall and mrr of each query that has gold; hits: query_id, doc_id, rank."""
    if not ks or min(ks) <= 0:
        raise ValueError("k must be positive")
    sizes = gold.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_gold"))
    found = hits.join(gold, ["query_id", "doc_id"]).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    cols = []
    for k in ks:
        cols += [F.sum((F.col("rank") <= k).cast("int")).alias(f"n{k}"), F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias(f"r{k}")]
    by = sizes.join(found.groupBy("query_id").agg(*cols), "query_id", "left")
    each = [F.struct(F.lit(k).alias("k"), (F.coalesce(f"n{k}", F.lit(0)) / F.col("n_gold")).alias("recall"), F.coalesce(1.0 / F.col(f"r{k}"), F.lit(0.0)).alias("mrr")) for k in ks]
    return by.select("query_id", F.inline(F.array(*each)))


def summary(metrics: DataFrame) -> DataFrame:
    """k, recall, mrr and n: means over queries."""
    return metrics.groupBy("k").agg(F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.count("*").alias("n"))


def recall_at(predicted: Column, gold: Column, k: int) -> Column:
    """Of two arrays; 0 for empty gold."""
    g = F.array_distinct(gold)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(F.slice(predicted, 1, k), g)), F.size(g)), F.lit(0.0))


def mrr_at(predicted: Column, gold: Column, k: int) -> Column:
    top = F.slice(predicted, 1, k)
    first = F.array_min(F.filter(F.transform(top, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1.0 / first, F.lit(0.0))


def coverage(gold: Column, seen: Column) -> Column:
    """Share of gold that was seen; 1 for empty gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(g, seen)), F.size(g)))


def tool_counts(actual: DataFrame, expected: DataFrame, by: str = "task_id") -> DataFrame:
    """Precision, recall and exactness of called tools against expected counts, as multisets. Both: by, tool, n."""
    pos = lambda df, c: df.filter("n > 0").select(by, "tool", F.col("n").alias(c))
    both = pos(actual, "a").join(pos(expected, "e"), [by, "tool"], "full").fillna(0, ["a", "e"])
    out = both.groupBy(by).agg(F.sum(F.least("a", "e")).alias("common"), F.sum("a").alias("called"), F.sum("e").alias("wanted"), F.min((F.col("a") == F.col("e")).cast("int")).alias("exact"))
    share = lambda x: F.when((F.col("called") == 0) & (F.col("wanted") == 0), 1.0).otherwise(F.coalesce(F.try_divide(F.col("common"), F.col(x)), F.lit(0.0)))
    return out.select(by, share("called").alias("precision"), share("wanted").alias("recall"), F.col("exact").cast("boolean").alias("exact"))


def tool_sets(called: Column, expected: Column) -> Column:
    """struct<precision, recall> of two arrays as sets; both empty is 1, 1."""
    c, e = F.array_distinct(called), F.array_distinct(expected)
    n, both = F.size(F.array_intersect(c, e)), (F.size(c) == 0) & (F.size(e) == 0)
    share = lambda x: F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(n, F.size(x)), F.lit(0.0)))
    return F.struct(share(c).alias("precision"), share(e).alias("recall"))


def merge_accuracy(cases: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """One row: n and the share of operations that are the expected ones; 0 of none."""
    same = F.coalesce(F.col(predicted) == F.col(expected), F.lit(False)).cast("double")
    return cases.agg(F.count("*").alias("n"), F.coalesce(F.avg(same), F.lit(0.0)).alias("accuracy"))


def recall_report(hits: DataFrame, qrels: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """k, recall, mrr and n_eval over the queries that have a positive; hits: query_id, doc_id, rank."""
    asked = queries.select("query_id").distinct()
    gold = positives(qrels).join(asked, "query_id", "left_semi")
    return summary(rank_metrics(hits.join(asked, "query_id", "left_semi"), gold, sorted(set(ks)))).withColumnRenamed("n", "n_eval")


def _flat(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def contains_all(answer: Column, required: Column, forbidden: Column | None = None, flat=_flat) -> Column:
    """Whether all required strings stand in the answer and no forbidden one does, without regard to case and white space.

    flat: how both sides are made alike in ASCII text; judge() takes care of other text.
    """
    a = flat(F.coalesce(answer, F.lit("")))
    ok = F.forall(required, lambda r: F.contains(a, flat(r)))
    return ok if forbidden is None else ok & ~F.exists(forbidden, lambda r: F.contains(a, flat(r)))


#: Labels of a final number. Fixed values.
FINAL = r"(?i)(?:最终答案|final\s*answer)"
KINDS = ["exact", "contains_all", "labelled_number", "refusal"]


def labelled_number(answer: Column, expected: Column, label: str = FINAL) -> Column:
    """Whether the last number after a label and a colon or equals sign is the expected decimal."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(rf"{label}\s*[:：=]\s*(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("decimal(38,10)") == expected.cast("decimal(38,10)"), F.lit(False))


def refusal(answer: Column, markers: Column, forbidden: Column, patterns: list[str]) -> Column:
    """Whether an answer has a marker of missing evidence, no forbidden claim and no forbidden pattern."""
    a = _flat(F.coalesce(answer, F.lit("")))
    ok = F.exists(markers, lambda m: F.contains(a, _flat(m))) & ~F.exists(forbidden, lambda m: F.contains(a, _flat(m)))
    for p in patterns:
        ok = ok & ~F.coalesce(answer, F.lit("")).rlike(f"(?i){p}")
    return ok


def judge(answer: Column, kind: Column, value: Column, values: Column, forbidden: Column, patterns: Column | None = None) -> Column:
    """By a rule's kind: exact, contains_all, labelled_number or refusal (values are its markers); another kind fails the query.

    Text is compared as NFKC without white space and case. forbidden, and for refusals patterns (regular expressions), must not occur.
    """
    none = F.array().cast("array<string>")
    text = F.coalesce(answer, F.lit(""))
    same = normalise_compat(text) == normalise_compat(F.coalesce(value.cast("string"), F.lit("")))
    asked, barred = within(F.array(text), values), within(F.array(text), forbidden)
    clear = ~F.exists(barred, lambda x: x)
    found = F.exists(F.coalesce(patterns, none) if patterns is not None else none, lambda p: F.rlike(text, F.concat(F.lit("(?i)"), p)))
    return (
        F.when(kind == "exact", same)
        .when(kind == "contains_all", F.forall(asked, lambda x: x) & clear)
        .when(kind == "labelled_number", labelled_number(compose(text), value.try_cast("decimal(38,10)")))
        .when(kind == "refusal", F.exists(asked, lambda x: x) & clear & ~found)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported answer rule: "), F.coalesce(kind, F.lit("null")))).cast("boolean"))
    )


def reconcile(reported: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows (keys, metric, reported, recomputed) on which two metric tables (keys, metric, value) disagree or that one lacks."""
    on = [*keys, "metric"]
    both = reported.select(*on, F.col("value").alias("reported")).join(recomputed.select(*on, F.col("value").alias("recomputed")), on, "full")
    gap = F.abs(F.col("reported") - F.col("recomputed"))
    near = gap <= tolerance * F.greatest(F.lit(1.0), F.abs("reported"), F.abs("recomputed"))
    return both.filter(~F.coalesce(near, F.lit(False)) & ~(F.col("reported").isNull() & F.col("recomputed").isNull()))


def not_finite(df: DataFrame, key: str) -> DataFrame:
    """key and metric of the numbers of df that are NaN or infinite."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    bad = lambda n: F.isnan(n) | (F.abs(n) == float("inf"))
    each = F.array_compact(F.array(*[F.when(bad(n), F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
    return df.select(key, F.explode(each).alias("metric"))


def integrity(reported: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows (keys, metric, reported, recomputed) of two wide tables of numbers that disagree, in either direction."""
    names = [c for c in reported.columns if c not in keys]
    if sorted(names) != sorted(c for c in recomputed.columns if c not in keys):
        raise ValueError("the tables have different metrics")
    long = lambda df: df.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
    return reconcile(long(reported), long(recomputed), keys, tolerance)
