"""Paired comparison of runs: differences, counts and bootstrap intervals over a table of resamples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .datasets import checkpoint

#: Ranges that one pass of a quantile search tells apart.
BINS = 1000


def differences(base: DataFrame, other: DataFrame, key: str = "task_id", value: str = "value") -> DataFrame:
    """One row: n, means, mean difference and how many tasks are better, worse and tied (within 1e-12)."""
    both = base.select(key, F.col(value).alias("b")).join(other.select(key, F.col(value).alias("o")), key)
    gap = F.col("o") - F.col("b")
    return both.agg(F.count("*").alias("n"), F.avg("b").alias("base"), F.avg("o").alias("other"), F.avg(gap).alias("difference"), F.sum((gap > 1e-12).cast("int")).alias("better"), F.sum((gap < -1e-12).cast("int")).alias("worse"), F.sum((F.abs(gap) <= 1e-12).cast("int")).alias("ties"))


def unmatched(base: DataFrame, other: DataFrame, key: str = "task_id") -> DataFrame:
    """Keys that only one run has."""
    b, o = base.select(key).distinct().withColumn("_b", F.lit(1)), other.select(key).distinct().withColumn("_o", F.lit(1))
    return b.join(o, key, "full").filter("_b IS NULL OR _o IS NULL").select(key, F.when(F.col("_b").isNull(), "other").otherwise("base").alias("only_in"))


def pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def all_pairs(runs: DataFrame, run: str = "run", key: str = "task_id", value: str = "value") -> DataFrame:
    """base, other, key, b and o of every unordered pair of runs, by an equi-join on the key; a key has one row a run."""
    listed = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"), F.col(value).alias("value")))).alias("r"))
    each = F.flatten(F.transform("r", lambda a, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda b: F.struct(a["run"].alias("base"), b["run"].alias("other"), a["value"].alias("b"), b["value"].alias("o")))))
    return listed.select(key, F.inline(each))


def resamples(spark: SparkSession, n: int, samples: int, seed: int) -> DataFrame:
    """sample and weights (place to times drawn) of bootstrap draws with replacement, made task by task from one seed per sample."""

    def draw(frames):
        import pandas as pd

        for frame in frames:
            parts = []
            for s in frame["id"]:
                times = np.bincount(np.random.default_rng([seed, int(s)]).integers(0, n, n), minlength=n)
                hit = np.flatnonzero(times)
                parts.append(pd.DataFrame({"sample": np.full(len(hit), int(s)), "ord": hit, "times": times[hit]}))
            yield pd.concat(parts) if parts else pd.DataFrame({"sample": [], "ord": [], "times": []}).astype("int64")

    return spark.range(samples).mapInPandas(draw, "sample long, ord long, times long")


def bootstrap_runs(values: DataFrame, samples: int, seed: int, level: float = 0.95, block: int = 100) -> DataFrame:
    """pair, metric, difference, low and high of the mean difference of every pair of runs in every metric over the same draws.

    values: task, metric, pair, base, other, the same tasks for all. A metric's differences come together as one array by task, thousands of
    numbers; each block of draws is a row, whose estimates are vector products in an Arrow batch. Beyond that size use bootstrap().
    """
    gap = (F.col("other") - F.col("base")).cast("double")
    rows = values.groupBy("pair", "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("task", gap.alias("g")))), lambda x: x["g"]).alias("gaps"))
    spark = values.sparkSession
    blocks = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(block))))

    def run(frames):
        import pandas as pd

        for frame in frames:
            out, drawn = [], {}
            for pair, metric, gaps, first in frame[["pair", "metric", "gaps", "first"]].itertuples(index=False):
                g = np.asarray(gaps)
                if (len(g), first) not in drawn:  # the same draws for all metrics
                    drawn[len(g), first] = [np.random.default_rng([seed, s]).integers(0, len(g), len(g)) for s in range(first, min(samples, first + block))]
                out.append((pair, metric, [float(g[i].mean()) for i in drawn[len(g), first]], float(g.mean())))
            yield pd.DataFrame(out, columns=["pair", "metric", "estimates", "difference"])

    cores = spark.sparkContext.defaultParallelism
    made = blocks.repartition(cores, "first").mapInPandas(run, "pair string, metric string, estimates array<double>, difference double")
    q = (1 - level) / 2
    each = made.select("pair", "metric", "difference", F.explode("estimates").alias("e"))
    return each.groupBy("pair", "metric").agg(F.first("difference").alias("difference"), F.percentile("e", F.lit(q)).alias("low"), F.percentile("e", F.lit(1 - q)).alias("high"))


def ratios(values: DataFrame, *by: str) -> DataFrame:
    """by, n, base, other and difference of ratios of sums over tasks (base_n, base_d, other_n, other_d)."""
    r = lambda side: F.try_divide(F.sum(f"{side}_n"), F.sum(f"{side}_d"))
    return values.groupBy(*by).agg(F.count("*").alias("n"), r("base").alias("base"), r("other").alias("other"), (r("other") - r("base")).alias("difference"))


def bootstrap(values: DataFrame, draws: DataFrame, ratio: bool = False, level: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """by, samples, low and high of the interval of the mean difference (values: ord, base, other) or, with ratio, of the difference of ratios
    of sums (ord, base_n, base_d, other_n, other_d). draws: sample, ord, times; the same ones for all of by."""
    rows = draws.join(values, "ord")
    t = F.col("times")
    if ratio:
        est = F.try_divide(F.sum(t * F.col("other_n")), F.sum(t * F.col("other_d"))) - F.try_divide(F.sum(t * F.col("base_n")), F.sum(t * F.col("base_d")))
    else:
        est = F.sum(t * (F.col("other") - F.col("base"))) / F.sum(t)
    each = rows.groupBy(*by, "sample").agg(est.alias("estimate"))
    q = (1 - level) / 2
    return each.groupBy(*by).agg(F.count("*").alias("samples"), F.percentile("estimate", F.lit(q)).alias("low"), F.percentile("estimate", F.lit(1 - q)).alias("high"))


def index_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """The value at place int(n * q) of the sorted column, at most the last: a pick, not an interpolation. One row: n, mean, picked.

    Values are counted, then searched digit by digit: the range from least to most is cut into BINS, the bin that holds the place is cut
    again, until it holds one value. Each pass is one aggregate; nothing is sorted or sent to one place.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"))
    counts = checkpoint(rows.groupBy("v").agg(F.count("*").alias("n")))
    n, mean, lo, hi = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.col("v") * F.col("n")) / F.sum("n"), F.min("v"), F.max("v")).first()
    at = min(int(n * q), n - 1)
    while n and lo < hi:
        inside = counts.filter(F.col("v").between(lo, hi))
        few = inside.limit(BINS + 1).count() <= BINS
        bin_of = F.col("v") if few else F.least(F.floor((F.col("v") - lo) / F.lit((hi - lo) / BINS)), F.lit(BINS - 1)).cast("double")
        before = 0
        for r in sorted(inside.groupBy(bin_of.alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):  # at most BINS rows
            if at < before + r.n:
                at, lo, hi = at - before, r.lo, r.hi
                break
            before += r.n
    spark = df.sparkSession
    return spark.createDataFrame([(n, mean, lo)] if n else [], "n long, mean double, picked double")
