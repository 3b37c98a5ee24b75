"""The pipeline's stages on a small corpus, each against what it must keep."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import decontam, quality
from tidemill.llm.common import table


def test_stages_keep_their_contracts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= before
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if i == 2:
            assert decontam.scan(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").count() == 0
        if i == 3:
            assert docs.count() == before and docs.filter(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.example\.com")).count() == 0
            assert docs.filter("n_chars <> length(text)").count() == 0
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_near_duplicates_leave_one_of_each_group(spark, sf_dir):
    rows = [(1, "a b c d e f g h", "en", "s", 15), (2, "a b c d e f g h", "en", "s", 15), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "z y", "en", "s", 3), (5, "z y x w v u", "en", "s", 11), (5, "z y", "en", "s", 3), (None, "q", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n", F.lit(1))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "q"), (1, "a b c d e f g h"), (3, ""), (4, ""), (5, "z y"), (5, "z y x w v u")]


def test_empty_tables(spark, sf_dir):
    none = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_stages_of_odd_rows_and_clashing_names(spark, sf_dir, odd):
    docs = odd.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "row": F.lit("x"), "ids": F.array(F.lit(1)), "keep": F.lit(True)})
    said = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    every, (quality, near, clean, pii, coded) = said(docs), (f for _, f in corpus_pipeline.STAGES)
    left = quality(spark, docs, sf_dir)
    assert left.columns == corpus_pipeline.COLUMNS and left.filter("text IS NULL OR text = ''").count() == 0
    left = near(spark, docs, sf_dir)
    assert left.columns == corpus_pipeline.COLUMNS
    assert [i for i, _ in said(left)] == [0, 1, 3, 4, 5, 6, 8, 9, 10]
    for stage in (clean, pii):
        left = stage(spark, docs, sf_dir)
        assert left.columns == corpus_pipeline.COLUMNS and said(left) == every
    left = coded(spark, docs, sf_dir)
    assert left.columns == ["doc_id", *corpus_pipeline.COLUMNS[1:], "n_tokens", "ids_sha256", "decoded_sha256"] and said(left) == every and left.filter("text IS NULL").first().n_tokens == 0


def test_quality_stage_learns_from_every_trusted_row(spark, sf_dir, monkeypatch):
    train, models = quality.train, []
    monkeypatch.setattr(quality, "train", lambda *a: models.append(train(*a)) or models[0])
    docs = table(spark, sf_dir, "documents")
    corpus_pipeline.quality_stage(spark, docs, sf_dir)
    trusted = docs.join(table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0"), "doc_id")
    symbols = sum(int(quality.unpack_numbers(x["counts"]).sum()) for x in models[0].counts.collect())
    assert symbols == trusted.agg(F.sum(F.length("text"))).first()[0]


def brute_without(trusted, i):
    """Mean loss of text i by the n-grams of all others, with discounts and single characters of all."""
    pad = ["<s>"] * 3
    grams = lambda t: [tuple((pad + list(t))[j : j + 4]) for j in range(len(t))]

    def levels(texts):
        out = [collections.Counter(g for t in texts for g in grams(t))]
        while len(out) < 4:
            out.append(collections.Counter(g[1:] for g in out[-1]))
        return out

    every, others = levels(trusted), levels(t for j, t in enumerate(trusted) if j != i)
    cut = [quality.discounts([sum(x == n for x in level.values()) for n in (1, 2, 3, 4)]) for level in every]

    def p(g):
        k = 4 - len(g)
        if not g:
            return 1 / (len({c for t in trusted for c in t}) + 2)
        level = every[k] if len(g) == 1 else others[k]
        known = [n for x, n in level.items() if x[:-1] == g[:-1]]
        off = lambda n: cut[k][min(n, 3)]
        return (level[g] - off(level[g]) + sum(map(off, known)) * p(g[1:])) / sum(known) if known else p(g[1:])

    return -sum(math.log(p(g)) for g in grams(trusted[i])) / len(trusted[i])


def test_quality_stage_calibrates_each_row_by_all_others(spark, tmp_path, monkeypatch):
    r = random.Random(11)
    words = ["the", "cat", "sat", "on", "a", "mat", "съешь", "булок", "天地玄黄", "zq"]
    texts = [" ".join(r.choice(words) for _ in range(3 + i)) for i in range(25)] + ["only jumbled vex", "the cat"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(quality, "TEAM_BYTES", 300)
    seen, line = [], quality.line
    monkeypatch.setattr(quality, "line", lambda n, mean, weight: seen.append(np.repeat(mean, weight.astype(int))) or line(n, mean, weight))
    corpus_pipeline.quality_stage(spark, docs.repartition(3), str(tmp_path))
    want = sorted(brute_without(texts, i) for i in range(len(texts)))
    assert np.allclose(sorted(seen[0]), want, atol=1 / quality.GRID[1])
