"""Operators on small fixtures with known results."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import bm25, chunking, comparison, datasets, enrich, episodes, evaluation, memory, retrieval, training


def test_nearest(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0])], "doc_id long, vector array<float>")
    q = spark.createDataFrame([(7, [0.9, 0.1]), (8, [0.0, 0.0])], "query_id long, vector array<float>")
    got = [(r.query_id, r.doc_id, r.rank) for r in retrieval.nearest(q, corpus, 3, "cosine").orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 1), (7, 5, 2), (7, 2, 3)]
    l2 = {(r.query_id, r.rank): r.doc_id for r in retrieval.nearest(q, corpus, 2).collect()}
    assert l2[(8, 1)] == 3 and l2[(7, 1)] == 1
    assert retrieval.nearest(q.limit(0), corpus, 3).count() == 0 and retrieval.nearest(q, corpus.limit(0), 3).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id string, rank int, score double")


def test_fusion_and_thresholds(spark):
    a = hits(spark, [(1, "a", 1, 0.1), (1, "b", 2, 0.9)])
    b = hits(spark, [(1, "b", 1, 0.0), (1, "c", 2, 0.0)])
    assert [r.doc_id for r in retrieval.fuse([a, b], 60).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.doc_id for r in retrieval.within(a, 0.5).collect()] == ["a"]
    assert retrieval.within(a, 0.05).count() == 2 and retrieval.within(a, 0.05, strict=True).count() == 0


def test_rerank(spark):
    rows = [(1, "low", 1, 0.1), (1, "none", 2, 9.0), (1, "mid", 3, 0.5), (1, "high", 4, 0.9)]
    df = hits(spark, rows).withColumn("text", F.when(F.col("doc_id") == "none", "").otherwise(F.col("doc_id")))
    assert [r.doc_id for r in retrieval.rerank(df, F.col("score"), F.col("text"), F.lit("q"), 4).orderBy("rank").collect()] == ["high", "mid", "low", "none"]
    blank = retrieval.rerank(df, F.col("score"), F.col("text"), F.lit("  "), 1).collect()
    assert [(r.doc_id, r.rerank_score) for r in blank] == [("low", None)]


def test_parents(spark):
    chunks = spark.createDataFrame([("p", i, f"t{i}") for i in range(6)] + [("o", 0, "x")], "parent_id string, chunk_id int, text string")
    q = spark.createDataFrame([(1, 1, "p", 3), (1, 2, "p", 4), (1, 3, "o", 0), (2, 1, "p", 0)], "query_id long, rank int, parent_id string, chunk_id int")
    got = {(r.query_id, r.rank): r for r in retrieval.expand(q, chunks, cap=3).collect()}
    assert got[(1, 1)].child_chunk_ids == [2, 3, 4] and got[(1, 1)].text == "t2\n\nt3\n\nt4" and got[(1, 2)].parent_id == "o" and got[(2, 1)].child_chunk_ids == [0, 1, 2]
    assert retrieval.expand(q, chunks).filter("query_id = 2").first().child_chunk_ids == list(range(6))
    ids = spark.createDataFrame([(i, h) for i, h in enumerate([None, " ", None, None, "H "])], "chunk_id int, heading string")
    assert [r[0] for r in ids.orderBy("chunk_id").select(retrieval.parent_id(F.lit("s"), F.col("heading"), F.col("chunk_id"), 2)).collect()] == ["s#p0", "s#p0", "s#p1", "s#p1", "s::H"]


def test_bm25_pads_and_scores(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox fox", "green dog", "", "grey cat", "pink cow"])], "doc_id long, text string")
    q = spark.createDataFrame([(1, "fox fox"), (2, "zebra"), (3, "")], "query_id long, text string")
    tok = X.simple_tokens(F.col("text"))
    got = {}
    for r in bm25.search(q, tok, docs, tok, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    idf = math.log(5 - 2 + 0.5) - math.log(2.5)
    avg = 11 / 5
    score = lambda tf, dl: round(2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)), 6)
    assert got[1] == [(1, score(2, 3)), (0, score(1, 2)), (2, 0.0)] and got[2] == [(0, 0.0), (1, 0.0), (2, 0.0)] and 3 not in got


def test_metrics(spark):
    p = lambda *x: F.array(*map(F.lit, x))
    one = lambda c: spark.range(1).select(c).first()[0]
    none = F.array().cast("array<string>")
    assert one(evaluation.recall_at(p("a", "b", "c"), p("a", "x"), 3)) == 0.5 and one(evaluation.recall_at(p("a", "b", "c"), p("c"), 2)) == 0.0
    assert one(evaluation.recall_at(p("a"), none, 3)) == 0.0 and one(evaluation.coverage(none, p("a"))) == 1.0
    assert one(evaluation.mrr_at(p("a", "b", "c"), p("b"), 3)) == 0.5
    h = hits(spark, [(1, "m1", 1, 0.0), (1, "x", 2, 0.0), (2, "x", 1, 0.0), (2, "m2", 2, 0.0), (2, "m3", 3, 0.0)])
    gold = spark.createDataFrame([(1, "m1"), (2, "m2"), (2, "m3")], "query_id long, doc_id string")
    got = {r.k: r for r in evaluation.summary(evaluation.rank_metrics(h, gold, [1, 3])).collect()}
    assert (got[1].recall, got[3].recall, got[1].mrr, got[3].mrr, got[3].n) == (0.5, 1.0, 0.5, 0.75, 2)
    with pytest.raises(ValueError):
        evaluation.rank_metrics(h, gold, [0])
    assert tuple(one(evaluation.tool_sets(p("r", "c"), p("r")))) == (0.5, 1.0)
    assert one(evaluation.labelled_number(F.lit("Final answer: 3, no: 最终答案：4.50"), F.lit(4.5))) is True


def test_headings_pages_blocks(spark):
    text = "# Title\naaa\n## Section A\n### Sub A1\nbbb\n## Section B\nccc"
    docs = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, text.index("bbb")), (1, text.index("ccc")), (2, 0)], "doc_id long, start int")
    got = [r.heading for r in enrich.heading_paths(chunks, enrich.headings(docs)).orderBy("doc_id", "start").collect()]
    assert got == ["Title > Section A > Sub A1", "Title > Section B", None]
    pages = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(p).alias("page")) for s, p in ((0, 1), (100, 2), (250, 3))])
    at = [r[0] for r in spark.createDataFrame([(x,) for x in (50, 100, 249, 300, -5)], "x int").select(enrich.page_at(pages, F.col("x"))).collect()]
    assert at == [1, 2, 2, 3, 1]
    listed = spark.createDataFrame([(1, 1, "ab"), (1, 2, " "), (1, 3, "cde")], "doc_id long, page int, text string")
    assert [(r.page, r.start) for r in enrich.page_offsets(listed).orderBy("page").collect()] == [(1, 0), (3, 4)]
    cases = {"# H": "heading", "- a\n- b": "list", "|a|b|\n|c|d|": "table", "```\nx = 1\n# y\n```": "code", "words here": "paragraph", "": "paragraph", "- a\ntext": "list", "# H\ntext": "paragraph", "1. a\n|b|": "list"}
    frame = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert [(r.text, r.got) for r in frame.select("text", "want", enrich.block_type(F.col("text")).alias("got")).collect() if r.got != r.want] == []


def test_chunking(spark):
    docs = spark.createDataFrame([("s", " ".join(f"w{i}." if i % 7 == 6 else f"w{i}" for i in range(50)) + "\n\nnext paragraph of it."), ("blank", "  "), ("null", None)], "source string, text string")
    rows = chunking.chunk_text(docs, size=20, overlap=5).collect()
    assert {r.source for r in rows} == {"s"} and [r.chunk_id for r in rows] == list(range(len(rows)))
    text = docs.first().text
    assert all(text[r.start : r.end] == r.text for r in rows) and all(b.token_start <= a.token_end for a, b in zip(rows, rows[1:]))
    assert rows[0].boundary == "sentence" and rows[-1].token_end == 54
    alike = lambda texts: [[1.0, 0.0] if i < 3 else [0.0, 1.0] for i in range(len(texts))]
    groups = chunking.chunk_text(docs, size=1000, overlap=5, strategy="semantic", embed=alike).collect()
    assert [r.boundary for r in groups] == ["semantic", "semantic"] and groups[0].chunk_strategy == "semantic"
    assert all(r.boundary == "token_limit" for r in chunking.chunk_text(docs, size=8, overlap=2, strategy="semantic", embed=lambda t: [[1.0]] * len(t)).collect()[:-1])
    with pytest.raises(ValueError):
        chunking.chunk_text(docs, size=5, overlap=5)
    got = [(r.start, r.stop, r.piece) for r in chunking.paragraphs(spark.createDataFrame([(1, "a b\n\n\nc")], "doc_id long, text string")).collect()]
    assert got == [(0, 3, "a b"), (6, 7, "c")]


def test_memory(spark):
    log = spark.createDataFrame([(1, 0, "add", "a"), (1, 1, "update", "b"), (1, 2, "supersede", None), (1, 3, "update", "c"), (2, 0, "update", "x"), (2, 1, "add", "y"), (2, 2, "delete", None), (3, 0, "add", "z")], "fact_id long, seq long, op string, content string")
    got = {r.fact_id: (r.content, r.state, r.updated_seq) for r in memory.latest(log).collect()}
    assert got == {1: ("b", "SUPERSEDED", 2), 2: ("y", "DELETED", 2), 3: ("z", "ACTIVE", 0)}
    existing = spark.createDataFrame([(1, "hobby", "old")], "id long, fact_object string, fact_content string")
    ops = [("update", 1, "new", "hobby", 1.0), ("update", 1, "new", "hobby", 0.5), ("delete", 1, "new", "hobby", 1.0), ("delete", 1, "", "hobby", 1.0), ("update", 1, "new", "city", 1.0), ("delete", 1, "new", "", 0.85), ("update", 9, "new", "", 1.0), ("add", None, " ", "", 0.0), ("add", None, "n", "", 0.0)]
    df = spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "op_id int, type string, id long, fact_content string, fact_object string, sim double")
    assert [r.resolved for r in memory.resolve(df, existing, F.col("sim")).orderBy("op_id").collect()] == ["supersede", "add", "delete", "refused", "add", "add", "refused", "refused", "add"]
    facts = spark.createDataFrame([(1, [1.0, 0.0], "ACTIVE"), (2, [0.0, 1.0], "ACTIVE"), (3, [1.0, 0.0], "DELETED")], "fact_id long, vector array<float>, state string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r.doc_id for r in memory.recall(q, facts, 5, 0.5).collect()] == [1]


def steps(spark, rows):
    names = "task_id string, step int, tool string, final boolean, call_key string, parse_error boolean, ok boolean, evidence array<string>, gold array<string>, correct boolean"
    return spark.createDataFrame(rows, names)


def test_rewards(spark):
    r = "retrieve_docs"
    rows = [("a", 0, r, False, "1", False, True, ["x"], ["x", "y"], True), ("a", 1, "calculator", False, "2", False, True, [], ["x", "y"], True), ("a", 2, r, False, "3", False, True, ["y"], ["x", "y"], True), ("a", 3, None, True, None, False, True, [], ["x", "y"], True)]
    rows += [("b", 0, r, False, "1", False, True, ["x"], ["x", "y"], False), ("b", 1, r, False, "1", False, True, ["x"], ["x", "y"], False), ("b", 2, None, True, None, False, True, [], ["x", "y"], False)]
    rows += [("c", 0, None, True, None, False, True, [], ["x"], False), ("d", 0, "shell", False, "1", False, True, [], ["x"], False), ("e", 0, r, False, "1", False, True, ["x"], ["x"], False)]
    got = {(s.task_id, s.step): round(s.reward, 6) for s in episodes.rescore(steps(spark, rows), [r, "calculator"], 4).collect()}
    assert [got["a", i] for i in range(4)] == [-0.02, -0.02, -0.02, 1.3] and [got["b", i] for i in range(3)] == [-0.02, -0.1, -0.15] and got["c", 0] == -0.3
    last = {s.task_id: round(s.reward, 6) for s in episodes.rescore(steps(spark, rows), [r, "calculator"], 1).filter("step = 0").collect()}
    assert last["d"] == -0.4 and last["e"] == -0.32


def test_selection(spark):
    df = spark.createDataFrame([("t", 0, 1, 5), ("t", 1, 1, 7), ("t", 2, 1, 7), ("t", 3, 0, 9)], "task_id string, candidate int, clean int, q int")
    assert episodes.best_of(df, keys=["clean", "q"]).first().selected == 1
    assert [r.candidate for r in episodes.early_stop(df, F.col("q") == 7).orderBy("candidate").collect()] == [0, 1]
    assert episodes.early_stop(df, F.col("q") == 70).count() == 4


def test_training_arithmetic(spark):
    df = spark.createDataFrame([("g", x) for x in (0.0, 1.0, 2.0, 1.0)] + [("h", 0.25)] * 3, "group_id string, reward double")
    got = training.advantages(df).collect()
    g = [r.advantage for r in got if r.group_id == "g"]
    assert sum(g) == pytest.approx(0, abs=1e-9) and max(g) == pytest.approx(1 / (math.sqrt(0.5) + 1e-4)) and all(r.advantage == 0 for r in got if r.group_id == "h")
    loss = training.clipped_loss(spark.createDataFrame([(math.log(0.5), 0.0, 0.0, -1.0)], "logp double, old_logp double, ref_logp double, advantage double"), 0.2, 0.0).first()
    assert loss.loss == pytest.approx(0.8) and loss.clip_fraction == 1.0
    ids = lambda n: F.array(*map(F.lit, range(n))) if n else F.array().cast("array<int>")
    x = spark.range(1).select(training.truncate(ids(20), F.array(F.lit(100), F.lit(101)), 10, head=3, multiple=4)).first()[0]
    assert x.input_ids == [0, 1, 2, 15, 16, 17, 18, 19, 100, 101, 0, 0] and x.labels == [-100] * 8 + [100, 101, -100, -100]


def test_gate_and_examples(spark):
    d = lambda a, bad=False, raw="r": (raw, a, bad)
    s = lambda i, a, dup=False, invalid=False, ok=True: (i, a, dup, invalid, ok)
    good = ([d("tool"), d("final_answer")], [s(0, "tool"), s(1, "final_answer")])
    rows = [
        ("kept", *good, 1.0, 1.0),
        (None, *good, 1.0, 1.0),
        ("missing_decisions", [], [], 1.0, 1.0),
        ("parse_error", [d("tool", True)], [s(0, "tool")], 1.0, 1.0),
        ("incomplete_decision", [d("tool", raw=" ")], [s(0, "tool")], 1.0, 1.0),
        ("transition_count_mismatch", [d("tool"), d("tool")], [s(0, "tool")], 1.0, 1.0),
        ("duplicate_call_transition", [d("a"), d("b")], [s(0, "a", dup=True), s(5, "b")], 1.0, 1.0),
        ("transition_step_mismatch", [d("a"), d("b")], [s(3, "a"), s(1, "b", dup=True)], 1.0, 1.0),
        ("unsuccessful_tool_event", [d("a")], [s(0, "a", ok=False)], 1.0, 1.0),
        ("missing_success_metric", *good, None, 1.0),
        ("below_success_threshold", *good, 0.5, 0.0),
        ("below_evidence_threshold", *good, 1.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "task_id string, decisions array<struct<raw:string,action:string,parse_error:boolean>>, transitions array<struct<step:int,action:string,duplicate:boolean,invalid:boolean,ok:boolean>>, success double, evidence double")
    got = training.gate(df).collect()
    assert all((r.reject_reason or "kept") == (r.task_id or "invalid_episode") for r in got)
    kept = training.examples(df.filter("task_id = 'kept'"), 3).orderBy("step", "replica").collect()
    assert [(r.step, r.replica) for r in kept] == [(0, 0), (0, 1), (0, 2), (1, 0)]


def test_gate_names_faults_of_rewards_and_verification(spark):
    d = lambda a: ("r", a, False)
    s = lambda i, a, reward=(0.0, 0.0), ok=True: (i, a, False, False, ok, reward)
    rows = [
        ("kept", [d("a"), d("final_answer")], [s(0, "a"), s(1, "final_answer")], True),
        ("invalid_transition", [d("a"), d("b")], [None, s(5, "b")], True),
        ("transition_step_mismatch", [d("a"), d("b")], [s(None, "a", None), None], True),
        ("missing_reward_breakdown", [d("a")], [s(0, "a", None, False)], True),
        ("invalid_reward_breakdown", [d("a")], [s(0, "a", (-0.1, None))], True),
        ("invalid_reward_breakdown", [d("a")], [s(0, "a", (math.nan, 0.0))], True),
        ("invalid_reward_breakdown", [d("a")], [s(0, "a", (0.0, -math.inf))], True),
        ("invalid_action_transition", [d("a")], [s(0, "a", (-0.1, -0.1))], True),
        ("duplicate_call_transition", [d("")], [s(0, "", (0.0, -0.1))], True),
        ("invalid_transition_action", [d("")], [s(0, "", ok=None)], True),
        ("incomplete_decision", [d(None)], [s(0, None)], True),
        ("transition_action_mismatch", [d("a")], [s(0, None)], True),
        ("missing_tool_event", [d("a"), d("final_answer")], [s(0, "a", ok=None), s(1, "final_answer", ok=None)], True),
        ("kept", [d("a"), d("final_answer")], [s(0, "a"), s(1, "final_answer", ok=None)], True),
        ("kept", [d("final_answer")], [s(0, "final_answer", ok=False)], True),
        ("missing_transitions", [d("a")], None, True),
        ("transition_count_mismatch", [d("a")], [], True),
        ("unsuccessful_tool_event", [d("a")], [s(0, "a", ok=False)], None),
        ("missing_verification", [d("a")], [s(0, "a")], None),
        ("missing_verification", [d("a")], [s(0, "a")], False),
        ("parse_error", [None], [s(0, "a")], True),
    ]
    rows = [(*r, None if r[0] == "missing_verification" else 1.0, 1.0) for r in rows]
    df = spark.createDataFrame(rows, "task_id string, decisions array<struct<raw:string,action:string,parse_error:boolean>>, transitions array<struct<step:int,action:string,duplicate:boolean,invalid:boolean,ok:boolean,reward:struct<invalid_action:double,duplicate_call:double>>>, verified boolean, success double, evidence double")
    assert [(r.task_id, r.reject_reason) for r in training.gate(df).collect() if (r.reject_reason or "kept") != r.task_id] == []


def test_comparison(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 1.0)], "task_id string, value double")
    other = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0), ("d", 1.0)], "task_id string, value double")
    d = comparison.differences(base, other).first()
    assert (d.n, d.better, d.worse, d.ties, d.difference) == (3, 1, 1, 1, 0.0)
    assert [tuple(r) for r in comparison.unmatched(base, other).collect()] == [("d", "other")]
    values = spark.createDataFrame([(0, 1.0, 1.0, 0.0, 1.0), (1, 0.0, 4.0, 0.0, 4.0)], "ord long, base_n double, base_d double, other_n double, other_d double")
    draws = spark.createDataFrame([(0, 0, 2), (1, 1, 2), (2, 0, 1), (2, 1, 1), (3, 0, 1), (3, 1, 1)], "sample long, ord long, times long")
    r = comparison.bootstrap(values, draws, ratio=True).first()
    assert (r.samples, round(r.low, 6), round(r.high, 6)) == (4, -0.94, -0.015)
    same = comparison.resamples(spark, 10, 5, seed=1)
    assert same.groupBy("sample").agg(F.sum("times").alias("n")).filter("n <> 10").count() == 0
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, comparison.resamples(spark, 10, 5, seed=1).collect()))
    assert comparison.pairs(["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_datasets(spark):
    rows = [("one", "Q?", "A", "bridge", ([" Beta"], [0]), (["Alpha", "Beta"], [["a0", "a1"], ["b0"]])), ("two", "Q?", "A", "bridge", (["Gamma"], [1]), (["Beta", "Gamma"], [["b0"], ["g0", "g1"]])), ("bad", "Q?", "A", "bridge", (["Beta"], [7]), (["Beta"], [["b0"]])), ("blank", " ", "A", "bridge", ([], []), ([], []))]
    df = spark.createDataFrame(rows, "id string, question string, answer string, type string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>")
    tasks, sentences, rejected = datasets.convert(df)
    assert tasks.count() == 2 and sentences.count() == 5 and {(r.id, r.reason) for r in rejected.collect()} == {("bad", "unknown_support"), ("blank", "missing_question")}
    assert {tuple(r.gold_evidence_ids) for r in tasks.collect()} <= {(r.doc_id,) for r in sentences.collect()}
    assert {r.text for r in sentences.collect()} >= {"Beta\nb0", "Gamma\ng1"} and sentences.filter("NOT doc_id LIKE 'documents/%-__________#_'").count() == 0
    edges = tasks.select("task_id", F.explode("document_keys").alias("document_key"))
    assert datasets.disjoint_partitions(edges).select("partition").distinct().count() == 1
    chain = spark.createDataFrame([(i, j) for i in range(12) for j in (i, i + 1)] + [(50, 99)], "l long, r long")
    got = {r.l: r.component for r in datasets.components(chain, "l", "r").collect()}
    assert got == {**{i: 0 for i in range(12)}, 50: 50}
    assert [(r.expected, r.seq) for r in datasets.gaps(spark.createDataFrame([("a", 0), ("a", 1), ("a", 3)], "k string, seq long"), "k", "seq").collect()] == [(2, 3)]
    assert datasets.collisions(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "k long, v string"), "k").count() == 1


def test_messages(spark):
    from tidemill.operators import messages

    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(messages.decision(F.lit('```json\n{"final_answer": "x", "tool": "t"}\n```'))).kind == "final"
    assert one(messages.decision(F.lit('{"tool": "t", "plan": "p"}'))).tool == "t" and one(messages.decision(F.lit('{"plan": ["p", " "]}'))).plan == ["p"] and one(messages.decision(F.lit("nothing"))).kind == "invalid"
    schema = {"q": ("str", True), "n": ("int", False)}
    cases = {'{"q": "a", "n": 3}': None, '{"q": "a", "n": true}': None, '{"q": "a", "n": 3.5}': "arg 'n' must be int", '{"n": 3}': "missing required arg 'q'", '{"q": 1}': "arg 'q' must be str", '{"q": "a", "z": 1}': "unknown args: z", "[1]": "args must be a JSON object", '{"q": {"q": "x"}}': "arg 'q' must be str", '{"q": null}': "missing required arg 'q'", '{"q": "a", "n": null}': None, "no": "args must be a JSON object"}
    assert {a: one(messages.argument_error(F.lit(a), schema)) for a in cases} == cases
    kept = one(messages.safe_provenance(F.create_map(F.lit("source"), F.lit("s"), F.lit("GoldIds"), F.lit("g"))))
    assert kept == {"source": "s"}
    assert one(messages.compact(F.array(*map(F.lit, "abcdef")), 4, 1)) == list("cdef") and one(messages.compact(F.array(F.lit("ab")), 4, 1)) == ["a"]
    assert json.loads(one(messages.safe_json(F.lit('{"a": 1, "Gold": 2, "b": {"label": 1, "c": [1]}, "d": {"answers": 1}, "e": [[1]]}')))) == {"a": 1, "b": {"c": [1]}}
    assert one(messages.safe_json(F.lit('{"target": 1}'))) is None
    event = lambda i, size: F.struct(F.lit(i).alias("step_index"), F.lit("t").alias("tool"), F.lit("{}").alias("args"), F.lit(True).alias("ok"), F.lit("x" * size).alias("observation"))
    tiers = [json.loads(one(messages.tiered(F.array(event(0, 10), event(1, 900)), b))) for b in (5000, 900, 100)]
    assert [len(t[1]["observation"]) for t in tiers] == [900, 290, 64] and tiers[1][0]["observation"] == "x" * 10 and "args" not in tiers[2][0]
    routed = lambda raw, msg="hi": tuple(one(messages.route(F.lit(raw).cast("string"), F.lit(msg).cast("string"))))
    assert routed('{"use_docs": false, "rewritten_query": " q "}') == (False, True, True, "q") and routed("broken") == (True, True, True, "hi")
    assert routed('```json\n{"use_docs": 0, "use_memory": "", "write_memory": null}\n```') == (False, False, False, "hi") and routed("{}", "  ") == (False, False, False, "")
    read = lambda raw: [tuple(f) for f in one(messages.facts(F.lit(raw)))]
    fact = '{"fact_content": " likes tea ", "fact_object": "drink", "visibility": "PRIVATE"}'
    assert read('{"facts": [%s, {"fact_content": " "}]}' % fact) == read(f"[{fact}]") == read('[{"facts": [%s]}]' % fact) == [("drink", "likes tea", "PRIVATE")]
    assert read("none") == read("3") == read("{}") == []
    said = json.loads(one(messages.state(F.lit("q?"), F.lit(3), F.array(F.lit("t")), F.array(F.struct(F.lit(0).alias("step_index"), F.lit("t").alias("tool"), F.lit("{}").alias("args"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit("o" * 6000).alias("observation"))), F.lit("Duplicate call"))))
    assert len(said["retrieved_evidence"][0]) == 5000 and "required_next_action" in said and said["remaining_steps"] == 3
    assert one(messages.trajectory(F.array(F.struct(F.lit(0).alias("step_index"), F.lit("t").alias("tool"), F.lit("{}").alias("args"), F.lit(False).alias("ok"), F.lit("bad").alias("error"), F.lit("hm").alias("thought"), F.lit("seen").alias("observation"))))) == "[0] t({}) -> ERROR: bad\n    thought: hm\n    obs: seen"


def test_verification(spark):
    from tidemill.operators import verification

    rows = [("r", ["ok"], ["a#0", "b#9"], ["a#0", "b#1"], "ok"), ("s", ["no"], ["a#0", "noise#0"], ["a#0"], "ok"), ("t", ["ok"], ["a#0", "noise#0"], ["a#0"], "ok"), ("u", ["ok"], [], [], "")]
    df = spark.createDataFrame(rows, "task_id string, gold_answers array<string>, evidence array<string>, gold_evidence array<string>, answer string")
    got = {r.task_id: r for r in verification.verify(df).collect()}
    assert (got["r"].sentence_precision, got["r"].sentence_recall, got["r"].document_recall, got["r"].joint_success) == (0.5, 0.5, 1.0, 0.0)
    assert (got["t"].sentence_precision, got["t"].sentence_recall, got["t"].sentence_em, got["t"].joint_em, got["t"].joint_success) == (0.5, 1.0, 0.0, 0.0, 1.0)
    assert got["s"].joint_success == 0.0 and got["u"].sentence_em == 1.0 and got["u"].answer_em == 0.0
    gate = verification.evidence_gate(F.array(F.lit("f")), F.array(F.lit("f")), F.array(F.lit(1), F.lit(1)), F.array(F.lit(1), F.lit(1), F.lit(1)))
    assert spark.range(1).select(gate).first()[0] is False


def test_judging_and_blocks(spark):
    from tidemill.operators import verification

    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    judged = lambda a, kind, value=None, values=(), forbidden=(): one(evaluation.judge(F.lit(a), F.lit(kind), F.lit(value).cast("string"), arr(*values), arr(*forbidden)))
    assert judged("A b", "exact", "ab") and judged("x y z", "contains_all", values=["xy", "Z"]) and not judged("x y z", "contains_all", values=["x"], forbidden=["z"])
    assert judged("final answer = -2.0", "labelled_number", "-2") and not judged("42", "labelled_number", "42") and judged("not enough evidence", "refusal", values=["Not enough"])
    assert judged("Ａ Ｂ", "exact", "ab") and judged("ﬁnal answer: ４.5", "labelled_number", "4.50") and not judged("a b", "exact", "b")
    ruled = lambda a, *p: one(evaluation.judge(F.lit(a), F.lit("refusal"), F.lit(None).cast("string"), arr("unknown"), arr(), arr(*p)))
    assert ruled("It is unknown", "certain") and not ruled("unknown, but CERTAINly 3", "certain(ly)? \\d")
    with pytest.raises(Exception, match="unsupported answer rule: other"):
        judged("x", "other")
    s = lambda kind, a, e=(), g=(), n=(): one(verification.success(F.lit(kind), F.lit(a), arr(*e), arr(*g), F.lit(42.0), arr(*n), 2))
    assert s("multihop", "", ["a", "b"], ["b"]) and not s("multihop", "", ["x", "y", "b"], ["b"]) and not s("multihop", "", ["a"]) and s("calc", "it is 42.01") and s("memory", "likes tea", n=["tea"]) and not s("memory", "tea") and not s("", "x")
    assert [one(memory.visibility(F.lit(v))) for v in (" private ", "2", "1", "x", None)] == ["PRIVATE", "PRIVATE", "PUBLIC", "PUBLIC", "PUBLIC"]
    assert one(memory.visibility(F.lit("2"), numbers_as_text=False)) == "PUBLIC"
    facts = spark.createDataFrame([(1, 2, "", "b"), (1, 1, "pet", "a cat")], "query_id long, rank int, fact_object string, content string")
    assert memory.block(facts).first().memory == "- (pet) a cat\n- b"


def test_reward_tricks_do_not_pay(spark):
    from tidemill.operators import rewards

    r = "retrieve_docs"
    call = lambda task, step, key, found: (task, step, r, False, key, False, True, [found], ["x", "y"], True)
    end = lambda task, step: (task, step, None, True, None, False, True, [], ["x", "y"], True)
    rows = [call("h", 0, "1", "x"), call("h", 1, "2", "y"), end("h", 2), end("e", 0), call("d", 0, "1", "x"), call("d", 1, "1", "x"), end("d", 2), ("u", 0, "shell", False, "1", False, True, [], ["x", "y"], True), end("u", 1)]
    kinds = spark.createDataFrame([("h", "honest"), ("e", "early_stop"), ("d", "repeated"), ("u", "unsupported")], "task_id string, kind string")
    got = rewards.audit(episodes.rescore(steps(spark, rows), [r], 5), kinds).collect()
    assert len(got) == 6 and all(x.passed for x in got)
