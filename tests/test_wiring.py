"""Artefacts, wired agents, probes, audits and vocabularies."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import text as X
from tidemill.operators import chunking, datasets, episodes, evaluation, memory, rewards
from tidemill.plans import agent, wiring
from tidemill.sources import artifacts, records

SCHEMA = "id string, question string, answer string, type string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>"


def test_prepared_data_and_its_manifest(spark, tmp_path):
    rows = [(str(i), "Q?", "A", "bridge", ([f"T{i}"], [0]), ([f"T{i}"], [[f"sentence number {i}"]])) for i in range(12)] + [("x", " ", "A", "b", ([], []), ([], []))]
    made = datasets.prepare(spark.createDataFrame(rows, SCHEMA), skip_invalid=True)
    folder = str(tmp_path / "prepared")
    facts = artifacts.write_prepared(*made, folder, X.simple_tokens(F.col("text")), dataset="d")
    assert facts["tasks"] == 12 and facts["corpus_records"] == facts["bm25_records"] == 12 and facts["skipped_rows"] == 1 and sum(facts["partition_counts"].values()) == 12
    assert artifacts.read_manifest(spark, folder) == facts and artifacts.changed(spark, folder) == []
    with pytest.raises(FileExistsError):
        artifacts.write_prepared(*made, folder)
    records.write_jsonl(made[0].limit(1), f"{folder}/tasks", overwrite=True)
    assert artifacts.changed(spark, folder) == ["tasks"]


def test_training_files(spark, tmp_path):
    step = lambda i, a: (i, a, False, False, True)
    said = lambda a: (f"do {a}", a, False, "sys", "user")
    rows = [("k", [said("t"), said("final_answer")], [step(0, "t"), step(1, "final_answer")], 1.0, 1.0, "p1"), ("bad", [said("t")], [step(5, "t")], 1.0, 1.0, "p1")]
    df = spark.createDataFrame(rows, "task_id string, decisions array<struct<raw:string,action:string,parse_error:boolean,system_prompt:string,user_prompt:string>>, transitions array<struct<step:int,action:string,duplicate:boolean,invalid:boolean,ok:boolean>>, success double, evidence double, policy_version string")
    source, target, report = (str(tmp_path / n) for n in ("in", "out", "report"))
    df.write.parquet(source)
    facts = artifacts.write_training(spark.read.parquet(source), source, target, report, repeat=2)
    assert facts["examples_written"] == 3 and facts["counts"]["filter"] == {"transition_step_mismatch": 1} and facts["counts"]["output_action"] == {"tool": 2, "final_answer": 1} and facts["counts"]["policy"] == {"p1": 1}
    lines = [json.loads(r.value) for r in spark.read.text(target).collect()]
    assert all([m["role"] for m in x["messages"]] == ["system", "user", "assistant"] for x in lines) and {x["messages"][2]["content"] for x in lines} == {"do t", "do final_answer"}
    assert json.loads(spark.read.text(report).first().value) == facts
    with pytest.raises(FileExistsError):
        artifacts.write_training(df, source, target, report)
    again = artifacts.write_training(spark.read.parquet(source), source, target, report, form="prompt_response", overwrite=True)
    assert again["examples_written"] == 2 and "response" in json.loads(spark.read.text(target).first().value)
    with pytest.raises(ValueError):
        artifacts.write_training(df, source, source)


LETTERS = "abcdefghijklmnopqrstuvwxyz"
embed = F.udf(lambda s: [float((s or "").lower().count(c)) + 0.01 for c in LETTERS], T.ArrayType(T.FloatType()))


def test_wired_agents(spark):
    texts = ["tea is made of leaves", "coffee is made of beans", "tea has caffeine too", "zebras have stripes"]
    chunks = spark.createDataFrame([(i, "d.md" if i < 3 else "z.md", i, t, "p0" if i < 3 else "p1") for i, t in enumerate(texts)], "doc_id long, source string, chunk_id int, text string, parent_id string")
    vectors = chunks.select("doc_id", embed("text").alias("vector"))
    asked = spark.createDataFrame([(1, "stripes of zebras")], "query_id long, query string")
    plain = wiring.retriever(wiring.Config(top_k=1, parents=False), chunks, vectors, embed, X.simple_tokens)(asked).first()
    assert (plain.source, plain.chunk_id, plain.rank) == ("z.md", 3, 1)
    ranked = wiring.retriever(wiring.Config(top_k=2), chunks, vectors, embed, X.simple_tokens, lambda q, t: F.contains(t, F.lit("beans")).cast("double"))(asked).orderBy("rank").collect()
    assert ranked[0].text == "\n\n".join(texts[:3]) and ranked[0].source == "d.md"
    assert wiring.retriever(wiring.Config(), None, None, embed)(asked).count() == 0
    facts = chunks.select(F.col("doc_id").alias("fact_id"), embed("text").alias("vector"), F.lit("ACTIVE").alias("state"), F.lit("").alias("fact_object"), F.col("text").alias("content"))
    recall = wiring.recaller(wiring.Config(recall_k=1), facts, embed)
    assert recall(asked).first().content == texts[3]

    def model(system, user):
        if "Decide which" in system:
            return json.dumps({"use_memory": False, "write_memory": "like" in user, "rewritten_query": "zebras"})
        if "durable facts" in system:
            return json.dumps([{"fact_content": "likes tea"}])
        if "Answer from" in system:
            return "stripes" if "stripes" in user else "?"
        return json.dumps({"final_answer": True} if "observation" in user else {"tool": "retrieve_docs", "args": {"query": "zebras stripes"}})

    say, retrieve = agent.completion(model), wiring.retriever(wiring.Config(top_k=1, parents=False), chunks, vectors, embed)
    generate = lambda df: df.withColumn("answer", F.when(F.contains("context", F.lit("stripes")), "yes").otherwise("no"))
    turns = spark.createDataFrame([(1, "I like zebras"), (2, "zebras?")], "query_id long, message string")
    answers, learnt = wiring.turn_agent(wiring.Config(), say, retrieve, recall, generate)(turns)
    assert {r.query_id: r.answer for r in answers.collect()} == {1: "yes", 2: "yes"} and [(r.query_id, r.fact_content) for r in learnt.collect()] == [(1, "likes tea")]
    tasks = spark.createDataFrame([("t", "what do zebras have")], "task_id string, question string")
    end = wiring.tool_agent(wiring.Config(), say, retrieve, recall)(tasks).first()
    assert (end.answer, end.stop_reason, end.tool_calls, end.evidence) == ("stripes", "final_answer", 1, ["z.md#3"])


def test_tricks_do_not_pay(spark):
    scored = episodes.rescore(rewards.probes(spark), [episodes.RETRIEVE], 9)
    got = rewards.probe_report(scored).collect()
    assert len(got) == 9 and all(r.passed for r in got), got
    greedy = episodes.rescore(rewards.probes(spark), [episodes.RETRIEVE], 9, episodes.REWARDS | {"tool_call_cost": 0.5, "duplicate_call": 0.1})
    assert {r.assertion for r in rewards.probe_report(greedy).filter("NOT passed").collect()} == {"does_not_increase_return", "duplicate_is_penalised"}


def test_audits(spark):
    a = spark.createDataFrame([("x", 1.0, 2.0), ("y", float("nan"), 3.0), ("z", 1.0, float("inf"))], "k string, m double, n double")
    assert {(r.k, r.metric) for r in evaluation.not_finite(a, "k").collect()} == {("y", "m"), ("z", "n")}
    b = a.filter("k = 'x'").withColumn("n", F.lit(2.5))
    assert [(r.k, r.metric, r.reported, r.recomputed) for r in evaluation.integrity(a.filter("k = 'x'"), b, ["k"]).collect()] == [("x", "n", 2.0, 2.5)]
    with pytest.raises(ValueError):
        evaluation.integrity(a, b.drop("n"), ["k"])


def test_vocabularies_and_segmentation(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    text = "Straße 日本語 and more words here, 😀 done."
    spans = chunking.vocabulary_spans(public_tokenizers.path("word_bpe_49k.json"))(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == len(text)
    docs = spark.createDataFrame([("s", text * 5)], "source string, text string")
    rows = chunking.chunk_text(docs, size=12, overlap=3, spans=chunking.vocabulary_spans(public_tokenizers.path("word_bpe_49k.json"))).collect()
    assert len(rows) > 3 and all((text * 5)[r.start : r.end] == r.text for r in rows)
    one = lambda f: spark.createDataFrame([("ABC-1 日本語文 x1",)], "t string").select(f("t").alias("x")).first().x
    assert one(X.retrieval_tokens) == ["abc-1", "x1", "日", "本", "語", "文", "日本", "本語", "語文"]
    assert one(X.token_function(lambda s: [s[:2], s[2:]])) == ["abc-1", "x1", "日本", "語文", "日本", "本語", "語文"]
    same = spark.createDataFrame([("tea", "tea", None)], "a string, b string, c string").select(memory.similarity(F.col("a"), F.col("b"), embed).alias("s"), memory.similarity(F.col("a"), F.col("c"), embed).alias("d")).first()
    assert same.s == pytest.approx(1.0) and 0 < same.d < 1
