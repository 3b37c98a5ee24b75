"""Turns, tools, loops, hops and frozen tasks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import benchmark, episodes, training, verification
from tidemill.plans import agent, frozen
from tidemill.plans import retrieval as plan


def ask(tool, **args):
    return json.dumps({"tool": tool, "args": args})


DONE = json.dumps({"final_answer": True})


@pytest.fixture(scope="module")
def hits(spark):
    rows = [("tea", 1, "d/tea", 0, "Tea is a drink made by Emperor Shen Nong."), ("tea", 2, "d/tea", 1, "It is soluble in water."), ("emperor", 1, "d/shen_nong-0123456789", 4, "Shen Nong ruled.")]
    return spark.createDataFrame(rows, "word string, rank int, source string, chunk_id int, text string")


def search(hits):
    return lambda asked: asked.select("query_id", "query").join(hits, F.contains(F.lower("query"), F.col("word"))).select("query_id", "rank", "source", "chunk_id", "text")


def test_registry_checks_before_it_runs(spark, hits):
    registry = agent.Registry().register(agent.retriever(search(hits))).register(agent.calculator())
    assert [s["name"] for s in registry.specs()] == ["retrieve_docs", "calculator"] and len(registry.specs(["calculator", "x"])) == 1
    assert "- query (str, required)" in registry.render()
    calls = spark.createDataFrame([("a", "retrieve_docs", '{"query": "tea", "k": 1}'), ("b", "retrieve_docs", '{"q": "tea"}'), ("c", "shell", "{}"), ("d", "calculator", '{"expression": "6 * 7"}'), ("e", "calculator", '{"expression": "1 / 0"}'), ("f", "retrieve_docs", '{"query": " "}'), ("g", "retrieve_docs", '{"query": "none"}'), ("h", "calculator", "[1]")], "task_id string, tool string, args string")
    got = {r.task_id: r for r in registry.dispatch(calls).collect()}
    assert got["a"].ok and got["a"].evidence == ["d/tea#0"] and got["a"].content.startswith("retrieved chunks:\n[d/tea#0] Tea")
    assert got["b"].error == "bad args: unknown args: q" and got["c"].error == "unknown tool: shell; available: retrieve_docs, calculator"
    assert got["d"].content == "42" and got["e"].error == "division by zero" and got["f"].error == "empty query" and got["g"].ok and got["g"].evidence == []
    assert got["h"].error == "bad args: args must be a JSON object" and len(got) == 8


def test_loop_budgets_and_stops(spark, hits):
    registry = agent.Registry().register(agent.retriever(search(hits))).register(agent.calculator())
    scripts = {
        "good": [json.dumps({"plan": ["look", "answer"], "thought": "t"}), "```json\n" + ask("retrieve_docs", query="tea") + "\n```", ask("calculator", expression="2+2"), DONE],
        "same": [ask("calculator", expression="1")] * 6,
        "junk": ["no json"] * 6,
        "steps": [ask("calculator", expression=str(i)) for i in range(9)],
        "mends": ["no json", ask("calculator", expression="1"), ask("calculator", expression="1"), ask("calculator", expression="2"), ask("shell"), DONE],
        "blank": [],
    }
    rows = [(t, i, raw) for t, s in scripts.items() for i, raw in enumerate(s)]
    script = spark.createDataFrame(rows, "task_id string, step int, raw string")
    tasks = spark.createDataFrame([(t, " " if t == "blank" else "Q?") for t in scripts], "task_id string, question string")
    got = {r.task_id: r for r in agent.converse(tasks, agent.from_script(script), registry).collect()}
    assert (got["good"].stop_reason, got["good"].n_steps, got["good"].tool_calls, got["good"].plan) == ("final_answer", 4, 2, ["look", "answer"])
    assert got["good"].evidence == ["d/tea#0", "d/tea#1"] and [s.observation for s in got["good"].log][2:] == ["4", "final_answer"] and got["good"].log[0].thought == "t"
    assert (got["same"].stop_reason, got["same"].n_steps, got["same"].tool_calls) == ("loop_abort", 4, 1)
    assert (got["junk"].stop_reason, got["junk"].n_steps) == ("parse_abort", 3) and got["steps"].stop_reason == "budget" and got["steps"].n_steps == 6
    assert got["mends"].stop_reason == "final_answer" and [s.error for s in got["mends"].log] == ["invalid decision JSON", None, "duplicate call", None, "unknown tool: shell; available: retrieve_docs, calculator", None]
    assert (got["blank"].stop_reason, got["blank"].n_steps) == ("final_answer", 0)
    few = agent.converse(tasks.filter("task_id = 'steps'"), agent.from_script(script), registry, max_steps=9, max_tool_calls=3).first()
    assert (few.stop_reason, few.n_steps, few.tool_calls) == ("budget", 3, 3)
    called = {r.task_id: r.c for r in agent.converse(tasks, agent.from_script(script), registry).select("task_id", agent.called(F.col("log")).alias("c")).collect()}
    assert called["mends"] == ["calculator", "calculator", "shell"] and called["blank"] == []


def test_write_memory_learns_from_the_question(spark):
    heard = []
    echo = agent.Tool("write_memory", "", {"text": ("str", False, "")}, lambda calls: calls.select("task_id", F.get_json_object("args", "$.text").alias("content")))
    script = spark.createDataFrame([("a", 0, ask("write_memory")), ("a", 1, ask("write_memory", text="other"))], "task_id string, step int, raw string")
    heard = agent.converse(spark.createDataFrame([("a", 'I say "tea"')], "task_id string, question string"), agent.from_script(script), agent.Registry().register(echo)).first()
    assert [s.observation for s in heard.log] == ['I say "tea"', "other", "final_answer"]


def test_single_turns(spark, hits):
    turns = spark.createDataFrame([(1, "what is tea"), (2, " "), (3, "remember tea"), (4, "broken tea")], "query_id long, message string")

    def reply(system, user):
        if "broken" in user:
            raise OSError
        return json.dumps({"use_docs": "what" in user, "use_memory": "remember" in user, "write_memory": "remember" in user})

    facts = lambda asked: asked.select("query_id", F.lit(1).alias("rank"), F.lit("").alias("fact_object"), F.lit("likes tea").alias("content"))
    generate = lambda asked: asked.withColumn("answer", F.concat_ws("|", F.length("context") > 0, "memory", "query"))
    learn = lambda said: said.select("query_id", F.col("message").alias("fact_content"))
    out, learnt = agent.turn(turns, agent.completion(reply), facts, search(hits), generate, learn)
    got = {r.query_id: r for r in out.collect()}
    assert got[1].answer == "true||what is tea" and [s.citation for s in got[1].sources] == ["Chunk 0, tea", "Chunk 1, tea"]
    assert got[2].answer == "false||" and not got[2].use_docs and got[3].answer == "false|- likes tea|remember tea" and got[3].sources is None
    assert got[4].answer == "true|- likes tea|broken tea" and got[4].write_memory
    assert {r.query_id for r in learnt.collect()} == {3, 4}
    said = {r.query_id: json.loads(r.json) for r in plan.serialise(out).collect()}
    assert said[3]["route"] == {"rewritten_query": "remember tea", "use_docs": False, "use_memory": True, "write_memory": True} and said[3]["sources"] == [] and len(said[1]["sources"]) == 2
    direct = plan.direct(turns.select("query_id", F.col("message").alias("text"))).filter("query_id = 1").first()
    assert (direct.source, direct.chunk_id, direct.end) == ("direct_query", -1, 11)
    tools = out.select("query_id", agent.route_tools(F.col("use_docs"), F.col("use_memory"), F.col("write_memory")).alias("t")).collect()
    assert {r.query_id: r.t for r in tools} == {1: ["retrieve_docs"], 2: [], 3: ["read_memory", "write_memory"], 4: ["read_memory", "retrieve_docs", "write_memory"]}


def test_two_hops_follow_what_was_found(spark, hits):
    tasks = spark.createDataFrame([("a", "Who made tea", ["d/tea#0", "d/shen_nong-0123456789#4"])], "task_id string, question string, gold_evidence array<string>")
    got = agent.hops(tasks, search(hits), first_k=1).first()
    assert got.queries == ["Who made tea", "Emperor Shen Nong"] and got.evidence == ["d/tea#0", "d/shen_nong-0123456789#4"]
    report = {r.policy: r for r in agent.hop_report(tasks, search(hits), first_k=1).collect()}
    assert report["two_hop"].sentence_recall == 1.0 and report["one_shot"].sentence_recall == 0.5 and report["one_shot"].n == 1
    with pytest.raises(ValueError):
        agent.hops(tasks, search(hits), first_k=0)


def test_records_of_evaluated_runs(spark):
    tasks = spark.createDataFrame([("m", "multihop", ["a", "b"], 0.0, [], ["r"]), ("c", "calc", [], 4.0, [], [])], "task_id string, type string, gold_ids array<string>, expected_value double, needles array<string>, expected_tools array<string>")
    runs = spark.createDataFrame([("m", "loop", "", ["a", "a", "b"], ["r", "x"], 3, 2, 4, 1, "final_answer"), ("c", "loop", "4", [], [], 1, 0, 0, 0, "budget")], "task_id string, agent string, answer string, retrieved array<string>, called array<string>, llm_calls int, tool_calls int, steps int, parse_failures int, stop_reason string")
    got = {r.task_id: r for r in agent.records(tasks, runs, 2).collect()}
    assert got["m"].success and got["m"].coverage == 1.0 and (got["m"].tool_precision, got["m"].tool_recall, got["m"].parse_fail_rate) == (0.5, 1.0, 0.25)
    assert got["c"].success and got["c"].coverage is None and (got["c"].tool_precision, got["c"].parse_fail_rate) == (1.0, 0.0)
    s = verification.evaluation_summary(agent.records(tasks, runs, 2)).first()
    assert (s.task_success, s.coverage, s.steps) == (1.0, 1.0, 2.0)


def test_frozen_tasks_by_baseline_and_loop(spark):
    names = "task_id string, cohort string, enabled boolean, skip_reason string, question string, route struct<use_docs:boolean,use_memory:boolean,write_memory:boolean>, write_fact string, required_docs array<string>, required_memory array<string>, required_calculations array<string>, required_artifacts array<string>, no_documents boolean, memory_after array<string>, memory_after_count int, tool_counts map<string,int>, tool_sequence array<string>, failed_tool_calls int, parse_failures int, answer struct<kind:string,value:string,values:array<string>,forbidden:array<string>,patterns:array<string>,gold:string>"
    rule = ("exact", None, [], [], [], "yes")
    rows = [
        ("doc", "shared_core", True, None, "find the TEA", (True, False, False), None, ["d1"], [], [], [], False, [], None, {"retrieve_docs": 1}, ["retrieve_docs"], 0, None, rule),
        ("mem", "shared_core", True, None, "likes", (False, True, True), "a cat", [], ["Tea"], [], [], True, ["a  cat", "tea"], 2, {"read_memory": 1, "write_memory": 1, "calculator": 0}, None, None, None, rule),
        ("sum", "extended_tools", True, None, "how much", (False, False, False), None, [], [], ["4.0", "4"], [], False, [], None, {"calculator": 2}, None, 1, 1, rule),
        ("off", "reserved", False, "later", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    tasks = spark.createDataFrame(rows, names)
    assert benchmark.rejects(tasks).count() == 0
    documents = spark.createDataFrame([("doc", 0, "d0", ["coffee"]), ("doc", 1, "d1", ["te a", "find"])], "task_id string, place int, doc_id string, match_terms array<string>")
    facts = spark.createDataFrame([("mem", "f1", "", "likes tea", "ACTIVE"), ("mem", "f2", "", "hates tea", "DELETED")], "task_id string, id string, fact_object string, fact_content string, state string")
    script = [("doc", [ask("retrieve_docs", query="find tea"), DONE]), ("mem", [ask("read_memory", query="likes"), ask("write_memory"), DONE]), ("sum", ["?", ask("calculator", expression="2+2"), ask("calculator", expression="1+"), ask("calculator", expression="8/2"), DONE])]
    script = spark.createDataFrame([(t, i, raw) for t, s in script for i, raw in enumerate(s)], "task_id string, step int, raw string")
    runs = frozen.baseline(tasks, documents, facts).unionByName(frozen.loop(tasks, script, documents, facts))
    got = {(r.task_id, r.agent): r for r in benchmark.score(tasks, runs).collect()}
    assert got["doc", "loop"].success and got["doc", "baseline"].success and got["mem", "loop"].success and got["mem", "baseline"].success
    assert not got["sum", "baseline"].success and got["sum", "baseline"].capability == 0.0 and got["sum", "loop"].evidence and got["sum", "loop"].answer_ok
    assert not got["sum", "loop"].tool_exact and got["sum", "loop"].recovery_ok and got["sum", "loop"].stop_reason == "final_answer" and len(got) == 6
    summary = {(r.agent, r.cohort): r for r in benchmark.summarise(benchmark.score(tasks, runs), "agent", "cohort").collect()}
    assert summary["loop", "shared_core"].task_success == 1.0 and summary["loop", "shared_core"].tool_sequence_exact_match == 1.0 and summary["loop", "extended_tools"].refusal_accuracy is None
    assert {r.metric: r.delta for r in benchmark.delta(benchmark.score(tasks, runs)).collect()}["task_success"] == 0.0


def test_gate_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    event = lambda i, tool, args, ok: F.struct(F.lit(i).alias("step_index"), F.lit(tool).alias("tool"), F.lit(args).alias("args"), F.lit(ok).alias("ok"))
    history = F.array(event(0, "t", "{}", False), event(0, "t", "{}", True), event(1, "t", "{}", False))
    assert one(training.tool_event(history, F.lit(0), F.lit("t"), F.lit("{}"))).ok is True and one(training.tool_event(history, F.lit(2), F.lit("t"), F.lit("{}"))) is None
    rows = spark.createDataFrame([("g", 1.0), ("h", 1.0), ("h", float("nan"))], "group_id string, reward double")
    for group, why in (("g", "two rewards"), ("h", "finite")):
        with pytest.raises(Exception, match=why):
            training.advantages(rows.filter(F.col("group_id") == group), strict=True).collect()
    with pytest.raises(Exception, match="no room"):
        spark.range(1).select(training.truncate(F.array(F.lit(1)), F.array(*map(F.lit, range(9))), 8, strict=True)).collect()
    first = [r.task_id for r in training.shuffled(spark.range(50).withColumnRenamed("id", "task_id"), 3, 10).orderBy("ord").collect()]
    again = [r.task_id for r in training.shuffled(spark.range(50).withColumnRenamed("id", "task_id").repartition(7), 3, 10).orderBy("ord").collect()]
    assert first == again and len(set(first)) == 10 and first != list(range(10))
    assert episodes.PAIRED[1] == ("PrematureStopRate", "premature", "episode") and len(episodes.PAIRED) == 11
